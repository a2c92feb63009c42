"""Schemas of the data model, as DDL. Every list carries an ordinal where order matters."""

from __future__ import annotations

MESSAGES = "ord BIGINT, ts STRING, sender_id STRING, sender_name STRING, direction STRING, content STRING, type STRING, source STRING"
LORE = "STRUCT<title: STRING, content: STRING, keys: STRING>"
FRAGMENT = f"traits ARRAY<STRING>, behavior_rules ARRAY<STRING>, taboos ARRAY<STRING>, humor ARRAY<STRING>, memories ARRAY<STRING>, uncertainties ARRAY<STRING>, scene_tone ARRAY<STRUCT<k: STRING, v: STRING>>, lore_candidates ARRAY<{LORE}>, evidence ARRAY<STRUCT<quote: STRING, message_index: STRING>>"
LIST_FIELDS = ("traits", "behavior_rules", "taboos", "humor", "memories", "uncertainties")
LEDGER = "run_id STRING, seq BIGINT, block_id BIGINT, status STRING, attempts INT, error STRING, calls INT, prompt_tokens BIGINT, completion_tokens BIGINT, reply STRING"
MEMORY_EVENTS = "seq BIGINT, op STRING, profile_id STRING, owner STRING, id BIGINT, layer STRING, content STRING, importance DOUBLE, ts STRING, meta STRING"
MEMORY_STATE = "id BIGINT, profile_id STRING, owner STRING, layer STRING, content STRING, importance DOUBLE, created_at STRING, last_accessed STRING, decay_score DOUBLE, archived BOOLEAN, meta STRING"
BOOK_ENTRY = "STRUCT<id: INT, keys: ARRAY<STRING>, content: STRING, comment: STRING, enabled: BOOLEAN, insertion_order: INT, constant: BOOLEAN, position: STRING>"
DIRECTIONS = ("self", "other")
LAYERS = ("raw", "episodic", "semantic", "core")
