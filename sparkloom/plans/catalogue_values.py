"""Values that the queries and their SQL share."""

from __future__ import annotations

EXTENSIONS = (".json", ".JSONL", ".csv", ".txt", ".epub", ".docx", "")
LAYER_OF = {"signup": "core", "purchase": "semantic", "click": "episodic", "view": "raw", "error": "raw"}
NOW = "2024-06-15T00:00:00"
HALFWAY = "2024-01-20T00:00:00"
HOT_GAP = 0.05  # hours
WORD_BREAKS = "[ \\n\\t.,;:!?|]+"
