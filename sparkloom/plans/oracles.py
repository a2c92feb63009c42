"""The catalogue's queries in DuckDB SQL; what depends on a client's replies has none."""

from __future__ import annotations

from .catalogue_values import EXTENSIONS, HALFWAY, HOT_GAP, LAYER_OF, NOW, WORD_BREAKS

WS = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def clean(x: str) -> str:
    return rf"array_to_string(list_filter(list_transform(string_split_regex({x}, '{LINE_END}'), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
LINES = f"""lines AS (
  SELECT source, block_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS item
  FROM (SELECT source, doc_id AS block_id, string_split(t, chr(10)) AS l FROM (SELECT source, doc_id, {clean("text")} AS t FROM documents) WHERE t <> '')
)"""
NAMES = r"""names AS (
  SELECT source, block_id, CAST(unnest(range(len(n))) AS INTEGER) AS pos, unnest(n) AS name, identity
  FROM (SELECT source, doc_id AS block_id, regexp_extract_all(text, '(?:^|\s)([A-Z][a-z]{3,})', 1) AS n, CASE WHEN doc_id % 3 = 0 THEN 'speaks ' || lang ELSE '' END AS identity FROM documents)
), people AS (
  SELECT source, name, count(*) AS mentions, CAST(arg_min(block_id, struct_pack(b := block_id, p := pos)) AS BIGINT) AS first_block, CAST(arg_min(pos, struct_pack(b := block_id, p := pos)) AS INTEGER) AS first_pos,
    coalesce(arg_min(identity, struct_pack(b := block_id, p := pos)) FILTER (identity <> ''), '') AS identity
  FROM names GROUP BY source, name
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY mentions DESC, first_block, first_pos, name) AS INTEGER) AS rank FROM people
)"""
LORE = f"""lore AS (
  SELECT *, split_part(item, ' ', 1) AS title, CASE WHEN {norm("split_part(item, ' ', 1)")} <> '' THEN {norm("split_part(item, ' ', 1)")} ELSE left({norm("item")}, 40) END AS k FROM lines
)"""
FIRST_LORE = "first_lore AS (SELECT * FROM lore QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY block_id, pos) = 1)"
UNION = f"SELECT source, block_id, pos, item FROM lines WHERE {norm('item')} <> '' QUALIFY row_number() OVER (PARTITION BY source, {norm('item')} ORDER BY block_id, pos) = 1"
_LAYER = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYER_OF.items())
STATE = f"""adds AS (
  SELECT event_id AS seq, 'p' || (user_id % 20) AS profile_id, 'u' || user_id AS owner, CASE event_type {_LAYER} END AS layer, props AS content, least(value / 10, 10.0) AS importance, {ISO} AS tm FROM events
), state AS (
  SELECT min(seq) AS id, profile_id, owner, layer, content, arg_min(importance, seq) AS importance, arg_min(tm, seq) AS created_at, arg_max(tm, seq) AS last_accessed FROM adds GROUP BY ALL
), faded AS (
  SELECT *, pow(0.5, greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(last_accessed AS TIMESTAMP)), 0) / 86400000000.0 / CASE layer WHEN 'raw' THEN 30 WHEN 'episodic' THEN 14 ELSE 3650 END) AS d FROM state
)"""
STATE = STATE.replace("FROM adds GROUP BY ALL", "FROM adds GROUP BY profile_id, owner, layer, content")


def _faded(score: str, now: str) -> str:
    """``score`` after the days to ``now`` since last_accessed, with a column ``half`` of half-lives."""
    return f"{score} * pow(0.5, greatest(epoch_us(TIMESTAMP '{now}') - epoch_us(CAST(last_accessed AS TIMESTAMP)), 0) / 86400000000.0 / half)"


def chunked(ts: str, dt: str, size: int) -> str:
    return f"""e AS (SELECT event_id, user_id, {ts} AS s, {dt} AS dt FROM (SELECT *, {ISO} AS iso FROM events)
), a AS (SELECT *, last_value(dt IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e
), b AS (SELECT *, sum(CASE WHEN dt - prev > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a
), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY s, event_id) - 1 AS n FROM b
), chunks AS (SELECT event_id, user_id, s, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY run, n // {size}) - 1 AS INTEGER) AS block_id, CAST(n % {size} AS INTEGER) AS idx FROM c)"""


def packed(source: str, budget: int) -> str:
    """Novel blocks of ``source`` (doc_id, text): sentences into pieces, then pieces into blocks, each by a recursive pass."""
    return rf"""src AS ({source}
), paras AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS t FROM (SELECT doc_id, string_split({clean("text")}, chr(10)) AS l FROM src)
), good AS (SELECT * FROM paras WHERE t <> ''
), sents AS (SELECT doc_id, p, unnest(range(len(l))) AS i, unnest(l) AS s, t FROM (SELECT *, CASE WHEN length(t) <= 600 THEN [t] ELSE regexp_extract_all(t, '[^。！？!?…]*[。！？!?…]|[^。！？!?…]+$') END AS l FROM good)
), walk(doc_id, p, i, size, piece) AS (
  SELECT doc_id, p, i, length(s), 0 FROM sents WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.p, s.i, CASE WHEN w.size + length(s.s) > 600 AND w.size > 0 THEN length(s.s) ELSE w.size + length(s.s) END, w.piece + CASE WHEN w.size + length(s.s) > 600 AND w.size > 0 THEN 1 ELSE 0 END
  FROM walk w JOIN sents s ON s.doc_id = w.doc_id AND s.p = w.p AND s.i = w.i + 1
), pieces AS (
  SELECT doc_id, p, piece, string_agg(s, '' ORDER BY i) AS content, any_value(regexp_matches(t, '^\s*(第[零一二三四五六七八九十百千万0-9]+[章节回卷]|Chapter\s+\d+|序章|楔子|尾声)')) AND piece = 0 AS head
  FROM walk JOIN sents USING (doc_id, p, i) GROUP BY doc_id, p, piece
), flat AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, piece) AS n FROM pieces
), pack(doc_id, n, size, block_id, idx) AS (
  SELECT doc_id, n, length(content), 0, 0 FROM flat WHERE n = 1
  UNION ALL
  SELECT f.doc_id, f.n, CASE WHEN f.head OR k.size + length(f.content) > {budget} THEN length(f.content) ELSE k.size + length(f.content) END,
    k.block_id + CASE WHEN f.head OR k.size + length(f.content) > {budget} THEN 1 ELSE 0 END, CASE WHEN f.head OR k.size + length(f.content) > {budget} THEN 0 ELSE k.idx + 1 END
  FROM pack k JOIN flat f ON f.doc_id = k.doc_id AND f.n = k.n + 1
), out AS (SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, CAST(idx AS INTEGER) AS idx, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM pack JOIN flat USING (doc_id, n))"""


MARKED = f"""SELECT doc_id, array_to_string(list_transform(range(len(l)), lambda i: CASE WHEN i % 5 = 4 THEN 'Chapter ' || i || ' ' || l[i + 1] ELSE l[i + 1] END), chr(10)) AS text
  FROM (SELECT doc_id, string_split(replace({clean("text")}, '.', '。'), chr(10)) AS l FROM documents)"""


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substr({x}, i, 2)))"


def jaccard(a: str, b: str) -> str:
    """Of two expressions without white space."""
    x, y = grams(a), grams(b)
    return f"CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y})))"


def squeezed(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def chance(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || QQ:QQ || '.join(parts)}), 1, 8) AS BIGINT)".replace("QQ", "'")


WI = f"""w AS (
  SELECT item_id AS i, text, list_filter(string_split_regex(lower(text), '{WORD_BREAKS}'), lambda x: length(x) BETWEEN 4 AND 6) AS w FROM benchmark
), book AS (
  SELECT i AS entry_id, w[1:2] AS keys, CASE WHEN i % 3 = 0 THEN w[3:4] ELSE [] END AS second, ['and_any', 'and_all', 'not_any', 'not_all'][i // 3 % 4 + 1] AS logic, lower(text) AS content, i % 11 = 0 AS constant, i % 7 AS priority,
    i % 3 AS sticky, i % 4 AS cooldown, i % 3 AS delay, CASE WHEN i % 2 = 0 THEN 70 ELSE 100 END AS probability, i % 9 = 0 AS exempt, length(text) AS cost, CASE WHEN i % 2 = 0 THEN i % 6 END AS pool, CAST(1 + i % 4 * 5 AS INTEGER) AS weight FROM w
), m AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS size, lower(text) AS t FROM conversations
), lately AS (
  SELECT a.conv, a.place, string_agg(b.t, chr(0)) AS t FROM m a JOIN m b ON a.conv = b.conv AND b.place BETWEEN a.place - 2 AND a.place GROUP BY a.conv, a.place
), called AS (
  SELECT conv, place, entry_id FROM (
    SELECT *, len(list_filter(keys, lambda k: contains(t, k))) > 0 AS hit, len(list_distinct(second)) AS o, len(list_filter(list_distinct(second), lambda k: contains(t, k))) AS n FROM lately CROSS JOIN book
  ) WHERE constant OR (hit AND (o = 0 OR CASE logic WHEN 'and_any' THEN n > 0 WHEN 'and_all' THEN n = o WHEN 'not_any' THEN n = 0 ELSE n < o END))
)"""
WI_DEEP = """edge AS (
  SELECT DISTINCT a.entry_id, b.entry_id AS other FROM book a JOIN book b ON a.entry_id <> b.entry_id AND NOT b.exempt AND len(b.second) = 0 AND len(list_filter(b.keys, lambda k: contains(a.content, k))) > 0
), walk(entry_id, other, level) AS (
  SELECT entry_id, other, 1 FROM edge UNION SELECT w.entry_id, e.other, w.level + 1 FROM walk w JOIN edge e ON w.other = e.entry_id WHERE w.level < 3
), deep AS (
  SELECT conv, place, entry_id, min(level) AS level FROM (
    SELECT conv, place, entry_id, 0 AS level FROM called UNION ALL SELECT conv, place, w.other, w.level FROM called JOIN walk w USING (entry_id)
  ) GROUP BY conv, place, entry_id
)"""
PROFILES = f"""{NAMES}, profiles AS (SELECT source AS name, array_agg(name ORDER BY rank) AS t FROM ranked GROUP BY source)"""
EXT = ", ".join(f"'{x}'" for x in EXTENSIONS)

#: The run over all documents as one book: blocks (b) and what the echo says of those that are done (g, lore).
BOOK = f"""
WITH RECURSIVE {packed("SELECT doc_id, text FROM documents", 3000)},
l AS (SELECT doc_id * 16777216 + block_id AS block, idx, content FROM pack JOIN flat USING (doc_id, n)),
b AS (
  SELECT block, block % 7 = 3 AS bad, sum(length('[' || idx || '] ' || content)) + count(*) - 1 AS size, arg_min(content, idx) AS c, contains(string_agg({norm("content")}, '' ORDER BY idx), 'neversaidatall') AS odd,
    regexp_extract(string_agg(content, ' ' ORDER BY idx), '(?:^|{WS})(\\p{{Lu}}[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\pZ]*)', 1) AS w FROM l GROUP BY block
),
g AS (SELECT *, CASE WHEN contains(c, ': ') THEN substr(c, strpos(c, ': ') + 2) ELSE c END AS f, CASE WHEN w = '' THEN 'Nobody' ELSE trim(w, '.,!') END AS name FROM b WHERE NOT bad),
lore AS (SELECT CASE WHEN {strip("left(f, 6)")} <> '' THEN {strip("left(f, 6)")} ELSE left({strip("left(f, 30)")}, 20) END AS t FROM g WHERE {strip("left(f, 30)")} <> '')"""

SQL = {
    "msg_direction": "SELECT conv_id, turn, role AS sender, CASE WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE trim(text) <> ''",
    "sender_stats": f"""
WITH r AS (SELECT role, conv_id, turn, {strip("text")} AS s FROM conversations),
f AS (SELECT role, s, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM r WHERE length(s) >= 2 QUALIFY n <= 3),
g AS (SELECT role, string_agg(left(s, 60), '|' ORDER BY n) AS samples FROM f GROUP BY role)
SELECT role AS name, count(*) AS count, coalesce(any_value(samples), '') AS samples FROM r LEFT JOIN g USING (role) GROUP BY role""",
    "sniff_format": f"""
SELECT doc_id, 'export.d/' || doc_id || [{EXT}][doc_id % 7 + 1] AS path, CASE WHEN doc_id % 7 < 3 THEN 'chat' WHEN doc_id % 7 < 5 THEN 'novel' END AS kind FROM documents""",
    "parse_ts": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 3 THEN NULL WHEN 4 THEN epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) ELSE epoch_us(ts) END AS micros FROM events",
    "chunk_messages_size": "SELECT conv_id, turn, CAST(n // 3 AS INTEGER) AS block_id, CAST(n % 3 AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)",
    "chunk_messages_gap": f"WITH {chunked('iso', 'epoch_us(ts)', 5)} SELECT event_id, user_id, block_id, idx FROM chunks",
    "chunk_messages_nullts": f"WITH {chunked("CASE WHEN event_id % 4 = 1 THEN left(iso, 13) || 'h' ELSE iso END", 'CASE WHEN event_id % 4 = 1 THEN NULL ELSE epoch_us(ts) END', 7)} SELECT event_id, user_id, block_id, idx FROM chunks",
    "block_bounds": f"WITH {chunked('iso', 'epoch_us(ts)', 5)} SELECT user_id, block_id, count(*) AS n_messages, min(s) AS start_ts, max(s) AS end_ts FROM chunks GROUP BY user_id, block_id",
    "block_render": """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT conv_id, CAST(n // 4 AS INTEGER) AS block_id, string_agg('[' || n % 4 || '] ' || CASE WHEN role = 'assistant' THEN 'N' ELSE '对方' END || ': ' || text, chr(10) ORDER BY n) AS rendered FROM c GROUP BY conv_id, n // 4""",
    "normalize_text": f"SELECT conv_id, turn, {norm('text')} AS normal FROM conversations",
    "extract_json": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "evidence_verify": f"""
WITH d AS (SELECT doc_id, {norm("text")} AS t FROM documents), b AS (SELECT item_id, {norm("text")} AS q FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, q) WHERE q <> ''""",
    "evidence_cross_message": f"""
WITH m AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(lead(text) OVER w, '') AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, {strip("CASE WHEN turn % 2 = 0 THEN text || nxt ELSE text END")} AS quote, CASE turn % 3 WHEN 0 THEN idx WHEN 1 THEN -1 ELSE 0 END AS i FROM m),
t AS (SELECT conv_id, array_agg({norm("text")} ORDER BY idx) AS l FROM m GROUP BY conv_id),
k AS (SELECT conv_id, turn, CASE WHEN length(quote) < 2 OR {norm("quote")} = '' THEN NULL WHEN i >= 0 AND coalesce(contains(l[i + 1], {norm("quote")}), false) THEN i WHEN contains(array_to_string(l, ''), {norm("quote")}) THEN 0 END AS kept FROM q JOIN t USING (conv_id))
SELECT conv_id, turn, CASE WHEN kept IS NULL THEN 'dropped' ELSE 'kept' END AS status, CAST(kept AS INTEGER) AS kept_index FROM k""",
    "bigram_jaccard": f"""
WITH c AS (SELECT conv_id, turn, t, {grams("t")} AS x FROM (SELECT conv_id, turn, {squeezed("text")} AS t FROM conversations)), b AS (SELECT item_id, q, {grams("q")} AS y FROM (SELECT item_id, {squeezed("text")} AS q FROM benchmark)),
n AS (SELECT conv_id, turn, item_id, t, q, len(x) + len(y) AS total, len(list_intersect(x, y)) AS shared FROM c CROSS JOIN b)
SELECT conv_id, turn, item_id, CASE WHEN t IS NULL OR q IS NULL OR (t = '' AND q = '') THEN 0.0 ELSE round(CAST(shared AS DOUBLE) / (total - shared), 6) END AS jaccard FROM n""",
    "merge_union": f"WITH {LINES} {UNION}",
    "scene_first_wins": "SELECT source, lang AS scene, doc_id AS block_id, text AS tone FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1",
    "lore_conflict": f"""
WITH {LINES}, {LORE}, w AS (SELECT *, row_number() OVER x AS n, first_value({norm("item")}) OVER x AS f FROM lore WINDOW x AS (PARTITION BY source, k ORDER BY block_id, pos))
SELECT source, count(*) FILTER (n = 1) AS n_lore, CAST(sum(length(item)) FILTER (n = 1) AS BIGINT) AS n_chars, count(*) FILTER ({norm("item")} <> f) AS n_conflicts FROM w GROUP BY source""",
    "style_examples": f"""
WITH {LINES} SELECT source, block_id, pos, '「' || item || '」' AS item FROM lines WHERE pos < 2 QUALIFY row_number() OVER (PARTITION BY source, item ORDER BY block_id, pos) = 1""",
    "clean_text": f"SELECT doc_id, md5({clean('text')}) AS digest FROM documents",
    "chunk_novel": f"WITH RECURSIVE {packed('SELECT doc_id, text FROM documents', 3000)} SELECT * FROM out",
    "chunk_novel_chapters": f"WITH RECURSIVE {packed(MARKED, 1000)} SELECT * FROM out",
    "split_long": f"WITH RECURSIVE {packed(f"SELECT doc_id, replace(text, chr(10), ' ') AS text FROM ({MARKED})", 1 << 30)} SELECT doc_id, idx, n_chars, digest FROM out",
    "character_merge": f"WITH {NAMES} SELECT source, name, mentions, first_block, first_pos, identity FROM people",
    "top_characters": f"WITH {NAMES} SELECT source, rank, name, mentions FROM ranked WHERE rank <= 5",
    "quote_attribution": f"""
WITH {LINES}, {NAMES}, h AS (SELECT source, block_id, name FROM names WHERE pos = 0), k AS (SELECT DISTINCT source, block_id FROM lines),
o AS (SELECT source, block_id, coalesce(lead(name) OVER (PARTITION BY source ORDER BY block_id), '') AS speaker FROM k LEFT JOIN h USING (source, block_id)),
s AS (SELECT source, block_id, pos, item AS quote, speaker FROM lines JOIN o USING (source, block_id)),
j AS (SELECT s.source, s.block_id, s.pos, s.quote, nullif(s.speaker, '') AS speaker, coalesce(first_block <= s.block_id, false) AS attributed FROM s LEFT JOIN people p ON p.source = s.source AND p.name = s.speaker)
SELECT * FROM j QUALIFY NOT attributed OR row_number() OVER (PARTITION BY source, speaker, quote, attributed ORDER BY block_id, pos) = 1""",
    "worldbook_entries": f"""
WITH {LINES}, {LORE}, {FIRST_LORE}, {NAMES},
n AS (SELECT source, array_agg(name ORDER BY rank) AS names FROM ranked WHERE rank <= 5 GROUP BY source),
l AS (SELECT source, 0 AS part, row_number() OVER (PARTITION BY source ORDER BY block_id, pos) - 1 AS i, title || coalesce('|' || nullif(array_to_string(list_filter(string_split_regex(item, '{WS}+'), lambda x: x <> ''), '|'), ''), '') AS keys, '[设定] ' || title || '：' || item AS content, title AS comment FROM first_lore),
u AS (SELECT * FROM lines WHERE {norm("item")} <> '' QUALIFY row_number() OVER (PARTITION BY source, {norm("item")} ORDER BY block_id, pos) = 1),
e AS (SELECT u.source, 1 AS part, row_number() OVER (PARTITION BY u.source ORDER BY block_id, pos) - 1 AS i, coalesce(nullif(array_to_string(list_filter(coalesce(names, []), lambda x: contains(item, x))[1:3], '|'), ''), u.source) AS keys, '[事件] ' || item AS content, left(item, 16) AS comment FROM u LEFT JOIN n ON n.source = u.source QUALIFY i < 60),
b AS (SELECT * FROM l UNION ALL SELECT * FROM e)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY part, i) - 1 AS INTEGER) AS id, keys, content, comment, CAST(100 + part * 100 + i AS INTEGER) AS insertion_order FROM b""",
    "card_fields": f"""
WITH {PROFILES}
SELECT name, name || '，特质：' || array_to_string(t[1:8], '、') || '。习惯：' || array_to_string(t[1:5], '；') || CASE WHEN len(t) > 2 THEN '。幽默感：' || array_to_string(t[3:4], '；') ELSE '' END || '。' || chr(10) || '性格特质：' || array_to_string(t, '、') || chr(10) || '行为习惯：' || array_to_string(t[1:6], '；') AS description,
  array_to_string(t[1:12], '、') AS personality, array_to_string(list_transform(t[1:4], lambda x: '「' || x || '」'), chr(10)) AS mes_example,
  array_to_string(list_transform(range(least(len(t), 3)), lambda i: i || ':' || t[i + 1] || '+key:about ' || t[i + 1] || ':' || t[i + 1] || ':' || (100 + i)), '|') AS entries
FROM profiles""",
    "card_roundtrip": f"""
WITH {PROFILES}
SELECT name, array_to_string(t, '|') AS traits, array_to_string(t[1:6], '|') AS behavior_rules, array_to_string(t[2:2], '|') AS uncertainties, array_to_string(list_transform(t[1:4], lambda x: '「' || x || '」'), '|') AS style_examples,
  array_to_string(list_transform(t[1:3], lambda x: x || ':about ' || x || ':' || x || ' key'), '|') AS lore FROM profiles""",
    "memory_upsert": f"WITH {STATE} SELECT id, profile_id, owner, layer, content, importance, created_at, last_accessed FROM state",
    "memory_edit_delete": f"WITH {STATE} SELECT id, CASE WHEN id % 10 = 0 THEN 'edited ' || content ELSE content END AS content FROM state WHERE id % 17 <> 0 OR id % 34 = 0",
    "memory_decay": f"WITH {STATE} SELECT id, round(d, 6) AS decay_score, d < 0.05 AND layer IN ('raw', 'episodic') AS archived FROM faded",
    "memory_recall_topk": f"""
WITH {STATE}, q AS (SELECT *, {jaccard("'{\"k\":42}'", squeezed("content"))} AS r FROM faded WHERE layer <> 'semantic'),
s AS (SELECT *, round(greatest(d, 0.01) * r * greatest(importance, 0.1) / 10.0, 9) AS score FROM q WHERE r > 0)
SELECT profile_id, owner, CAST(row_number() OVER (PARTITION BY profile_id, owner ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 2""",
    "memory_isolation": f"""
WITH {STATE}, o AS (SELECT profile_id, owner, count(*) FILTER (NOT (d < 0.05 AND layer IN ('raw', 'episodic'))) AS visible, count(*) AS total FROM faded GROUP BY profile_id, owner)
SELECT *, CAST(sum(total) OVER (PARTITION BY profile_id) - total AS BIGINT) AS hidden FROM o""",
    "memory_count": f"WITH {STATE} SELECT profile_id, count(*) AS n FROM state GROUP BY profile_id",
    "recall_embedding": """
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
r AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings JOIN f USING (label))
SELECT vec_id, label, round(s, 6) AS relevance FROM r WHERE s > 0""",
    "html_text": rf"""
WITH r AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<(?:p|h1|h2|h3|div|title)(?:\s[^>]*)?>([^<]+)', 1), lambda x: {strip("x")}) AS l FROM pages)
SELECT page_id, {clean("array_to_string(l, chr(10))")} AS text FROM r""",
    "entity_text": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '-' || role ELSE '[' || role END AS content FROM conversations",
    "flatten_items": f"SELECT conv_id, turn, role || coalesce('|' || nullif({strip('text')}, ''), '') AS items FROM conversations",
    "split_keys": rf"""
WITH b AS (SELECT item_id, list_filter(string_split_regex({strip("text")}, '[\s，。！？、/·（）()]+'), lambda k: length(k) BETWEEN 1 AND 12) AS w,
  regexp_replace(regexp_extract('她： ' || text, '(?:她|他|用户)?[:：]\s*(.{{2,12}})', 1), '[^\p{{L}}\p{{N}}_]', '', 'g') AS f, left({strip("text")}, 12) AS t FROM benchmark),
k AS (SELECT item_id, CASE WHEN length(f) BETWEEN 2 AND 12 AND NOT list_contains(w, f) THEN list_append(w, f) ELSE w END AS k, t FROM b)
SELECT item_id, CASE WHEN len(k) > 0 THEN array_to_string(k[1:4], '|') ELSE t END AS keys FROM k""",
    "migrate_lore": """
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS i, '[' || lang || '] ' || array_to_string(string_split(text, ' ')[1:2], ' ') || '：' || text AS content, array_to_string(string_split(text, ' ')[1:2], ' ') AS comment,
  CAST(100 + floor(CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE (doc_id % 10) / 10 END * 50) AS INTEGER) AS insertion_order, lang AS category FROM documents WHERE doc_id % 2 = 1""",
    "ledger_latest": "SELECT user_id AS block_id, max(event_id) AS seq, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY user_id",
    "ledger_stats": """
WITH l AS (SELECT user_id, arg_max(event_type, event_id) = 'error' AS bad FROM events GROUP BY user_id), e AS (SELECT count(*) AS calls, CAST(count(*) * 10 AS BIGINT) AS prompt_tokens, CAST(sum(floor(value)) AS BIGINT) AS completion_tokens FROM events)
SELECT count(*) FILTER (NOT bad) AS blocks_done, count(*) FILTER (bad) AS blocks_failed, coalesce(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) FILTER (bad), '') AS failed_blocks, any_value(calls) AS calls, any_value(prompt_tokens) AS prompt_tokens, any_value(completion_tokens) AS completion_tokens FROM l, e""",
    "lore_words": f"WITH {LINES} SELECT source, block_id, pos, CAST(len(list_filter(string_split_regex(item, '{WS}+'), lambda x: x <> '')) AS INTEGER) AS n_keys FROM lines",
    "parse_ts_forms": """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(ts) - 28800000000 WHEN 2 THEN epoch_us(date_trunc('hour', ts)) WHEN 3 THEN epoch_us(ts) WHEN 4 THEN epoch_us(date_trunc('minute', ts)) + 19800000000
  WHEN 5 THEN epoch_us(date_trunc('second', ts)) + 123456 WHEN 6 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events""",
    "splitlines": f"SELECT conv_id, turn, array_to_string(list_filter([{strip('text')}, 'two', role, 'four', 'five'], lambda x: x <> ''), chr(10)) AS lines FROM (SELECT conv_id, turn, role, {clean('text')} AS text FROM conversations)",
    "character_profile_text": f"""
WITH {NAMES} SELECT source, string_agg(name || '（' || identity || '）：' || name || ' one、' || name || ' two；风格：' || CASE WHEN mentions % 2 = 0 THEN 'plain' ELSE '' END || CASE WHEN mentions % 3 = 0 THEN '；关系：[' || chr(39) || 'knows ' || name || chr(39) || ', ' || chr(39) || 'x' || chr(39) || ']' ELSE '' END, chr(10) ORDER BY rank) AS text FROM ranked GROUP BY source""",
    "novel_cards": f"""
WITH {NAMES}, c AS (SELECT *, name || '——' || CASE WHEN identity <> '' THEN identity ELSE '本书人物' END || '。' AS first FROM ranked)
SELECT source, name, first || chr(10) || '性格：' || name || ' one、' || name || ' two。' || CASE WHEN mentions % 2 = 0 THEN chr(10) || '说话风格：plain。' ELSE '' END || CASE WHEN mentions % 3 = 0 THEN chr(10) || '人物关系：knows ' || name || '；x。' ELSE '' END
    || chr(10) || '你正与读者（用户）在《' || source || '》的世界中互动，保持人物的言行逻辑与语言习惯。' AS description,
  name || ' one、' || name || ' two' AS personality, '《' || source || '》的世界。用户是穿越进书中世界的读者。' AS scenario, '（' || name || ' 注意到你的到来）……你是谁？为何在此？' AS first_mes,
  '「' || name || ' said」' AS mes_example, CAST(mentions AS INTEGER) AS mention_count FROM c""",
    "memory_touch": f"""
WITH {STATE}, q AS (SELECT *, {jaccard("'{\"k\":42}'", squeezed("content"))} AS r FROM faded WHERE layer <> 'semantic'),
s AS (SELECT *, round(greatest(d, 0.01) * r * greatest(importance, 0.1) / 10.0, 9) AS score FROM q WHERE r > 0),
h AS (SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY profile_id, owner ORDER BY score DESC, id) <= 2)
SELECT id, CASE WHEN h.id IS NOT NULL THEN '{NOW}' ELSE last_accessed END AS last_accessed FROM state LEFT JOIN h USING (id)""".replace("SELECT id, CASE", "SELECT state.id, CASE").replace("JOIN h USING (id)", "JOIN h ON h.id = state.id"),
    "import_telegram": """
SELECT CASE WHEN turn % 2 = 0 THEN '17000' || lpad(CAST(turn AS VARCHAR), 5, '0') ELSE 'day ' || turn END AS ts, conv_id || ':' || turn AS sender_id, role AS sender_name, CASE WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction,
  CASE WHEN turn % 3 = 0 THEN text || '!' || role ELSE text END AS content, 'text' AS type, 'telegram' AS source FROM conversations WHERE turn % 5 <> 4 AND trim(text) <> ''""",
    "import_jsonl": """
SELECT 't' || turn AS ts, conv_id || ':' || turn AS sender_id, role AS sender_name, CASE WHEN turn % 3 = 0 THEN 'self' WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction, text AS content, CASE WHEN turn % 4 = 0 THEN 'image' ELSE 'text' END AS type, 'generic' AS source FROM conversations WHERE trim(text) <> ''""",
    "import_csv": """
SELECT conv_id || ':' || turn AS ts, role AS sender_id, role AS sender_name, CASE WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction, text || ', "' || role || '"' AS content, 'text' AS type, 'generic' AS source FROM conversations WHERE text IS NOT NULL""",
    "import_memotrace": """
SELECT conv_id || ':' || turn AS ts, role AS sender_id, role AS sender_name, CASE WHEN turn % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'self' ELSE 'other' END WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction, text AS content,
  CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'media' ELSE 'note' END AS type, 'memotrace' AS source FROM conversations WHERE trim(text) <> ''""",
    "card_import": f"""
WITH c AS (SELECT *, {strip("text")} AS t FROM conversations)
SELECT conv_id, turn, role AS name, text AS persona_summary, 'kind|' || role || '|calm' AS traits, role || ' says|again' AS style_examples, CASE WHEN t = '' THEN '' ELSE left(t, 20) || ':' || t || ':' || role || ' key last' END AS lore FROM c WHERE text IS NOT NULL""",
    "migrate_convert": """
SELECT 'Nora' AS name, 'kind|brave' AS traits, 'be kind' AS behavior_rules, 'no calls' AS taboos, 'well|so' AS style_examples, CAST((SELECT count(*) FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL) + 2 AS INTEGER) AS n_lore,
  CAST((SELECT count(*) FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND trim(props) <> '') + 1 AS INTEGER) AS n_memories, 'the lake' AS last_memory""",
    "ledger_journal": """
WITH e AS (SELECT event_id, event_type = 'error' AS bad, CAST(length(event_type || ':' || props) AS BIGINT) AS n, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT 'first' AS run_id, CAST(0 AS BIGINT) AS seq, event_id AS block_id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN 1 ELSE 0 END AS attempts, CASE WHEN bad THEN 2 ELSE 1 END AS calls,
  CASE WHEN bad THEN 2 * n ELSE n END AS prompt_tokens, CAST(CASE WHEN bad THEN 6 ELSE 3 END AS BIGINT) AS completion_tokens, CASE WHEN bad THEN 'no JSON object in the reply: ''none''' ELSE '' END AS error, CASE WHEN NOT bad THEN k END AS k FROM e
UNION ALL SELECT 'second', 1, event_id, 'done', 1, 1, n, 3, '', k FROM e WHERE bad""",
    "memory_log": f"""
WITH adds AS (
  SELECT event_id AS seq, 'p' || (user_id % 20) AS profile_id, 'u' || user_id AS owner, CASE event_type {_LAYER} END AS layer, props AS content, least(value / 10, 10.0) AS importance, {ISO} AS tm FROM events
), f AS (
  SELECT seq % 2 AS b, min(seq) AS id, profile_id, owner, layer, content, arg_min(importance, seq) AS importance, arg_min(tm, seq) AS created_at, arg_max(tm, seq) AS last_accessed FROM adds GROUP BY 1, profile_id, owner, layer, content
), x AS (SELECT max(seq) AS top FROM adds WHERE seq % 2 = 0
), h AS (SELECT *, CASE layer WHEN 'raw' THEN 30 WHEN 'episodic' THEN 14 ELSE 3650 END AS half FROM f
), a AS (SELECT *, {_faded("CAST(1 AS DOUBLE)", HALFWAY)} AS d FROM h WHERE b = 0
), both_ AS (
  SELECT coalesce(a.id, n.id + top) AS id, coalesce(a.profile_id, n.profile_id) AS profile_id, coalesce(a.owner, n.owner) AS owner, coalesce(a.layer, n.layer) AS layer, coalesce(a.content, n.content) AS content,
    coalesce(a.importance, n.importance) AS importance, coalesce(a.created_at, n.created_at) AS created_at, coalesce(n.last_accessed, a.last_accessed) AS last_accessed, coalesce(a.half, n.half) AS half, coalesce(a.d, 1.0) AS d,
    coalesce(a.d < 0.05 AND a.layer IN ('raw', 'episodic'), false) AS gone
  FROM a FULL JOIN (SELECT * FROM h WHERE b = 1) n ON a.profile_id = n.profile_id AND a.owner = n.owner AND a.layer = n.layer AND a.content = n.content, x
), later AS (SELECT *, CASE WHEN gone THEN d ELSE {_faded("d", NOW)} END AS e FROM both_ WHERE id % 17 <> 0)
SELECT id, profile_id, owner, layer, CASE WHEN id % 10 = 0 THEN 'edited ' || content ELSE content END AS content, importance, created_at, last_accessed, round(e, 6) AS decay_score, gone OR (e < 0.05 AND layer IN ('raw', 'episodic')) AS archived FROM later""",
    "jaccard_top": f"""
WITH c AS (SELECT conv_id, turn, {grams("t")} AS x FROM (SELECT conv_id, turn, {squeezed("text")} AS t FROM conversations) WHERE t <> ''), b AS (SELECT item_id, {grams("q")} AS y FROM (SELECT item_id, {squeezed("text")} AS q FROM benchmark) WHERE q <> ''),
n AS (SELECT conv_id, turn, item_id, len(x) + len(y) AS total, len(list_intersect(x, y)) AS shared FROM c CROSS JOIN b),
r AS (SELECT *, CAST(shared AS DOUBLE) / (total - shared) AS j, CAST(row_number() OVER (PARTITION BY item_id ORDER BY CAST(shared AS DOUBLE) / (total - shared) DESC, conv_id, turn) AS INTEGER) AS rank FROM n WHERE shared > 0)
SELECT item_id, rank, conv_id, turn, round(j, 6) AS jaccard FROM r WHERE rank <= 5""",
    "chunk_messages_hot": f"""
WITH a AS (SELECT event_id, ts, ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL {int(HOT_GAP * 3600)} SECOND AS gap FROM events),
b AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS n FROM b)
SELECT event_id, CAST(dense_rank() OVER (ORDER BY run, n // 5) - 1 AS INTEGER) AS block_id, CAST(n % 5 AS INTEGER) AS idx FROM c""",
    "chunk_novel_lines": f"WITH RECURSIVE {packed(MARKED, 1000)} SELECT * FROM out",
    "wi_scan": f"WITH {WI} SELECT conv, place, entry_id FROM called",
    "wi_timed": f"""
WITH RECURSIVE {WI}, t AS (
  SELECT conv, place, entry_id, sticky, cooldown FROM called JOIN book USING (entry_id) WHERE place + 1 >= delay AND {chance("conv", "entry_id", "place")} < probability * 4294967296 / 100
), b AS (
  SELECT conv, entry_id, min(place) AS place, any_value(sticky) AS sticky, any_value(cooldown) AS cooldown FROM t GROUP BY conv, entry_id
  UNION ALL
  SELECT b.conv, b.entry_id, min(t.place), any_value(b.sticky), any_value(b.cooldown) FROM b JOIN t ON t.conv = b.conv AND t.entry_id = b.entry_id AND t.place > b.place + b.sticky + b.cooldown GROUP BY b.conv, b.entry_id
)
SELECT b.conv, unnest(range(b.place, least(b.place + sticky, size - 1) + 1)) AS place, entry_id, b.place AS begun FROM b JOIN (SELECT conv, any_value(size) AS size FROM m GROUP BY conv) s ON s.conv = b.conv""",
    "wi_recursion": f"WITH RECURSIVE {WI}, {WI_DEEP} SELECT conv, place, entry_id, CAST(level AS INTEGER) AS level FROM deep",
    "wi_pools": f"""
WITH {WI}, d AS (SELECT conv, place, entry_id, pool, -ln(({chance("conv", "place", "entry_id")} + 1) / 4294967297.0::DOUBLE) / weight AS x FROM called JOIN book USING (entry_id))
SELECT conv, place, entry_id FROM d QUALIFY pool IS NULL OR row_number() OVER (PARTITION BY conv, place, pool ORDER BY x, entry_id) = 1""",
    "wi_budget": f"""
WITH RECURSIVE {WI}, {WI_DEEP}, o AS (
  SELECT conv, place, entry_id, CAST(row_number() OVER p AS INTEGER) AS rank, CAST(sum(cost) OVER (p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM deep JOIN book USING (entry_id) WINDOW p AS (PARTITION BY conv, place ORDER BY constant DESC, priority DESC, level > 0, entry_id)
)
SELECT * FROM o WHERE spent <= 1500""",
    "guards": f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, CAST(ts AS DATE) AS day, hour(ts) >= 8 AND hour(ts) < 22 AND {chance("user_id", "event_id")} < 80 * 4294967296 / 100 AS open, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), g AS (
  SELECT user_id, event_id, n, day, CASE WHEN open THEN 1 ELSE 0 END AS today, CASE WHEN open THEN us END AS last, open AS sent FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, day, CASE WHEN ok THEN before + 1 ELSE before END, CASE WHEN ok THEN us ELSE last END, ok FROM (
    SELECT e.*, g.last, CASE WHEN e.day = g.day THEN g.today ELSE 0 END AS before, e.open AND CASE WHEN e.day = g.day THEN g.today ELSE 0 END < 3 AND (g.last IS NULL OR e.us - g.last >= 5400000000) AS ok FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1
  )
)
SELECT user_id, event_id, sent FROM g""",
    "parse_ts_weeks": """
WITH e AS (SELECT event_id, ts, CAST(1990 + event_id % 60 AS INTEGER) AS y, CAST(event_id % 55 AS INTEGER) AS w, CASE WHEN event_id % 4 = 2 THEN 1 ELSE CAST(event_id % 9 AS INTEGER) END AS d FROM events),
m AS (SELECT *, CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + (w - 1) * 7 AS monday FROM e)
SELECT event_id, CASE WHEN event_id % 4 < 3 AND w BETWEEN 1 AND 53 AND d BETWEEN 1 AND 7 AND monday < date_trunc('week', make_date(y + 1, 1, 4))
  THEN epoch_us(CAST(monday + (d - 1) AS TIMESTAMP)) + CASE WHEN event_id % 4 = 0 THEN epoch_us(date_trunc('second', ts)) - epoch_us(date_trunc('day', ts)) ELSE 0 END END AS micros FROM m""",
    "distill_resume": f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
b AS (SELECT conv_id * 16777216 + n // 50 AS block, split_part(arg_min(text, n), chr(10), 1) AS f, contains(string_agg({norm("text")}, '' ORDER BY n), 'neversaidatall') AS odd FROM m GROUP BY conv_id, n // 50),
q AS (SELECT block, odd, {strip("left(f, 25)")} AS quote FROM b), v AS (SELECT *, length(quote) >= 2 AND {norm("quote")} <> '' AS good FROM q),
l AS (SELECT block, {strip("left(f, 6)")} AS t, {strip("left(f, 30)")} AS c FROM b),
lore AS (SELECT block, CASE WHEN t <> '' THEN t ELSE left(c, 20) END AS title, {norm("c")} AS c FROM l WHERE c <> ''),
keyed AS (SELECT *, CASE WHEN {norm("title")} <> '' THEN {norm("title")} ELSE left(c, 40) END AS k FROM lore),
firsts AS (SELECT k, arg_min(c, block) AS c FROM keyed GROUP BY k),
notes AS (SELECT 'lore「' || title || '」内容冲突，已保留首见' AS note FROM keyed JOIN firsts USING (k) WHERE keyed.c <> firsts.c),
n AS (SELECT (SELECT count(*) FROM v WHERE good) + (SELECT count(*) FROM v WHERE odd) AS kept, (SELECT count(*) FROM v) AS blocks)
SELECT 'assistant' AS name, CAST((SELECT count(DISTINCT {norm("left(f, 12)")}) FROM b WHERE {norm("left(f, 12)")} <> '') AS INTEGER) AS traits, CAST((SELECT count(DISTINCT {norm("left(f, 40)")}) FROM b WHERE {norm("left(f, 40)")} <> '') AS INTEGER) AS memories,
  CAST((SELECT count(DISTINCT {norm("note")}) FROM notes) AS INTEGER) AS uncertainties, CAST((SELECT count(DISTINCT quote) FROM v WHERE good) + (SELECT CASE WHEN bool_or(odd) THEN 1 ELSE 0 END FROM v) AS INTEGER) AS style_examples, CAST((SELECT count(*) FROM firsts) AS INTEGER) AS lore,
  '{{"verified":' || kept || ',"dropped_total":' || (2 * blocks - kept) || ',"blocks_done":' || blocks || ',"blocks_failed":0}}' AS evidence_stats, CAST((SELECT sum(CASE WHEN block % 7 = 3 THEN 3 ELSE 1 END) FROM b) AS BIGINT) AS calls FROM n""",
    "novel_distill": f"""{BOOK}
SELECT 'all' AS book, (SELECT count(*) FROM g) AS blocks_done, (SELECT count(*) FROM b WHERE bad) AS blocks_failed, (SELECT count(*) FROM b) AS calls, CAST((SELECT sum(CASE WHEN bad THEN 1 ELSE size END) FROM b) AS BIGINT) AS prompt_tokens,
  CAST((SELECT sum(CASE WHEN bad THEN 1 ELSE 7 END) FROM b) AS BIGINT) AS completion_tokens, (SELECT count(DISTINCT name) FROM g) AS characters_found, (SELECT count(DISTINCT {norm("left(f, 40)")}) FROM g WHERE {norm("left(f, 40)")} <> '') AS memories,
  (SELECT count(DISTINCT {norm("t")}) FROM lore WHERE {norm("t")} <> '') AS lore_entries, (SELECT count(*) FROM g WHERE odd) AS pending_quotes""",
    "import_dispatch": f"""
WITH c AS (SELECT conv_id || ':' || turn AS ts, role AS sender_name, CASE WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction, text AS content FROM conversations WHERE {strip("text")} <> '')
SELECT f AS file, s AS source, c.* FROM c, (VALUES ('a.jsonl', 'generic'), ('b.CSV', 'generic'), ('c.json', 'telegram'), ('d.json', 'memotrace')) v(f, s)""",
    "read_novels": f"""
WITH b AS (SELECT conv_id // 50 AS book, {clean("string_agg(coalesce(text, ''), chr(10) ORDER BY conv_id, turn)")} AS t FROM conversations GROUP BY conv_id // 50)
SELECT book, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM b""",
    "migrate_entries": rf"""
WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, array_to_string(string_split(text, ' ')[1:2], ' ') AS title, text, lang FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL),
k AS (SELECT *, list_filter(string_split_regex({strip("title")}, '[\s，。！？、/·（）()]+'), lambda k: length(k) BETWEEN 1 AND 12) AS w FROM l)
SELECT CAST(id AS INTEGER) AS id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:4], '|') ELSE left({strip("title")}, 12) END AS keys, md5('[' || lang || '] ' || title || '：' || text) AS digest, title AS comment, 125 AS insertion_order, lang AS category FROM k
UNION ALL SELECT CAST((SELECT count(*) FROM l) + i AS INTEGER), k, md5('[TABOO] Nora讨厌/忌讳：' || d), '忌讳-' || d, 150, 'TABOO' FROM (VALUES (0, 'noise', 'noise'), (1, 'cold rain', 'cold|rain')) v(i, d, k)""",
    "migrate_memories": """
WITH m AS (SELECT row_number() OVER (ORDER BY value DESC, props) - 1 AS i, props AS content FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND trim(props) <> '')
SELECT i, content FROM m UNION ALL SELECT (SELECT count(*) FROM m), 'the lake'""",
    "memory_meta": f"""
WITH a AS (SELECT event_id AS seq, user_id, CASE event_type {_LAYER} END AS layer, props FROM events)
SELECT min(seq) AS id, false AS archived, CASE WHEN min(seq) % 4 > 0 THEN min(seq) END AS source, CASE WHEN min(seq) % 4 > 0 THEN layer END AS tag FROM a GROUP BY user_id, layer, props""",
    "relabel": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'self' ELSE 'other' END AS direction FROM conversations",
    "novel_evidence": rf"""
WITH RECURSIVE {packed("SELECT doc_id, text FROM documents", 3000)},
l AS (SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, CAST(idx AS INTEGER) AS idx, content, coalesce(lead(content) OVER (PARTITION BY doc_id ORDER BY n), '') AS after, (doc_id + block_id + idx) % 4 AS kind FROM pack JOIN flat USING (doc_id, n)),
b AS (SELECT doc_id, block_id, string_agg({norm("content")}, '' ORDER BY idx) AS t FROM l GROUP BY doc_id, block_id),
q AS (SELECT doc_id, block_id, idx, {strip("CASE kind WHEN 0 THEN left(content, 40) WHEN 1 THEN right(content, 12) || ' ' || left(after, 12) WHEN 2 THEN left(content, 3) ELSE substr(content, 2, 30) || ' of another book' END")} AS quote FROM l)
SELECT doc_id, block_id, idx, length(quote) >= 4 AND {norm("quote")} <> '' AND contains(t, {norm("quote")}) AS kept FROM q JOIN b USING (doc_id, block_id)""",
    "novel_files": f"""{BOOK},
people AS (SELECT name, count(*) AS mentions, min(block) AS first FROM g GROUP BY name ORDER BY mentions DESC, first LIMIT 5),
n AS (SELECT (SELECT count(DISTINCT {norm("t")}) FROM lore WHERE {norm("t")} <> '') + least(60, (SELECT count(DISTINCT {norm("left(f, 40)")}) FROM g WHERE {norm("left(f, 40)")} <> '')) AS entries)
SELECT name, name AS card_name, CAST(mentions AS INTEGER) AS mentions, entries, CAST(entries - 1 AS INTEGER) AS last_id FROM people, n""",
}
