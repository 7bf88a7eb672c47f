"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality

WORDS = r"'[^\x20\x09-\x0D]+'"

MIXING = f"""
WITH r AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS key, CAST(coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')) AS o FROM documents),
s AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY key),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * {mixing.REPEATS} AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS place, CAST(total - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, place) AS free FROM l WHERE NOT cap <= level * weight),
p AS (SELECT l.*, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE) ELSE (SELECT free FROM f) * weight END AS target FROM l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS rounds, CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest FROM p),
h AS (SELECT *, CAST(rounds * source_size + rest AS BIGINT) AS words, CAST(greatest(least(round(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) * {float(1 << mixing.SLOT_BITS)} / total), {1 << mixing.SLOT_BITS}), 0) AS BIGINT) AS high FROM q WHERE total > 0),
e AS (SELECT key, words, first, greatest(high - first, 1) AS slots FROM (SELECT *, least(lag(high, 1, 0) OVER (ORDER BY source NULLS LAST), {(1 << mixing.SLOT_BITS) - 1}) AS first FROM h) WHERE words > 0),
points AS (SELECT key, words, slots, slot, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM (SELECT e.*, list_sum([((p.point >> i) & 1) << ({mixing.SLOT_BITS - 1} - i) FOR i IN range({mixing.SLOT_BITS})]) AS slot FROM e JOIN range({1 << mixing.SLOT_BITS}) p(point) ON p.point >= e.first AND p.point < e.first + e.slots)),
blocks AS (SELECT key, rank, slot, rank * (words // slots) + rank * (words % slots) // slots AS low, (rank + 1) * (words // slots) + (rank + 1) * (words % slots) // slots AS high FROM points),
laid AS (SELECT row_number() OVER () AS id, r.doc_id, r.size, q.key, q.source_size, q.target, e.words, e.slots, CAST(sum(r.size) OVER (PARTITION BY r.key ORDER BY r.o, r.size ROWS UNBOUNDED PRECEDING) - r.size AS BIGINT) AS start FROM r JOIN q ON q.key = r.key LEFT JOIN e ON e.key = q.key),
again AS (SELECT *, a AS low, least(a + size, words) AS high FROM (SELECT *, start + unnest(range(0, (words - 1 - start) // source_size + 1)) * source_size AS a FROM laid WHERE size > 0 AND start < words)),
touched AS (SELECT *, unnest(range(((low + 1) * slots - 1) // words, (high * slots - 1) // words + 1)) AS rank FROM again),
taken AS (SELECT t.id, sum(least(t.high, b.high) - greatest(t.low, b.low)) AS taken, count(*) AS n_parts, min(slot) AS first_slot FROM touched t JOIN blocks b ON b.key = t.key AND b.rank = t.rank WHERE least(t.high, b.high) > greatest(t.low, b.low) GROUP BY t.id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(n_parts, 0) AS n_parts, CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot FROM laid LEFT JOIN taken USING (id)
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_RATIO = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / CAST(nullif(n_words, 0) AS DOUBLE)",
    "symbols_per_word": "n_symbols / CAST(nullif(n_words, 0) AS DOUBLE)",
    "dup_line_share": "n_dup_lines / CAST(nullif(n_lines, 0) AS DOUBLE)",
    "stop_word_share": "n_stop / CAST(nullif(n_words, 0) AS DOUBLE)",
}
_KEPT = " AND ".join(f"{_RATIO[n]} {op} {x}" for n, low, high in quality.RULES for op, x in ((">=", low), ("<=", high)) if x is not None)

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, doc_id, t, regexp_extract_all(t, {WORDS}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT n, unnest(range(1, len(words) - 1)) AS i, words FROM w),
h AS (SELECT n, i, count(*) OVER (PARTITION BY n, words[i], words[i + 1], words[i + 2]) AS c FROM g),
k AS (SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM h, range(3) r(j) WHERE c > 1 GROUP BY n),
m AS (SELECT w.n, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP}))) AS n_stop FROM w LEFT JOIN k ON k.n = w.n),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_KEPT}, false) AS kept FROM b
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), {WORDS}) AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n_shingles FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, n_shingles, min(b) AS component_id, min(b) = doc_id AS kept FROM n JOIN r ON r.a = doc_id GROUP BY doc_id, n_shingles
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, CAST(len(regexp_extract_all(lines[i], {WORDS})) AS BIGINT) AS words FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
p AS (SELECT *, row_number() OVER d AS k, sum(words) OVER d AS upto FROM l WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT s.doc_id, s.k AS first, e.k AS last FROM p s JOIN p e ON s.doc_id = e.doc_id AND s.k <= e.k
  WHERE e.upto - s.upto + s.words >= 50 AND (e.upto - e.words - s.upto + s.words < 50 OR e.upto - s.upto < 50)),
texts AS (SELECT runs.doc_id, first, last, string_agg(line, chr(10) ORDER BY k) AS run FROM runs JOIN p ON p.doc_id = runs.doc_id AND k BETWEEN first AND last GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS place FROM texts) WHERE place > 1),
gone AS (SELECT DISTINCT p.doc_id, i FROM later JOIN p ON p.doc_id = later.doc_id AND k BETWEEN first AND last),
marked AS (SELECT l.*, gone.i IS NOT NULL AS deleted FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i)
SELECT d.doc_id, count(i) AS n_lines, count(i) FILTER (deleted) AS n_removed, CAST(coalesce(sum(words) FILTER (deleted), 0) AS BIGINT) AS words_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT deleted), '') END AS text
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(c AS VARCHAR), '')]), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, n, {_CRC} % 9 AS h, c - c % 5 AS base FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
j AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS taken FROM i LEFT JOIN i b ON b.c = i.base),
r AS (SELECT j.c, t.pos AS place, role, text FROM j JOIN t ON t.c = j.base AND t.pos <= j.h UNION ALL SELECT j.c, taken + pos - h, role, text FROM j JOIN t ON t.c = j.c AND t.pos > j.h),
l AS (SELECT j.c, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS turns FROM j LEFT JOIN r ON r.c = j.c GROUP BY j.c),
p AS (SELECT c, d, turns[1:d] AS k, d = len(turns) AS ends, CASE WHEN d > 0 THEN octet_length(encode(turns[d].text)) ELSE 0 END AS size FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM l)),
v AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
u AS (SELECT v.*, q.conv_id AS parent FROM v LEFT JOIN v q ON q.d = v.d - 1 AND q.k = v.k[1 : v.d - 1]),
w AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
x AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN w USING (conv_id, d)),
above AS (SELECT x.conv_id AS below, x.d AS below_d, y.conv_id, y.d, x.n_children = 0 AS leaf, (x.n - 1) * x.size AS saved FROM x JOIN p ON p.c = x.conv_id AND p.d <= x.d JOIN v y ON y.d = p.d AND y.k = p.k),
z AS (SELECT conv_id, d, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN z USING (conv_id, d)
"""

SQL = {"op6_minhash_dedup": NEAR_DUPLICATES, "op7_source_mixing": MIXING, "op8_quality_rules": QUALITY, "op9_line_dedup": LINE_DEDUP, "op13_prefix_trie": PREFIX_TRIE}
