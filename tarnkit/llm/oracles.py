"""DuckDB SQL for the corpus queries that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SPACES = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': </turn>') + 1 + escaped) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


KEY = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
COUNTS = f"""len(list_filter(regexp_extract_all(text, '{KEY}', 2), lambda x: length(x) >= 6)) AS a, len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS b,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS c"""
RUNS = f"""
WITH d AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), t AS (SELECT DISTINCT coalesce(text, '') AS text FROM conversations),
o AS (SELECT {COUNTS} FROM d), n AS (SELECT {COUNTS} FROM t WHERE text NOT IN (SELECT text FROM d)), e AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT 1 AS run, count(*) AS n_blobs, 3 * count(*) AS n_pairs, CAST(coalesce(sum(a + b + c), 0) AS BIGINT) AS n_spans FROM o
UNION ALL SELECT 2, count(*), 3 * count(*), CAST(coalesce(sum(a + b + c), 0) AS BIGINT) FROM n
UNION ALL SELECT 3, count(*), count(*), CAST(coalesce(sum(b), 0) AS BIGINT) FROM e
"""


def _op4() -> str:
    kinds = (
        ("assign", 0, """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\"), 2, 6),
        ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        ("hex", 2, "[0-9a-f]+", 0, 24),
    )
    parts = [
        f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, a, a + length(m[i]) AS e, length(own[i]) >= {least} AS good FROM (
      SELECT *, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{p}') AS gap, regexp_extract_all(coalesce(text, ''), '{p}') AS m, regexp_extract_all(coalesce(text, ''), '{p}', {g}) AS own FROM documents
          {"WHERE regexp_matches(text, '[0-9a-f]{24}')" if kind == "hex" else ""})))"""
        for kind, k, p, g, least in kinds
    ]
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
  g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans FROM s WHERE good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(text, '')) AS blob
FROM documents d LEFT JOIN g USING (doc_id)"""


OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT r.id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPACES}')) AS lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
x AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 100 * n_dup_lines <= 60 * greatest(len(lines), 5)
  AND word_chars <= 25 * n_words AND 2 * word_chars >= 3 * n_words AS kept FROM x
"""

OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN df USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM df GROUP BY lang),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p
  FROM g JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(c.n) + 5)) // (any_value(l.n) + 5 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 50
"""

CACHE_RUNS = """
WITH d AS (SELECT coalesce(text, '') AS text FROM documents), b AS (SELECT text FROM d UNION ALL SELECT coalesce(text, '') FROM conversations),
o AS (SELECT count(*) AS n, coalesce(sum(strlen(text)), 0) AS size, count(DISTINCT text) AS texts FROM d), e AS (SELECT count(*) AS n, coalesce(sum(strlen(text)), 0) AS size, count(DISTINCT text) AS texts FROM b)
SELECT 1 AS run, n AS n_rows, CAST(size AS BIGINT) AS n_bytes, texts AS n_texts, CAST(0 AS BIGINT) AS n_stored FROM o
UNION ALL SELECT 2, e.n, CAST(e.size AS BIGINT), e.texts, o.texts FROM e, o
UNION ALL SELECT 3, n, CAST(size AS BIGINT), texts, 0 FROM e
"""

ORACLES = {"op2_decontaminate": OP2, "op3_chat": OP3, "op4_secrets": _op4(), "secret_ledger_runs": RUNS, "op9_near_join": OP9, "op10_quality": OP10, "op11_source_audit": OP11, "token_cache_runs": CACHE_RUNS}
