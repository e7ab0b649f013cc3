"""DuckDB SQL of the longer check queries."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def crc32(s: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    h = f"hex(encode({s}))"
    data = f"[CAST('0x' || substring({h}, 2 * CAST(i AS BIGINT) - 1, 2) AS UBIGINT) FOR i IN range(1, strlen({s}) + 1)]"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {data}), lambda c, b: {bits}), 4294967295)"


def _field(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_RUN = "PARTITION BY g, lev, pos // 8 ORDER BY pos ROWS BETWEEN"
_SIDES = (f"coalesce(string_agg(node, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
          f"coalesce(string_agg(node, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after")
_UP = "sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 7) // 8"

OP13 = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS tampered, {_leaf(lower('text'))} AS low
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM f),
t AS (
  SELECT g, 0 AS lev, pos, leaf AS node, n AS size FROM l
  UNION ALL SELECT g, lev + 1, pos // 8, {_UP} FROM t WHERE size > 1 GROUP BY g, lev, pos // 8),
s AS (SELECT g AS pos, node, count(*) OVER () AS size FROM t WHERE t.size = 1),
u AS (
  SELECT 0 AS g, 0 AS lev, pos, node, size FROM s
  UNION ALL SELECT g, lev + 1, pos // 8, {_UP} FROM u WHERE size > 1 GROUP BY g, lev, pos // 8),
st AS (SELECT g, lev, pos, size, {_SIDES} FROM t),
su AS (SELECT lev, pos, size, {_SIDES} FROM u),
w AS (
  SELECT l.g, l.pos, st.lev, before, after FROM l JOIN st ON st.g = l.g AND st.pos = l.pos // CAST(pow(8, st.lev) AS BIGINT) WHERE st.size > 1
  UNION ALL
  SELECT l.g, l.pos, 1000 + su.lev, before, after FROM l JOIN su ON su.pos = l.g // CAST(pow(8, su.lev) AS BIGINT) WHERE su.size > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY lev) AS step FROM w),
p AS (SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS steps FROM o GROUP BY g, pos),
v AS (
  SELECT g, pos, 0 AS step, CASE WHEN tampered AND low IS NOT NULL THEN low ELSE leaf END AS cur FROM l
  UNION ALL SELECT v.g, v.pos, v.step + 1, sha256(before || cur || after) FROM v JOIN o ON o.g = v.g AND o.pos = v.pos AND o.step = v.step + 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, v.cur AS folded_root, v.cur = r.node AS verified
FROM l JOIN s ON s.pos = l.g CROSS JOIN (SELECT node FROM u WHERE size = 1) r
LEFT JOIN p ON p.g = l.g AND p.pos = l.pos JOIN v ON v.g = l.g AND v.pos = l.pos AND v.step = coalesce(p.steps, 0)
"""

OP12 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all({lower('text')}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT run, n, {crc32("doc_id || ':' || run")} AS h FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, run, count(*) AS n FROM r GROUP BY ALL)),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM d),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT DISTINCT word, n, i, substring(word, 1, CAST(i AS BIGINT)) || substring(word, CAST(i AS BIGINT) + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT DISTINCT word, n, cut FROM x),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION ALL SELECT e.word, e.n, v.word, v.n FROM e JOIN v ON e.cut = v.word
  UNION ALL SELECT v.word, v.n, e.word, e.n FROM e JOIN v ON e.cut = v.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
      FROM v LEFT JOIN b ON v.word = b.word),
w AS (SELECT word, word AS root, form AS next FROM f
      UNION ALL SELECT w.word, w.next, f.form FROM w JOIN f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.next IS NULL
"""
