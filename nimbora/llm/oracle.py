"""SQL of the operators whose arithmetic SQL can spell out: manifest, fingerprints, vector codes."""

from __future__ import annotations

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang"))

#: CRC-32 of the decimal doc_id, bit by bit: each byte is followed by seven zeros.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_CRC} % 7 = 0 AS hit FROM documents),
leaf AS (SELECT doc_id, lang, sha256({_LEAF} || {_FIELD.format("n_chars")} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN hit AND n_chars IS NOT NULL THEN sha256({_LEAF} || {_FIELD.format("(n_chars + 1)")} || {_FIELD.format("text")}) END AS altered FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM ranked
      UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gpos FROM t WHERE n = 1),
g AS (SELECT 0 AS lvl, gpos AS pos, subroot AS h, count(*) OVER () AS n FROM sub
      UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM g WHERE n > 1 GROUP BY lvl, pos // 2),
places AS (SELECT r.lang, r.pos, sub.subroot, sub.gpos FROM ranked r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang),
steps AS (SELECT p.lang, p.pos, s.lvl AS step, (p.pos // (1::BIGINT << s.lvl)) % 2 AS side, coalesce(o.h, '') AS other
          FROM places p JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) s ON p.lang IS NOT DISTINCT FROM s.lang
          LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lvl = s.lvl AND o.pos = xor(p.pos // (1::BIGINT << s.lvl), 1::BIGINT)
          UNION ALL SELECT p.lang, p.pos, 1000 + s.lvl, (p.gpos // (1::BIGINT << s.lvl)) % 2, coalesce(o.h, '')
          FROM places p CROSS JOIN (SELECT DISTINCT lvl FROM g WHERE n > 1) s
          LEFT JOIN g o ON o.lvl = s.lvl AND o.pos = xor(p.gpos // (1::BIGINT << s.lvl), 1::BIGINT)),
proofs AS (SELECT lang, pos, list(side::VARCHAR || other ORDER BY step) AS path, sha256(string_agg(other, '' ORDER BY step)) AS proof FROM steps GROUP BY 1, 2),
told AS (SELECT r.*, sub.subroot, (SELECT h FROM g WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(altered, leaf), coalesce(path, [])), lambda h, x: CASE WHEN x[1] = '0' THEN sha256(h || x[2:]) ELSE sha256(x[2:] || h) END) AS folded_root
         FROM ranked r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proofs p ON r.lang IS NOT DISTINCT FROM p.lang AND r.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM told
"""


def fingerprint_sql(gram: int, window: int, base: int, dropped: int) -> str:
    """Grams of a power of two of code points, doubled; the least of a window packed with its place."""
    steps, width, power = [], 1, base
    while width < gram:
        steps.append(f"s{2 * width} AS (SELECT *, (s{width} * {power}::UHUGEINT + lead(s{width}, {width}) OVER (PARTITION BY k ORDER BY i)) % 18446744073709551616::UHUGEINT AS s{2 * width} FROM s{width})")
        width, power = 2 * width, power * power % (1 << 64)
    powers = ", ".join(f"{pow(base, j, 1 << 64)}::HUGEINT" for j in range(gram))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS own FROM documents),
n AS (SELECT doc_id, own, length(own) AS n_chars, coalesce(lead(own) OVER o, first_value(own) OVER o) AS following FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substring(own, 1, n_chars - n_chars // 3) || substring(following, 1, n_chars // 3) AS new FROM n),
texts AS (SELECT t, md5(t) AS k FROM (SELECT own AS t FROM e UNION SELECT new FROM e)),
codes AS (SELECT k, length(t) AS n, unnest(list_transform(string_split(t, ''), lambda c: unicode(c))) AS code, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM texts WHERE t <> ''),
s1 AS (SELECT k, i, n, code::UHUGEINT AS s1 FROM codes WHERE n >= {gram}),
{", ".join(steps)},
short AS (SELECT k, 0 AS i, (sum(code::HUGEINT * ([{powers}])[n - i]) % 18446744073709551616)::HUGEINT AS h FROM codes WHERE n < {gram} GROUP BY k),
grams AS (SELECT k, i, h // {1 << dropped} AS h FROM (SELECT k, i, s{gram}::HUGEINT AS h FROM s{gram} WHERE i <= n - {gram} UNION ALL SELECT k, i, h FROM short)),
least AS (SELECT k, i, min(h * 4294967296::HUGEINT + (2147483648 - i)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS m, count(*) OVER (PARTITION BY k) AS g FROM grams),
prints AS (SELECT DISTINCT k, (2147483648 - m % 4294967296)::BIGINT AS p, (m // 4294967296)::BIGINT AS h FROM least WHERE i <= greatest(g - {window}, 0)),
told AS (SELECT k, string_agg(p::VARCHAR || ':' || format('{{:x}}', h), ',' ORDER BY p) AS f, list(DISTINCT h) AS hs FROM prints GROUP BY k),
met AS (SELECT e.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.new) AS edited_sha256, coalesce(a.f, '') AS fingerprint, coalesce(b.f, '') AS edited_fingerprint,
        coalesce(a.hs, []) AS x, coalesce(b.hs, []) AS y, coalesce(c.hs, []) AS z
        FROM e LEFT JOIN told a ON a.k = md5(e.own) LEFT JOIN told b ON b.k = md5(e.new) LEFT JOIN told c ON c.k = md5(e.following)),
shared AS (SELECT *, len(list_intersect(x, y)) AS xy, len(list_intersect(x, z)) AS xz FROM met)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE xy / (len(x) + len(y) - xy)::DOUBLE END AS near_edited,
       CASE WHEN len(x) + len(z) = 0 THEN 1.0::DOUBLE ELSE xz / (len(x) + len(z) - xz)::DOUBLE END AS near_next
FROM shared
"""


def codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Lloyd's rounds one after another: each assigns all parts, then moves the entries that have some."""
    away = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))"
    floor = "(s - ((s % c) + c) % c) // c"  # division of integers downwards
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT v.vec_id, v.p, min({away} * {entries} + b.e) AS m FROM v JOIN b{r} b USING (p) GROUP BY 1, 2)")
        if r < rounds:
            steps.append(f"""f{r} AS (SELECT v.p, (a.m % {entries})::INTEGER AS e, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM v JOIN a{r} a ON v.vec_id = a.vec_id AND v.p = a.p),
m{r} AS (SELECT p, e, list({floor} ORDER BY i) AS x FROM (SELECT p, e, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS c FROM f{r} GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x::BIGINT[], b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM k, range({parts}) r(p)),
b0 AS (SELECT p, e, x FROM v JOIN (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', (m % {entries})::BIGINT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM coded JOIN k USING (vec_id)
"""
