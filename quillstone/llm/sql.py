"""The operators' results in SQL, where SQL can express them."""

from quillstone.llm.url_filters import HOST_RULES, PATTERNS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(CAST(doc_id AS VARCHAR)) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, CASE n % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, row_number() OVER o AS k,
         (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT x.level FROM l x WHERE x.level * x.weight <= x.cap ORDER BY x.k LIMIT 1) * weight, cap)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(pos + size, goal % source_size) - pos) END::BIGINT AS taken
FROM p
"""

_PERCENTS = (25, 50, 75, 90, 99)


def _cell(x: str) -> str:
    """A value cut to a multiple of its range's step."""
    ends = ((16, 1 / 1024), (256, 1 / 64), (4096, 1 / 4), (65536, 4), (1048576, 64))
    return "CASE " + " ".join(f"WHEN {x} < {end} THEN floor({x} / {step}::DOUBLE) * {step}::DOUBLE" for end, step in ends) + f" ELSE floor({x} / 1024) * 1024 END"


_QUANTILES = ", ".join(f"list_sort(list({_cell(x)}))[({p} * count(*) + 99) // 100] AS {x}_{p}" for x in ("a", "b", "c", "d") for p in _PERCENTS)
_CHOSEN = ", ".join(f"CASE WHEN o.n >= 100 THEN o.{x}_{p} WHEN g.n >= 100 THEN g.{x}_{p} ELSE z.{x}_{p} END AS {x}_{p}" for x in ("a", "b", "c", "d") for p in _PERCENTS)

OP3 = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g3 AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g3) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), f AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM t LEFT JOIN r ON t.doc_id = r.doc_id
), x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars::DOUBLE / greatest(n_words, 1) AS a, n_symbols::DOUBLE / greatest(n_words, 1) AS b,
         n_dup_lines::DOUBLE / greatest(n_lines, 1) AS c, n_repeat_words::DOUBLE / greatest(n_words, 1) AS d FROM f
), o AS (SELECT lang, source, count(*) AS n, {_QUANTILES} FROM x WHERE NOT base_failed GROUP BY lang, source),
g AS (SELECT lang, count(*) AS n, {_QUANTILES} FROM x WHERE NOT base_failed GROUP BY lang),
z AS (SELECT count(*) AS n, {_QUANTILES} FROM x WHERE NOT base_failed),
q AS (SELECT o.lang, o.source, {_CHOSEN} FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND a >= a_25 - 4 * greatest(a_75 - a_25, 0.05::DOUBLE) AND a <= a_75 + 4 * greatest(a_75 - a_25, 0.05::DOUBLE)
         AND b <= b_90 + 3 * greatest(b_90 - b_50, 0.01::DOUBLE) AND c <= c_99 + 2 * greatest(c_99 - c_50, 0.02::DOUBLE) AND d <= d_99 + 2 * greatest(d_99 - d_50, 0.02::DOUBLE), false) AS kept
FROM x LEFT JOIN q ON x.lang IS NOT DISTINCT FROM q.lang AND x.source IS NOT DISTINCT FROM q.source
"""

_COMPONENTS = """reach AS (
  SELECT a AS id, b AS r FROM p UNION SELECT reach.id, p.b FROM reach JOIN p ON p.a = reach.r
), c AS (SELECT id, min(r) AS low FROM reach GROUP BY id)"""

OP1 = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), [true])
), p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.e, y.e) / (sqrt(x.n) * sqrt(y.n)) >= 0.98
), {_COMPONENTS}
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, coalesce(c.low, e.vec_id) >= e.vec_id AS kept, coalesce(k.n, 1)::BIGINT AS n_copies
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id
LEFT JOIN (SELECT vec_id, count(*) OVER (PARTITION BY label, e) AS n FROM v WHERE n > 0) k ON k.vec_id = e.vec_id
"""

OP2 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), {_COMPONENTS}
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(c.low, t.doc_id)) AS component_id, coalesce(c.low, t.doc_id) >= t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.id = t.doc_id
"""

_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf(chars: str) -> str:
    values = [f"CAST({chars if c == 'n_chars' else c} AS VARCHAR)" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
#: Lone nodes of several levels are hashed alone; a tree ends where one node is left.
_UP = "SELECT {g} l + 1, i // 2, sha256(h || coalesce(nx, '')), (c + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY {p} ORDER BY i) AS nx FROM {t} WHERE c > 1) WHERE i % 2 = 0"
OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS told FROM documents
), d0 AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d
), t AS (
  SELECT g, 0 AS l, pos AS i, leaf AS h, n AS c FROM d0 UNION ALL {_UP.format(g='g,', p='g', t='t')}
), s0 AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE c = 1
), u AS (
  SELECT 0 AS l, pos AS i, subroot AS h, n AS c FROM s0 UNION ALL {_UP.format(g='', p='1', t='u')}
), f AS (
  SELECT doc_id, pos, g, 0 AS l, pos AS i, n AS c, '' AS proof, coalesce(told, leaf) AS h FROM d0
  UNION ALL
  SELECT f.doc_id, f.pos, f.g, f.l + 1, f.i // 2, (f.c + 1) // 2, proof || coalesce(x.h, ''),
         sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(x.h, '') ELSE x.h || f.h END)
  FROM f LEFT JOIN t x ON x.g = f.g AND x.l = f.l AND x.i = xor(f.i, 1) WHERE f.c > 1
), e AS (
  SELECT f.doc_id, f.pos, f.g, 0 AS l, s0.pos AS i, s0.n AS c, proof, f.h FROM f JOIN s0 ON s0.g = f.g WHERE f.c = 1
  UNION ALL
  SELECT e.doc_id, e.pos, e.g, e.l + 1, e.i // 2, (e.c + 1) // 2, proof || coalesce(x.h, ''),
         sha256(CASE WHEN e.i % 2 = 0 THEN e.h || coalesce(x.h, '') ELSE x.h || e.h END)
  FROM e LEFT JOIN u x ON x.l = e.l AND x.i = xor(e.i, 1) WHERE e.c > 1
)
SELECT d0.doc_id, leaf, subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM d0 JOIN e ON e.g = d0.g AND e.pos = d0.pos AND e.c = 1 JOIN s0 ON s0.g = d0.g, (SELECT h FROM u WHERE c = 1) r
"""

_HOSTS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in HOST_RULES)
_PATTERNS = ", ".join(f"('{p}')" for p in PATTERNS)
_ESCAPED = r"regexp_replace(ltrim(replace(pattern, '@@', ''), '|'), '([^A-Za-z0-9%/\-])', '\\\1', 'g')"
#: Every rule on every URL.
OP11 = rf"""
WITH x AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, strpos(coalesce(url, ''), '://') AS s FROM pages
), y AS (
  SELECT page_id, url, low, CASE WHEN s > 0 THEN regexp_extract(low[s + 3 :], '^[^/?#]*') ELSE '' END AS host, CASE WHEN s > 0 THEN url[s + 3 :] ELSE '' END AS rest FROM x
), u AS (
  SELECT page_id, url, low, host, regexp_extract(rest[length(host) + 1 :], '^[^?#]*') AS path FROM y
), h AS (SELECT * FROM (VALUES {_HOSTS}) AS v(action, rule_host, rule_path)), r AS (
  SELECT pattern, CASE WHEN starts_with(pattern, '@@') THEN 'allow' ELSE 'block' END AS action,
         CASE WHEN pattern LIKE '||%' OR pattern LIKE '@@||%' THEN '^(?s:.*?)://(?:[^/?#]*\.)?' WHEN pattern LIKE '|%' OR pattern LIKE '@@|%' THEN '^' ELSE '' END ||
         regexp_replace(replace(replace({_ESCAPED}, '\*', '(?s:.*)'), '\^', '(?:^|[^a-z0-9%]|\z)'), '\\\|$', '\\z') AS regex FROM (VALUES {_PATTERNS}) AS v(pattern)
), a AS (
  SELECT DISTINCT ON (url) url, rule_host || rule_path AS rule, action FROM u JOIN h ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY url, length(rule_host || rule_path) DESC, length(rule_host) DESC, action
), b AS (
  SELECT DISTINCT ON (url) url, pattern, r.action FROM u JOIN r ON regexp_matches(low, regex) ORDER BY url, r.action, length(pattern) DESC, encode(pattern)
)
SELECT page_id, host, path, rule, coalesce(a.action, b.action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM u LEFT JOIN a ON a.url = u.url LEFT JOIN b ON b.url = u.url
"""


def _round(r: int) -> str:
    """Assignments to centroids c{r}, and from their means (whole, rounded down) the next centroids."""
    return f"""d{r} AS MATERIALIZED (
  SELECT v.vec_id, v.pos, v.x, c.n AS cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c
), a{r} AS MATERIALIZED (
  SELECT vec_id, pos, x, cluster, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY d, cluster) = 1
), m{r} AS (
  SELECT cluster, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS k FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{r}) GROUP BY cluster, i
), c{r + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY cluster) m ON m.cluster = c.n
)"""


OP12 = f"""
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(least(greatest(64 * x::DOUBLE, -134217728.0), 134217728.0))::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), [true])
), v AS MATERIALIZED (
  SELECT vec_id, x, row_number() OVER () AS pos FROM w
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS n, x FROM v QUALIFY n < 16
), {", ".join(map(_round, range(4)))}
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 c ON c.n = a3.cluster
"""
