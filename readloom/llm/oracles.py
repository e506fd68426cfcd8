"""The queries of this subpackage that SQL can express, as DuckDB SQL over the same tables, whole."""

from __future__ import annotations

from . import secrets
from .url_filter import DAMPING, ROUNDS, RULES, THRESHOLD

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce({{0}}, ''), '{_SPACE}'), lambda x: x <> '')"

NEAREST = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT vec_id AS query_id, e AS own FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(own, e) AS score FROM q JOIN v ON query_id <> vec_id AND len(own) = len(e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, hash(text)) AS row, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT row, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
k AS (SELECT row, p, array_to_string(w[p : p + 19], ' ') AS run FROM p),
r AS (SELECT row, p FROM k QUALIFY row_number() OVER (PARTITION BY run ORDER BY row, p) > 1),
gone AS (SELECT DISTINCT row, unnest(range(p, p + 20)) AS p FROM r),
g AS (SELECT row, list(p) AS gone FROM gone GROUP BY row),
c AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT c.row, string_agg(word, ' ' ORDER BY c.p) AS kept FROM c LEFT JOIN gone ON c.row = gone.row AND c.p = gone.p WHERE gone.p IS NULL GROUP BY c.row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (row) LEFT JOIN kept USING (row)
"""

_SPANS = """{name} AS (SELECT row, unnest(m) AS match, unnest(list_zip(list_transform(range(1, len(m) + 1), lambda i: length(array_to_string(parts[:i], '')) + length(array_to_string(m[:i - 1], ''))), range(1, len(m) + 1))) AS place
    FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS parts FROM d WHERE regexp_matches(text, '{pattern}')))"""


def _secrets() -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    least = secrets.LEAST
    found = ",\n".join(_SPANS.format(name=n, pattern=p) for n, p in (("a", assign), ("k", secrets.ACCESS), ("h", secrets.HEX), ("c", secrets.CANDIDATE)))
    span = lambda kind: f"SELECT row, place[1] AS start, {kind} AS kind, place[1] + length(match) AS stop, match"
    listed = "string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
{found},
base AS ({span(0)} FROM a WHERE length(regexp_extract(match, '{assign}', 2)) >= 6 UNION ALL {span(1)} FROM k UNION ALL {span(2)} FROM h),
t AS (SELECT *, regexp_matches(match, '[0-9]') AS d, regexp_matches(match, '[a-z]') AS l, regexp_matches(match, '[A-Z]') AS u FROM ({span(3)} FROM c)),
e AS (SELECT *, CASE WHEN NOT d AND l AND u THEN {least['letters']} WHEN NOT d OR NOT (l OR u) THEN 99.0 WHEN regexp_matches(match, '^([0-9a-f]+|[0-9A-F]+)$') THEN {least['hex']} WHEN l AND u THEN {least['both cases']} ELSE {least['one case']} END AS least FROM t),
more AS (SELECT row, start, kind, stop, match FROM e WHERE least < 99 AND NOT regexp_matches(match, '{secrets.ALLOW}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = e.row AND b.start < e.stop AND e.start < b.stop)
    AND list_max(list_transform(range(1, length(match) - 18), lambda i: list_aggregate(string_split(substr(match, i, 20), ''), 'entropy'))) >= least),
b AS (SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {listed} AS spans FROM base GROUP BY row),
s AS (SELECT row, {listed} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM d LEFT JOIN b USING (row) LEFT JOIN s USING (row)
"""


def _near_duplicates() -> str:
    words = _WORDS.format("text")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {words} AS w FROM documents),
texts AS (SELECT text, any_value(w) AS w, min(doc_id) AS id, row_number() OVER () AS node FROM d WHERE len(w) > 0 GROUP BY text),
runs AS (SELECT node, array_to_string(w[p : p + 4], ' ') AS run FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM texts)),
bag AS (SELECT node, run, count(*) AS n FROM runs GROUP BY node, run),
size AS (SELECT node, sum(n) AS size FROM bag GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS c FROM bag a JOIN bag b ON a.run = b.run AND a.node < b.node GROUP BY a.node, b.node),
near AS (SELECT a, b FROM common JOIN size x ON a = x.node JOIN size y ON b = y.node WHERE c / (x.size + y.size - c) >= 0.8),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT node AS a, node AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
top AS (SELECT a AS node, min(b) AS class FROM reach GROUP BY a),
placed AS (SELECT d.doc_id, class FROM d LEFT JOIN texts USING (text) LEFT JOIN top USING (node)),
class AS (SELECT class, min(doc_id) AS class_id, count(*) AS class_size FROM placed WHERE class IS NOT NULL GROUP BY class)
SELECT doc_id, CASE WHEN class IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(class_size, 1) AS class_size FROM placed LEFT JOIN class USING (class)
"""


def _url_filter() -> str:
    by_length = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in by_length]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, by_length, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, by_length, strict=True))
    link = r"(?i)href\s*=\s*[\"'']?\s*(?:https?:)?//([^/?#\"''<>\s]+)"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
r AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS node, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM p),
seed AS (SELECT node AS host, avg(CASE WHEN ruled = 'allow' THEN 1 WHEN ruled = 'block' THEN 0 END) AS good, avg(CASE WHEN ruled = 'block' THEN 1 WHEN ruled = 'allow' THEN 0 END) AS bad FROM r WHERE node <> '' GROUP BY node),
a AS (SELECT DISTINCT node AS host FROM r WHERE node <> ''),
l AS (SELECT src, regexp_replace(translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^.*@|:[0-9]*$', '', 'g') AS dst FROM (SELECT node AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM r WHERE node <> '')),
up AS (SELECT DISTINCT array_to_string(s[k:], '.') AS child, array_to_string(s[k + 1:], '.') AS parent FROM (SELECT s, unnest(range(1, len(s) - 1)) AS k FROM (SELECT string_split(host, '.') AS s FROM a) WHERE len(s) > 2)),
edge AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY src, dst UNION ALL SELECT child, parent, 1 FROM up UNION ALL SELECT parent, child, 1 FROM up) GROUP BY src, dst),
walk AS (SELECT 'good' AS walk, src, dst, n FROM edge UNION ALL SELECT 'bad', dst, src, n FROM edge),
share AS (SELECT walk, src, dst, n / sum(n) OVER (PARTITION BY walk, src) AS share FROM walk),
start AS (SELECT 'good' AS walk, host, good / (SELECT sum(good) FROM seed) AS v FROM seed WHERE good > 0 UNION ALL SELECT 'bad', host, bad / (SELECT sum(bad) FROM seed) FROM seed WHERE bad > 0),
step AS (SELECT 0 AS k, walk, host, v FROM start
    UNION ALL SELECT s.k + 1, s.walk, e.dst, sum({DAMPING} * s.v * e.share) FROM step s JOIN share e ON s.walk = e.walk AND s.host = e.src WHERE s.k < {ROUNDS} GROUP BY s.k, s.walk, e.dst),
ranked AS (SELECT host, coalesce(sum({1 - DAMPING} * v) FILTER (walk = 'good'), 0) AS trust, coalesce(sum({1 - DAMPING} * v) FILTER (walk = 'bad'), 0) AS distrust FROM step GROUP BY host),
judged AS (SELECT host AS node, CASE WHEN distrust > {THRESHOLD} * trust + (SELECT sum(distrust) FROM ranked) / (SELECT count(*) FROM ranked) THEN 'block' ELSE 'allow' END AS verdict FROM ranked)
SELECT page_id, host, path, rule, coalesce(ruled, verdict, 'allow') AS verdict FROM r LEFT JOIN judged USING (node)
"""


_INTEGERS = """v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

HARD_NEGATIVES = f"""
WITH {_INTEGERS.format(scale=256, label='CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END')},
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND b.label IS NOT NULL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

EXACT_SEARCH = f"""
WITH {_INTEGERS.format(scale=1024, label='NULL')},
q AS (SELECT DISTINCT vec_id AS query_id, e AS own FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(list_inner_product(own, e) AS BIGINT) AS score FROM q JOIN v ON query_id <> vec_id AND len(own) = len(e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": NEAREST, "op4_near_duplicates": _near_duplicates(), "op7_url_filter": _url_filter(), "op9_repeats": REPEATS, "op10_secrets": _secrets(), "op11_hard_negatives": HARD_NEGATIVES, "op13_exact_search": EXACT_SEARCH}
