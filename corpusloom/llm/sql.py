"""DuckDB SQL for the training-data queries that SQL can express.

The neighbour search is approximate; on small tables it finds all that this exact SQL finds.
"""

from __future__ import annotations

from corpusloom.llm.url_filter import LINK, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k, vec_id, score FROM pairs
)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM ranked WHERE k <= 5
"""

#: A digest's 32 groups of five bits, each read from two of its hex digits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (strpos('0123456789abcdef', substr(sha, (5 * i // 4 + 1)::INTEGER, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(sha, (5 * i // 4 + 2)::INTEGER, 1)) - 1) // (2 ** (3 - 5 * i % 4))::INTEGER) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

NGRAMS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS grams FROM w
), e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT doc_id AS id, doc_id AS reached FROM s UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.reached = l.a)
SELECT s.doc_id, any_value(len(s.grams))::BIGINT AS n_shingles, min(reached) AS component_id
FROM s JOIN reach ON s.doc_id = reach.id GROUP BY s.doc_id
"""


def url_filter(rules: tuple = RULES, damping: float = 0.85, rounds: int = 30, floor: float = 1e-6) -> str:
    def rest(url: str) -> str:
        return f"CASE WHEN strpos(coalesce({url}, ''), '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"

    def host(url: str) -> str:
        return f"translate(regexp_extract({rest(url)}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"

    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN" for h, p, _ in longest]
    rule = " ".join(f"{f} {quoted(h + p)}" for f, (h, p, _) in zip(fits, longest))
    ruled = " ".join(f"{f} {quoted(v)}" for f, (_, _, v) in zip(fits, longest))
    steps = "".join(
        f"""
, s{k} AS MATERIALIZED (SELECT e.kind, dst AS host, {damping} * sum(rank * share) AS got FROM r{k - 1} r JOIN edges e ON r.kind = e.kind AND r.host = e.src GROUP BY e.kind, dst)
, r{k} AS MATERIALIZED (SELECT kind, host, sum(got) AS rank FROM (
    SELECT * FROM s{k} UNION ALL
    SELECT d.kind, d.host, seed * (1 - coalesce(g.kept, 0)) FROM seeds d LEFT JOIN (SELECT kind, sum(got) AS kept FROM s{k} GROUP BY kind) g ON d.kind = g.kind) GROUP BY kind, host)"""
        for k in range(1, rounds + 1)
    )
    return f"""
WITH u AS (SELECT page_id, html, {host('url')} AS host, regexp_extract({rest('url')}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages)
, seen AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM u)
, found AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, {quoted(LINK)}, 1), lambda x: {host('x')}))) AS dst FROM seen)
, links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)
, both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links)
, edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways)
, hosts AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM seen GROUP BY host)
, chosen AS (SELECT host, CASE WHEN 2 * allowed > n THEN 'trust' WHEN 2 * blocked > n THEN 'distrust' END AS kind FROM hosts WHERE host <> '')
, seeds AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM chosen WHERE kind IS NOT NULL)
, r0 AS MATERIALIZED (SELECT kind, host, seed AS rank FROM seeds){steps}
, ranks AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, seen.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust * (SELECT count(*) FROM seeds WHERE kind = 'distrust') > {floor} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN ranks ON seen.host = ranks.host
"""


AUDIT = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(substr(filter_order, step, 1)) - 65))::INT AS own,
  coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::INT, 1)) - 65))), 0)::INT AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | prior) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own > 0 AND mask & prior = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & prior > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & prior = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own > 0 AND mask & prior = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM c
"""


SQL = {"op1_nn_descent": NEAREST, "op7_warc": WARC, "op8_url_filter": url_filter(), "op9_ngram_jaccard": NGRAMS, "op13_filter_audit": AUDIT}
