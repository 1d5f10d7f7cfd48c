"""The retrieval engine's queries by name, and their SQL, over corpora made from the test tables.

Vector corpus: a passage per embedding, each with one triple (label, co occurs with, bucket of 13 ids);
entity and fact vectors are means of their passages; the passages whose id is divisible by 50 are the
queries, so that queries, entities and facts grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.extraction import clean_entities, doubt, long_enough, valid_triples
from corpusloom.functions.scores import mean_vector, truncated_min_max, unit
from corpusloom.functions.text import PUNCTUATION, SPACES, content_id, extracted_answer, normalize_answer, qa_prompt, text_processing
from corpusloom.operators import graph as G
from corpusloom.operators import retrieval as R
from corpusloom.operators import store as S
from corpusloom.operators.evaluation import CUTS, at_cuts, exact_match, pooled_at_cuts, word_f1
from corpusloom.operators.groups import Corpus, Links, Walk, corpus
from corpusloom.operators.knn import best_scaled
from corpusloom.operators.passages import best_passages
from corpusloom.operators.ranks import ranks
from corpusloom.session import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Rounds of the SQL.
ROUNDS = 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("chunk"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def triples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("p"), "vec_id").alias("chunk"), F.concat(F.lit("label "), "label").alias("s"), F.lit("co occurs with").alias("p"), F.concat(F.lit("bucket "), F.floor(F.col("vec_id") / 13)).alias("o"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))


def fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    means = triples(spark, d).join(vectors(spark, d).select("chunk", "v"), "chunk").groupBy("s", "o").agg(mean_vector(F.col("v")).alias("v"))
    return means.withColumn("fact", F.concat_ws("|", "s", "o"))


BASE = """WITH t AS MATERIALIZED (SELECT 'p' || vec_id AS chunk, vec_id, embedding::DOUBLE[] AS v, 'label ' || label AS s, 'co occurs with' AS p, 'bucket ' || (vec_id // 13) AS o FROM embeddings),
m AS MATERIALIZED (SELECT DISTINCT unnest([s, o]) AS entity, chunk FROM t),
q AS (SELECT vec_id AS query, v AS qv FROM t WHERE vec_id % 50 = 0),
ps AS MATERIALIZED (SELECT query, chunk, list_dot_product(qv, v) AS raw FROM q, t),
fd AS (SELECT s, o, dim, avg(v[dim]) AS x FROM t, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
fv AS (SELECT s, o, list(x ORDER BY dim) AS v FROM fd GROUP BY ALL),
fs AS MATERIALIZED (SELECT query, s, o, s || '|' || o AS fact, list_dot_product(qv, v) AS raw FROM q, fv),
fn AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0::DOUBLE ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM fs WINDOW w AS (PARTITION BY query)),
pn AS (SELECT *, (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) AS score FROM ps WINDOW w AS (PARTITION BY query)),
ft AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(raw, 9) DESC, fact) AS rank FROM fn QUALIFY rank <= 5),
ec AS (SELECT entity, count(*) AS chunks FROM m GROUP BY 1),
pw AS MATERIALIZED (SELECT query, entity, avg(score / chunks) AS weight FROM (SELECT query, score, unnest([s, o]) AS entity FROM ft) JOIN ec USING (entity) GROUP BY ALL),
fe AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM t UNION ALL SELECT o, s FROM t) WHERE src <> dst GROUP BY ALL),
pe AS (SELECT entity AS src, chunk AS dst, 1.0::DOUBLE AS weight FROM m UNION ALL SELECT chunk, entity, 1.0 FROM m),
dd AS (SELECT entity, dim, avg(v[dim] * v[dim]) AS sq, avg(v[dim]) AS mean, count(*) AS n FROM m JOIN t USING (chunk), (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
dv AS (SELECT entity, CASE WHEN max(n) < 2 THEN 0.0::DOUBLE ELSE sum(sq - mean * mean) END AS diversity FROM dd GROUP BY 1),
dq AS (SELECT quantile_cont(diversity, 0.01) AS lo, quantile_cont(diversity, 0.99) AS hi FROM dv),
dn AS MATERIALIZED (SELECT entity, diversity, CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (diversity - lo) / (hi - lo))) END AS norm FROM dv, dq),
rr AS (SELECT query, entity, max(raw) AS relevance FROM m JOIN ps USING (chunk) GROUP BY ALL),
rq AS (SELECT query, quantile_cont(relevance, 0.01) AS lo, quantile_cont(relevance, 0.99) AS hi FROM rr GROUP BY 1),
rn AS MATERIALIZED (SELECT query, entity, relevance, CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (relevance - lo) / (hi - lo))) END AS norm FROM rr JOIN rq USING (query)),
de AS (SELECT query, src, dst, round(b.norm - a.norm, 9) AS delta, round(b.norm - a.norm, 9) > 0 AS up, greatest(1e-6::DOUBLE, rn.norm - abs(round(b.norm - a.norm, 9))) AS score FROM fe JOIN dn a ON a.entity = src JOIN dn b ON b.entity = dst JOIN rn ON rn.entity = dst),
db AS (SELECT *, sum(score) OVER (PARTITION BY query, src, up) AS total, count(*) FILTER (up) OVER (PARTITION BY query, src) AS ups, count(*) FILTER (NOT up) OVER (PARTITION BY query, src) AS downs FROM de),
dw AS MATERIALIZED (SELECT query, src, dst, CASE WHEN up THEN 0.1::DOUBLE WHEN ups = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END * score / total AS weight FROM db UNION ALL SELECT DISTINCT query, src, src, 0.9::DOUBLE FROM db WHERE downs = 0),
rs AS MATERIALIZED (SELECT query, entity AS node, weight AS r FROM pw UNION ALL SELECT query, chunk, 0.08::DOUBLE * score FROM pn)
"""


def ppr_sql(edges: str, keyed: bool) -> str:
    """BASE, then one table expression per round."""
    on = "query, src" if keyed else "src"
    out = BASE + f""", ed AS MATERIALIZED ({edges}),
sh AS MATERIALIZED (SELECT *, weight / sum(weight) OVER (PARTITION BY {on}) AS share FROM ed WHERE weight > 0),
r0 AS MATERIALIZED (SELECT query, node, r / sum(r) OVER (PARTITION BY query) AS rank FROM rs WHERE r > 0)"""
    join = "x.node = sh.src AND x.query = sh.query" if keyed else "x.node = sh.src"
    for k in range(1, ROUNDS + 1):
        out += f""",
r{k} AS MATERIALIZED (SELECT query, node, sum(part) AS rank FROM (SELECT x.query, sh.dst AS node, 0.5::DOUBLE * x.rank * sh.share AS part FROM r{k - 1} x JOIN sh ON {join} UNION ALL SELECT query, node, 0.5::DOUBLE * rank FROM r0) GROUP BY ALL)"""
    return out


@query("SELECT doc_id, 'chunk-' || md5(text) AS chunk_id FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", content_id("chunk-", F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')) AS processed FROM documents")
def processed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text_processing(F.col("text"))).alias("processed"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal_sql(x: str) -> str:
    """SQL of normalize_answer. Every character that is no letter, digit or _ gets marks of its own on both sides, so that articles in a row are all found."""
    plain = f"translate(lower({x}), {quoted(PUNCTUATION)}, '')"
    marked = f"regexp_replace({plain}, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g')"
    freed = f"replace(regexp_replace({marked}, '(^|' || chr(1) || ')(a|an|the)($|' || chr(1) || ')', '\\1 \\3', 'g'), chr(1), '')"
    return f"trim(regexp_replace({freed}, {quoted('[' + SPACES + ']+')}, ' ', 'g'), ' ')"


@query(f"SELECT doc_id, md5({normal_sql('text')}) AS answer FROM documents")
def normalized_answers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_answer(F.col("text"))).alias("answer"))


@query("SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents")
def dedup_chunks(spark, d):
    return S.chunked(table(spark, d, "documents"))


@query("SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def upsert_missing(spark, d):
    docs = table(spark, d, "documents")
    return S.missing(S.chunked(docs), S.chunked(docs.where("doc_id % 3 = 0")))


@query("SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 7 = 0)")
def store_delete(spark, d):
    docs = table(spark, d, "documents")
    return S.deleted(S.chunked(docs), S.chunked(docs.where("doc_id % 7 = 0")))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR ELSE 'No mark ' || conv_id || chr(10) END AS answer FROM conversations")
def answer_extraction(spark, d):
    marked = F.concat(F.lit("Thought: "), "role", F.lit(" Answer:\u00a0\n\t"), F.col("conv_id").cast("string"), F.lit("\x0b\n Answer: other"))
    made = F.when(F.col("turn") % 2 == 0, marked).otherwise(F.concat(F.lit("No mark "), F.col("conv_id").cast("string"), F.lit("\n")))
    return table(spark, d, "conversations").select("conv_id", "turn", extracted_answer(made).alias("answer"))


@query("SELECT conv_id, turn, md5('Wikipedia Title: ' || role || chr(10) || chr(10) || 'Wikipedia Title: ' || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Thought: ') AS prompt FROM conversations")
def prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(qa_prompt(F.array("role", "text", "role"), F.col("text"), 2)).alias("prompt"))


@query(BASE + "SELECT DISTINCT entity FROM m")
def entity_nodes(spark, d):
    return G.mentions(triples(spark, d)).select("entity").distinct()


@query(BASE + "SELECT DISTINCT s, p, o FROM t")
def distinct_facts(spark, d):
    return G.facts(triples(spark, d))


@query(BASE + "SELECT * FROM m")
def mentions(spark, d):
    return G.mentions(triples(spark, d))


@query(BASE + "SELECT * FROM fe")
def fact_edge_counts(spark, d):
    return G.fact_edges(triples(spark, d))


@query(BASE + "SELECT * FROM pe")
def passage_edges_directed(spark, d):
    return G.passage_edges(G.mentions(triples(spark, d)))


@query(BASE + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(weight, src) AS weight FROM fe GROUP BY ALL")
def merge_edges_undirected(spark, d):
    return G.merged_undirected(G.fact_edges(triples(spark, d)))


@query(BASE + "SELECT DISTINCT entity AS src, entity AS dst, 0.0::DOUBLE AS weight FROM m")
def self_loops(spark, d):
    return G.self_loops(G.mentions(triples(spark, d)).select(F.col("entity").alias("node")).distinct(), G.fact_edges(triples(spark, d)))


@query(BASE + "SELECT count(DISTINCT entity) AS entities, count(DISTINCT chunk) AS passages, (SELECT count(*) FROM fe) AS fact_edges, count(*) AS passage_edges FROM m")
def graph_info(spark, d):
    m = G.mentions(triples(spark, d))
    counts = m.agg(F.countDistinct("entity").alias("entities"), F.countDistinct("chunk").alias("passages"), F.count("*").alias("passage_edges"))
    return counts.withColumn("fact_edges", G.fact_edges(triples(spark, d)).agg(F.count("*")).scalar())


@query(BASE + "SELECT entity, round(diversity, 6) AS diversity, round(norm, 6) AS norm FROM dn")
def entity_diversity(spark, d):
    return diversity_of(spark, d).select("entity", F.round("diversity", 6).alias("diversity"), F.round("norm", 6).alias("norm"))


def diversity_of(spark, d):
    return truncated_min_max(G.diversity(G.mentions(triples(spark, d)), vectors(spark, d)), "diversity")


def passages_of(spark, d):
    return R.scored_normal(asked(spark, d), vectors(spark, d), "chunk")


def corpus_of(spark, d) -> Corpus | None:
    return corpus(spark, G.mentions(triples(spark, d)), asked(spark, d), vectors(spark, d))


def relevance_of(spark, d):
    if found := corpus_of(spark, d):
        return found.relevance()
    return truncated_min_max(R.relevance(G.mentions(triples(spark, d)), passages_of(spark, d)), "relevance", "query")


@query(BASE + "SELECT query, chunk, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(raw, 9) DESC, chunk) AS rank FROM pn QUALIFY rank <= 10")
def dense_retrieval(spark, d):
    return R.best_scored(asked(spark, d), vectors(spark, d), "chunk", 10).select("query", "chunk", F.round("score", 6).alias("score"), "rank")


def facts_of(spark, d):
    return R.scored_normal(asked(spark, d), fact_vectors(spark, d), "fact").drop("raw")


@query(BASE + "SELECT query, fact, round(score, 6) AS score FROM fn")
def fact_scores(spark, d):
    return facts_of(spark, d).select("query", "fact", F.round("score", 6).alias("score"))


def picked_of(spark, d):
    return R.best_scored(asked(spark, d), Scratch(spark).save(fact_vectors(spark, d), "facts"), "fact", 5, "s", "o")


@query(BASE + "SELECT query, fact, rank FROM ft")
def fact_topk(spark, d):
    return picked_of(spark, d).select("query", "fact", "rank")


@query(BASE + "SELECT query, entity, round(weight, 6) AS weight FROM pw")
def phrase_weights(spark, d):
    return R.phrase_weights(picked_of(spark, d), G.mentions(triples(spark, d))).select("query", "entity", F.round("weight", 6).alias("weight"))


@query(BASE + "SELECT query, entity, round(relevance, 6) AS relevance, round(norm, 6) AS norm FROM rn")
def entity_relevance(spark, d):
    return relevance_of(spark, d).select("query", "entity", F.round("relevance", 6).alias("relevance"), F.round("norm", 6).alias("norm"))


def seeds_of(spark, d):
    return R.phrase_weights(picked_of(spark, d), G.mentions(triples(spark, d))).select("query", F.col("entity").alias("node"), F.col("weight").alias("r"))


def reset_of(spark, d):
    seeds = seeds_of(spark, d)
    prior = passages_of(spark, d).select("query", F.col("chunk").alias("node"), (0.08 * F.col("score")).alias("r"))
    return seeds.unionByName(prior)


@query(BASE + "SELECT query, node, round(r, 6) AS r FROM rs")
def reset_vector(spark, d):
    return reset_of(spark, d).select("query", "node", F.round("r", 6).alias("r"))


def weights_of(spark, d, edges, **options):
    """R.directed_weights of edges, made where each query's relevance lies."""
    found, div = corpus_of(spark, d), diversity_of(spark, d)
    links = found.directed(edges, div, **options) if found else None
    return found.weights(links) if links else R.directed_weights(edges, div, relevance_of(spark, d), **options)


@query(BASE + "SELECT query, src, dst, round(weight, 6) AS weight FROM dw")
def directed_weights(spark, d):
    return weights_of(spark, d, G.fact_edges(triples(spark, d))).select("query", "src", "dst", F.round("weight", 6).alias("weight"))


UNDIRECTED = "SELECT src, dst, weight FROM fe UNION ALL SELECT * FROM pe"
DIRECTED = "SELECT query, src, dst, weight FROM dw UNION ALL SELECT query, src, dst, weight FROM pe, (SELECT DISTINCT query FROM q)"


def walked_of(spark, d, directed, best=None, among="all"):
    """Ranks by groups of queries, or None where these do not hold."""
    t, found = triples(spark, d), corpus_of(spark, d)
    walk = found.walk(0.08, 0.5, ROUNDS) if found else None
    if not walk:
        return None
    if directed:
        links = found.directed(G.fact_edges(t), diversity_of(spark, d))
    else:
        table = found.links(G.fact_edges(t).where("weight > 0 and not isnan(weight)"), "weight")
        links = None if table is None else Links(found.n, table)
    return found.ranks(links, walk, seeds_of(spark, d), best, among) if links else None


def walked_among_entities(spark, d, best):
    """Directed ranks of entities without passages in the graph, or None where groups do not hold."""
    found = corpus_of(spark, d)
    links = found.directed(G.fact_edges(triples(spark, d)), diversity_of(spark, d)) if found else None
    return found.ranks(links, Walk(None, None, 0.0, 0.5, ROUNDS), seeds_of(spark, d), best, "entities") if links else None


def vanilla_of(spark, d, best=None, among=None):
    t = triples(spark, d)
    return ranks(spark, G.fact_edges(t).unionByName(G.passage_edges(G.mentions(t))), reset_of(spark, d), rounds=ROUNDS, best=best, among=among, nodes=nodes_of(spark, d))


def best_passages_of(spark, d, k):
    """(query, chunk, score): the k best of passages_of, without a row for every pair."""
    best = best_scaled(asked(spark, d).withColumnRenamed("qv", "v"), vectors(spark, d).select(F.col("chunk").alias("item"), "v"), k)
    return best.select("query", F.col("item").alias("chunk"), "score")


def best_vanilla_of(spark, d, best):
    """vanilla_of among passages, by entities alone where that comes to the same."""
    t = triples(spark, d)
    found = best_passages(spark, G.fact_edges(t), G.mentions(t), seeds_of(spark, d), asked(spark, d), vectors(spark, d), 0.08, best, rounds=ROUNDS)
    return vanilla_of(spark, d, best, chunk_nodes(spark, d)) if found is None else found


def nodes_of(spark, d):
    return chunk_nodes(spark, d).union(G.mentions(triples(spark, d)).select("entity"))


def chunk_nodes(spark, d):
    return vectors(spark, d).select(F.col("chunk").alias("node"))


def factors_of(spark, d):
    return R.factors(spark, G.fact_edges(triples(spark, d)), diversity_of(spark, d), relevance_of(spark, d))


def directed_of(spark, d, best=None, among=None):
    return ranks(spark, G.passage_edges(G.mentions(triples(spark, d))), reset_of(spark, d), rounds=ROUNDS, own=factors_of(spark, d), best=best, among=among, nodes=nodes_of(spark, d))


@query(ppr_sql(UNDIRECTED, False) + f"SELECT query, node, round(rank, 6) AS rank FROM r{ROUNDS}")
def ppr_vanilla(spark, d):
    found = walked_of(spark, d, False)
    return (vanilla_of(spark, d) if found is None else found).select("query", "node", F.round("rank", 6).alias("rank"))


@query(ppr_sql(DIRECTED, True) + f"SELECT query, node, round(rank, 6) AS rank FROM r{ROUNDS}")
def ppr_directed(spark, d):
    found = walked_of(spark, d, True)
    return (directed_of(spark, d) if found is None else found).select("query", "node", F.round("rank", 6).alias("rank"))


def top_passages(ranks: DataFrame) -> DataFrame:
    passages = ranks.select("query", F.col("node").alias("chunk"), F.round("rank", 9).alias("by"))
    return R.ranked(passages, "by", "chunk", 10).select("query", "chunk", "rank", F.round("by", 6).alias("score"))


TOP = f"SELECT query, node AS chunk, row_number() OVER (PARTITION BY query ORDER BY round(rank, 9) DESC, node) AS rank_, round(rank, 6) AS score FROM r{ROUNDS} WHERE node IN (SELECT chunk FROM t) QUALIFY rank_ <= 10"


@query(ppr_sql(UNDIRECTED, False) + f"SELECT query, chunk, rank_ AS rank, score FROM ({TOP})")
def graph_retrieval(spark, d):
    return top_passages(best_vanilla_of(spark, d, 10))


@query(ppr_sql(DIRECTED, True) + f"SELECT query, chunk, rank_ AS rank, score FROM ({TOP})")
def graph_retrieval_directed(spark, d):
    found = walked_of(spark, d, True, 10, "passages")
    return top_passages(directed_of(spark, d, 10, chunk_nodes(spark, d)) if found is None else found)


@query(BASE + ", rk AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS rank FROM pn), g AS (SELECT a.vec_id AS query, b.chunk FROM t a JOIN t b ON a.o = b.o WHERE a.vec_id % 50 = 0), h AS (SELECT query, k, count(*) FILTER (rank <= k) / count(*) AS recall, count(*) FILTER (rank <= k) / least(k, any_value(n)) AS precision FROM g JOIN rk USING (query, chunk), (SELECT count(*) AS n FROM t), (SELECT unnest([1, 2, 5, 10, 20, 30, 50, 100, 150, 200])::BIGINT AS k) GROUP BY query, k) SELECT k, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END), 4) AS f1 FROM h GROUP BY k")
def recall_at_k(spark, d):
    s = passages_of(spark, d).select("query", "chunk", F.round("score", 9).alias("score"))
    t = triples(spark, d)
    gold = t.join(asked(spark, d).select("query", F.concat(F.lit("bucket "), F.floor(F.col("query") / 13)).alias("o")), "o").select("query", "chunk")
    return pooled_at_cuts(at_cuts(R.ranked(s, "score", "chunk", max(CUTS)), gold))


@query(BASE + "SELECT DISTINCT entity FROM m WHERE entity NOT IN (SELECT entity FROM m JOIN t USING (chunk) WHERE vec_id // 13 <> 5)")
def delete_cascade_entities(spark, d):
    gone = vectors(spark, d).where("floor(vec_id / 13) = 5").select("chunk")
    return S.orphans(G.mentions(triples(spark, d)), gone, "entity")


RAW = """WITH raw AS (SELECT conv_id, turn, [chr(10) || role || chr(9) || ' ', chr(160), role, 'turn ' || turn, NULL] AS entities, [[role, 'says in', chr(8195) || 'turn ' || turn || chr(10)], [role, 'says'], [role, 'says in', 'turn ' || turn], [role, chr(9), 'x']] AS triples, text FROM conversations)
"""


def raw_extractions(spark: SparkSession, d: str) -> DataFrame:
    turn, none = F.concat(F.lit("turn "), "turn"), F.lit(None).cast("string")
    entities = F.array(F.concat(F.lit("\n"), "role", F.lit("\t ")), F.lit("\u00a0"), F.col("role"), turn, none)
    says = F.lit("says in")
    triples = F.array(F.array(F.col("role"), says, F.concat(F.lit("\u2003"), turn, F.lit("\n"))), F.array(F.col("role"), F.lit("says")), F.array(F.col("role"), says, turn), F.array(F.col("role"), F.lit("\t"), F.lit("x")))
    return table(spark, d, "conversations").select("conv_id", "turn", entities.alias("entities"), triples.alias("triples"), "text")


@query(RAW + "SELECT conv_id, turn, trim(entities[3]) || '|' || entities[4] AS entities FROM raw")
def clean_entity_lists(spark, d):
    return raw_extractions(spark, d).select("conv_id", "turn", F.array_join(clean_entities(F.col("entities")), "|").alias("entities"))


@query(RAW + f"SELECT conv_id, turn, count(DISTINCT s) AS n, string_agg(DISTINCT s, ';') AS triples FROM (SELECT conv_id, turn, array_to_string(list_transform(t, lambda x: trim(x, {quoted(SPACES)})), '|') AS s FROM (SELECT conv_id, turn, unnest(triples) AS t FROM raw) WHERE len(t) = 3 AND len(list_filter(t, lambda x: trim(x, {quoted(SPACES)}) <> '')) = 3) GROUP BY ALL")
def filter_invalid_triples(spark, d):
    t = valid_triples(F.col("triples"))
    return raw_extractions(spark, d).select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.array_join(F.transform(t, lambda x: F.array_join(x, "|")), ";").alias("triples"))


@query("SELECT c_custkey, length(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) > 2 AS long_enough FROM customer")
def entity_guard(spark, d):
    return table(spark, d, "customer").select("c_custkey", long_enough(F.col("c_mktsegment")).alias("long_enough"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'error' WHEN length(text) > 400 THEN 'length' WHEN turn % 3 = 0 THEN 'empty_triples' WHEN turn % 5 >= 4 AND turn % 3 < 2 THEN 'sparse_triples' ELSE '' END AS reason FROM conversations")
def retry_reasons(spark, d):
    finish = F.when(F.length("text") > 400, "length").otherwise("stop")
    return table(spark, d, "conversations").select("conv_id", "turn", doubt(F.col("role") == "system", finish, F.col("turn") % 5, F.col("turn") % 3).alias("reason"))


GOLD = """WITH g AS (SELECT a.conv_id * 1000 + a.turn AS query, b.turn AS pos, b.text AS gold, a.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1),
n AS (SELECT query, pos, %s AS gold, %s AS answer FROM g)
""" % (normal_sql("gold"), normal_sql("answer"))


def gold_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as an answer, with itself and its neighbours as gold."""
    c = table(spark, d, "conversations")
    a = c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("text").alias("answer"), F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("pos"))
    return a.join(c.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("gold")), ["conv_id", "pos"]).select("query", "pos", "gold", "answer")


@query(GOLD + "SELECT query, max(CASE WHEN gold = answer THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact_match FROM n GROUP BY 1")
def answer_exact_match(spark, d):
    return exact_match(gold_answers(spark, d))


@query(GOLD + """, w AS (SELECT query, pos, gold, answer, list_filter(string_split(gold, ' '), lambda x: x <> '') AS g, list_filter(string_split(answer, ' '), lambda x: x <> '') AS a FROM n),
c AS (SELECT query, pos, sum(least(x, y)) AS shared FROM (SELECT query, pos, word, count(*) AS x FROM (SELECT query, pos, unnest(g) AS word FROM w) GROUP BY ALL) JOIN (SELECT query, pos, word, count(*) AS y FROM (SELECT query, pos, unnest(a) AS word FROM w) GROUP BY ALL) USING (query, pos, word) GROUP BY ALL),
f AS (SELECT query, pos, coalesce(shared, 0)::DOUBLE / greatest(len(a), 1) AS p, coalesce(shared, 0)::DOUBLE / greatest(len(g), 1) AS r FROM w LEFT JOIN c USING (query, pos))
SELECT query, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, CASE WHEN p > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM f) QUALIFY row_number() OVER (PARTITION BY query ORDER BY f1 DESC, pos) = 1""")
def answer_f1(spark, d):
    return word_f1(gold_answers(spark, d)).select("query", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT vec_id, array_to_string(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)::DECIMAL(9, 6)), ',') AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def unit_vectors(spark, d):
    v = unit(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(v, lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string")), ",").alias("unit"))


@query(BASE + "SELECT src, dst, weight FROM fe WHERE src LIKE 'label%' AND dst LIKE 'bucket 1%'")
def induced_subgraph(spark, d):
    e = G.fact_edges(triples(spark, d))
    nodes = G.mentions(triples(spark, d)).select(F.col("entity").alias("node")).distinct().where("node like 'label%' or node like 'bucket 1%'")
    return G.induced(e, nodes).where("src like 'label%'")


@query(BASE + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(CASE WHEN src LIKE 'label 1%' OR dst LIKE 'label 1%' THEN 7.0::DOUBLE ELSE weight END) AS weight FROM fe GROUP BY ALL")
def edge_append(spark, d):
    e = G.fact_edges(triples(spark, d)).where("src < dst")
    return G.appended(e.where("dst like 'label 1%' or src like 'label 1%'").withColumn("weight", F.lit(7.0)), e)
