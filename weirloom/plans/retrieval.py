"""Retrieval queries: candidates, fusion, scopes, gates, reranking, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.functions import text as T
from weirloom.functions import vector
from weirloom.operators import ivf, postings, recovery, trigrams
from weirloom.operators import retrieve as R
from weirloom.plans.registry import query, table
from weirloom.sources.sinks import scratch

#: Row i of the embeddings is the vector of document i, and of query i; every document and every benchmark row takes part, with or without a vector.
_CORPUS = "corpus AS (SELECT d.doc_id, d.text, d.lang AS kb, e.embedding AS vec FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"
_QUERIES = "queries AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding AS query_vec FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"
_VECTOR = "v AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(list_cosine_similarity(query_vec::DOUBLE[], vec::DOUBLE[]), 9) AS score FROM queries, corpus WHERE query_vec IS NOT NULL AND vec IS NOT NULL)) WHERE rank <= 20)"
_KEYWORD = """t AS (SELECT query_id, list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda t: t <> '') AS tokens FROM queries),
k AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, len(list_filter(tokens, lambda t: contains(lower(text), t))) / len(tokens)::DOUBLE AS score FROM t, corpus) WHERE score > 0) WHERE rank <= 20)"""
_FUSED = """u AS (SELECT *, 'vector' AS source FROM v UNION ALL SELECT *, 'keyword' FROM k),
f AS MATERIALIZED (SELECT query_id, doc_id, round(sum(CASE WHEN source = 'keyword' THEN 0.8 ELSE 1.0 END::DOUBLE / (60 + rank)), 9) AS score, count(*) AS hits, min(source) AS one, string_agg(source || ':' || rank, ',' ORDER BY source || ':' || rank) AS contributions FROM u GROUP BY query_id, doc_id),
fused AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, hits, contributions, CASE WHEN hits > 1 THEN 'hybrid' ELSE one END AS match_type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10)"""
_ALL = f"WITH {_CORPUS}, {_QUERIES}, {_VECTOR}, {_KEYWORD}, {_FUSED}"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = R.spread(table(spark, sf, "documents")), table(spark, sf, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select("doc_id", "text", F.col("lang").alias("kb"), "source", F.col("embedding").alias("vec"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    items, vectors = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return items.join(vectors, items.item_id == vectors.vec_id, "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vec"))


def lists(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    q, c = queries(spark, sf), corpus(spark, sf)
    vectors = R.vector_top(q, c, k).withColumn("source", F.lit("vector"))
    return vectors.unionByName(R.keyword_top(q, c, k).withColumn("source", F.lit("keyword")))


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(lists(spark, sf), 10)


@query("t1_vector_topk", f"WITH {_CORPUS}, {_QUERIES}, {_VECTOR} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM v")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.vector_top(queries(spark, sf), corpus(spark, sf), 20).withColumn("score", F.round("score", 6))


@query("t3_keyword_topk", f"WITH {_CORPUS}, {_QUERIES}, {_KEYWORD} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM k")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyword_top(queries(spark, sf), corpus(spark, sf), 20).withColumn("score", F.round("score", 6))


#: The graph's entities: a document mentions its three longest words of six letters or more; a query names the entities that are among its words.
_GRAPH = """ent AS (SELECT doc_id, unnest(list_transform((list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) >= 6)), lambda w: lpad((1000 - least(length(w), 999))::varchar, 4, '0') || w)))[1:3], lambda w: w[5:])) AS entity FROM documents),
named AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}]+'), lambda w: length(w) >= 6))) AS entity FROM queries),
hit AS (SELECT DISTINCT query_id, doc_id FROM named JOIN ent USING (entity)),
ctx AS (SELECT query_id, 'entities: ' || string_agg(DISTINCT entity, ', ' ORDER BY entity) AS context FROM named SEMI JOIN ent USING (entity) GROUP BY query_id),
b AS (SELECT f.query_id, f.doc_id, CASE WHEN h.doc_id IS NOT NULL THEN round(least(1.0, f.score * 1.2), 9) ELSE f.score END AS score, f.hits, f.contributions, CASE WHEN h.doc_id IS NOT NULL THEN 'hybrid' ELSE f.match_type END AS match_type FROM fused f LEFT JOIN hit h ON h.query_id = f.query_id AND h.doc_id = f.doc_id),
boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b),
whole AS (SELECT query_id, doc_id, score, hits, contributions, match_type, rank FROM boosted UNION ALL SELECT c.query_id, NULL, NULL, 0, c.context, 'graph_context', 1 + coalesce((SELECT count(*) FROM boosted x WHERE x.query_id = c.query_id), 0) FROM ctx c)"""
_GRAPHED = f"{_ALL}, {_GRAPH}"


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, entity) of the graph's mentions."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 6))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), 1, 3)
    return docs.select("doc_id", F.explode(F.transform(longest, lambda x: x["w"])).alias("entity"))


def named(q: DataFrame) -> DataFrame:
    """(query_id, entity) of the words by which queries may name entities."""
    return q.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 6))).alias("entity"))


def graph_hits(spark: SparkSession, sf: str) -> DataFrame:
    return named(queries(spark, sf)).join(entities(table(spark, sf, "documents")), "entity").select("query_id", "doc_id").distinct()


def graphed(spark: SparkSession, sf: str) -> DataFrame:
    """The fused list with the graph's boost, and after it a row of context for each query that names entities."""
    boosted = R.boost(hybrid(spark, sf), graph_hits(spark, sf)).select("query_id", "doc_id", "score", "hits", "contributions", "match_type", "rank")
    known = named(queries(spark, sf)).join(entities(table(spark, sf, "documents")).select("entity").distinct(), "entity", "left_semi")
    context = known.groupBy("query_id").agg(F.concat(F.lit("entities: "), F.array_join(F.array_sort(F.collect_set("entity")), ", ")).alias("contributions"))
    rows = context.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("hits"), "contributions", F.lit("graph_context").alias("match_type"), F.lit(None).cast("int").alias("rank"))
    after = F.count("rank").over(Window.partitionBy("query_id")) + 1
    return boosted.unionByName(rows).withColumn("rank", F.coalesce(F.col("rank").cast("long"), after))


@query("q2_hybrid_retrieve", _GRAPHED + " SELECT query_id, doc_id, round(score, 6) AS score, hits, contributions, match_type, rank FROM whole")
def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return graphed(spark, sf).withColumn("score", F.round("score", 6))


@query("q1_semantic_retrieve", f"WITH {_CORPUS}, {_QUERIES}, {_VECTOR} SELECT v.query_id, v.doc_id, c.kb, v.rank FROM v JOIN corpus c USING (doc_id) WHERE rank <= 10")
def semantic_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    return R.vector_top(queries(spark, sf), c, 10).join(c.select("doc_id", "kb"), "doc_id").select("query_id", "doc_id", "kb", "rank")


@query("j6_graph_boost", f"{_GRAPHED} SELECT query_id, doc_id, round(score, 6) AS score, match_type, rank FROM boosted")
def graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    out = R.boost(hybrid(spark, sf), graph_hits(spark, sf))
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "match_type", "rank")


@query("q3_mode_dispatch", _GRAPHED + """, g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM hit)
 SELECT query_id, doc_id, mode FROM (SELECT query_id, doc_id, 'auto' AS mode FROM whole WHERE query_id % 4 = 0 UNION ALL SELECT query_id, doc_id, 'semantic' FROM v WHERE query_id % 4 = 1 AND rank <= 10
 UNION ALL SELECT query_id, doc_id, 'exact' FROM k WHERE query_id % 4 = 2 AND rank <= 10 UNION ALL SELECT query_id, doc_id, 'graph' FROM g WHERE query_id % 4 = 3 AND rank <= 10)""")
def mode_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Queries ask for a mode; here their ids deal them to the four."""
    modes = ("auto", "semantic", "exact", "graph")
    wanted = lambda rows, mode: rows.where(F.pmod("query_id", F.lit(4)) == modes.index(mode)).select("query_id", "doc_id", F.lit(mode).alias("mode"))
    both = lists(spark, sf).where("rank <= 10")
    graph = R.top(graph_hits(spark, sf), 10, ["query_id"], F.asc("doc_id"))
    return wanted(graphed(spark, sf), "auto").union(wanted(both.where("source = 'vector'"), "semantic")).union(wanted(both.where("source = 'keyword'"), "exact")).union(wanted(graph, "graph"))


@query("p1_kb_scope_filter", f"WITH {_CORPUS}, {_QUERIES} SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(list_cosine_similarity(query_vec::DOUBLE[], vec::DOUBLE[]), 9) AS score FROM queries, corpus WHERE kb IN ('fr', 'de') AND query_vec IS NOT NULL AND vec IS NOT NULL)) WHERE rank <= 5")
def kb_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The scope filters the corpus before it is ranked, so no over-fetch is needed."""
    scoped = R.in_scope(corpus(spark, sf), ["fr", "de"], None, [])
    return R.vector_top(queries(spark, sf), scoped, 5).select("query_id", "doc_id", "rank")


@query("p2_request_scope", "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND (doc_id IN (3, 5, 8, 13, 21, 34) OR n_chars IN (3, 5, 8, 13, 21, 34)) AND NOT false")
def request_scope(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "kb")
    some = R.in_scope(docs, ["en", "es"], [3, 5, 8, 13, 21, 34], ["doc_id", "n_chars"])
    return some.union(R.in_scope(docs, None, [], ["doc_id"])).select("doc_id")


@query("p3_similarity_threshold", f"WITH {_CORPUS}, {_QUERIES} SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, round(list_cosine_similarity(query_vec::DOUBLE[], vec::DOUBLE[]), 9) AS score FROM queries, corpus WHERE kb IN ('en') AND query_vec IS NOT NULL AND vec IS NOT NULL) WHERE score >= 0.25")
def similarity_threshold(spark: SparkSession, sf: str) -> DataFrame:
    q, c = queries(spark, sf).where("query_vec IS NOT NULL"), corpus(spark, sf).where("kb IN ('en') AND vec IS NOT NULL")
    pairs = c.join(R.bounded(q)).select("query_id", "doc_id", F.round(vector.cosine(F.col("query_vec"), F.col("vec")), 9).alias("score"))
    return pairs.where("score >= 0.25").withColumn("score", F.round("score", 6))


@query("m1_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("m3_clamp", "SELECT vec_id, round(least(1.0, greatest(0.0, embedding[1]::DOUBLE * 3)), 6) AS clamped FROM embeddings")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get("embedding", 0).cast("double") * 3)), 6).alias("clamped"))


@query("letter_embedding", "SELECT doc_id, " + ", ".join(f"round(len(regexp_extract_all(lower(text), '{c}')) / greatest(1, len(regexp_extract_all(lower(text), '[a-z]')))::DOUBLE, 6) AS f_{c}" for c in "aeqz") + " FROM documents")
def letter_embedding(spark: SparkSession, sf: str) -> DataFrame:
    v = vector.letter_frequencies(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", v.alias("v")).select("doc_id", *(F.round(F.get("v", ord(c) - 97), 6).alias(f"f_{c}") for c in "aeqz"))


@query("t2_approximate_topk")
def approximate_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each query by an index built over all vectors, of which a twentieth of all pairs is compared as vectors."""
    index = ivf.build(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), scratch(spark))
    return ivf.search(queries(spark, sf), index, 10).withColumn("score", F.round("score", 6))


_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"


def _full_text(x: str, text: str, k: int) -> str:
    """CTEs that end in {x}f: the k best documents of each benchmark row whose query is the expression `text`."""
    return f"""{x}q AS (SELECT item_id AS query_id, trim(lower({text})) AS needle, list_distinct({_SPLIT.format(text)}) AS own FROM benchmark), {x}t AS (SELECT query_id, len(own) AS n, unnest(own) AS term FROM {x}q),
{x}h AS (SELECT query_id, n, doc_id FROM {x}t JOIN (SELECT DISTINCT doc_id, term FROM o) USING (term) GROUP BY ALL HAVING count(*) = n),
{x}p AS (SELECT h.query_id, h.n, h.doc_id, o.pos, o.term FROM {x}h h JOIN {x}t USING (query_id) JOIN o ON o.doc_id = h.doc_id AND o.term = {x}t.term),
{x}x AS (SELECT p.query_id, p.doc_id, p.n, p.pos, max(CASE WHEN p.term = t.term THEN p.pos END) OVER (PARTITION BY p.query_id, p.doc_id, t.term ORDER BY p.pos) AS last FROM {x}p p JOIN {x}t t USING (query_id)),
{x}b AS (SELECT query_id, doc_id, n, pos, min(last) AS s FROM {x}x GROUP BY ALL HAVING count(last) = n), {x}c AS (SELECT query_id, doc_id, n, s, min(pos) AS e FROM {x}b GROUP BY ALL),
{x}r AS (SELECT query_id, doc_id, n / (e - s + 1)::DOUBLE AS part FROM {x}c UNION ALL SELECT query_id, doc_id, 0.2 FROM {x}q JOIN documents d ON needle <> '' AND contains(lower(d.text), needle)),
{x}f AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM {x}r GROUP BY ALL)) WHERE rank <= {k})"""


_PLACES = f"o AS MATERIALIZED (SELECT doc_id, unnest(own) AS term, unnest(range(len(own))) AS pos FROM (SELECT doc_id, {_SPLIT.format('text')} AS own FROM documents))"


@query("t4_full_text_rank", f"WITH {_PLACES}, {_full_text('w', 'text', 5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM wf")
def full_text_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all of a query's terms, by cover density, or with the query as it stands."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.rank_all(q, R.spread(table(spark, sf, "documents").select("doc_id", "text")), 5).withColumn("score", F.round("score", 6))


@query("t18_local_rerank", f"""{_ALL}, r AS (SELECT f.query_id, f.doc_id, round(len(list_filter(string_split(lower(q.query), ''), lambda c: contains(lower(c.text), c))) / length(q.query)::DOUBLE / 2, 9) AS score FROM fused f JOIN queries q USING (query_id) JOIN corpus c USING (doc_id))
 SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r""".replace("contains(lower(c.text), c)", "contains(lower(body), c)").replace("JOIN corpus c USING (doc_id)", "JOIN (SELECT doc_id, text AS body FROM corpus) c USING (doc_id)"))
def local_rerank(spark: SparkSession, sf: str) -> DataFrame:
    hits = hybrid(spark, sf).select("query_id", "doc_id").join(R.bounded(queries(spark, sf).select("query_id", "query")), "query_id").join(corpus(spark, sf).select("doc_id", "text"), "doc_id")
    return R.rerank_local(hits, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("t20_rank_scores", _ALL + " SELECT query_id, doc_id, 10 - rank AS source_score, round(1 - 0.1::DOUBLE * (rank - 1), 6) AS tool_score, round(1 - 0.05::DOUBLE * (rank - 1), 6) AS fallback_score FROM fused")
def rank_scores(spark: SparkSession, sf: str) -> DataFrame:
    back = F.col("rank") - 1
    return hybrid(spark, sf).select("query_id", "doc_id", (10 - F.col("rank")).alias("source_score"), F.round(1 - 0.1 * back, 6).alias("tool_score"), F.round(1 - 0.05 * back, 6).alias("fallback_score"))


_LOWQ = """(length(trim(text)) < 40 OR ({sig}) >= 2 OR len(regexp_extract_all(trim(text), '\\p{{L}}')) < 20 OR len(regexp_extract_all(trim(text), '[<>/=]')) > len(regexp_extract_all(trim(text), '\\p{{L}}')) // 2)""".format(sig=" + ".join(f"contains(lower(trim(text)), '{s}')::int" for s in T.BAD_SIGNALS))


#: Of four queries one stays as it is, one asks for the weather, one for an overview of poor evidence, and one has poor evidence only.
_GATED_QUERY = "CASE query_id % 4 WHEN 1 THEN 'weather tomorrow ' || query_id WHEN 2 THEN 'a project overview of ' || query_id ELSE query END"
_GATED_TEXT = "CASE WHEN query_id % 4 >= 2 THEN left(text, 30) ELSE text END"
_OFF = "(contains(lower(query), 'weather') AND NOT (contains(lower(text), 'weather') OR contains(lower(text), 'tomorrow') OR (query_id > 9 AND contains(text, query_id::VARCHAR))))"


@query("p8_evidence_gate", _ALL + f""", e AS (SELECT q.query_id, {_GATED_QUERY.replace('query_id', 'q.query_id').replace('ELSE query', 'ELSE q.query')} AS query, h.doc_id, h.text FROM queries q LEFT JOIN (SELECT f.query_id, f.doc_id, {_GATED_TEXT.replace('query_id', 'f.query_id').replace('text', 'c.text')} AS text FROM fused f JOIN corpus c ON c.doc_id = f.doc_id WHERE f.rank <= 2) h ON h.query_id = q.query_id),
c AS (SELECT query_id, any_value(query) AS query, count(doc_id) FILTER (WHERE NOT {_LOWQ} AND NOT {_OFF}) AS kept, count(doc_id) FILTER (WHERE {_LOWQ}) AS low, count(doc_id) FILTER (WHERE NOT {_LOWQ} AND {_OFF}) AS off FROM e GROUP BY query_id)
SELECT query_id, kept, CASE WHEN contains(lower(query), 'project overview') AND kept = 0 THEN 'insufficient_project_context' WHEN kept > 0 THEN 'ok' WHEN off > 0 AND low = 0 THEN 'irrelevant_evidence' ELSE 'low_quality_evidence' END AS status FROM c""")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of good evidence decide a query's status, of which each of the four occurs; queries without evidence keep a row."""
    found = hybrid(spark, sf).where("rank <= 2").join(corpus(spark, sf).select("doc_id", "text"), "doc_id").withColumn("text", F.expr(_GATED_TEXT))
    return recovery.gate(queries(spark, sf).withColumn("query", F.expr(_GATED_QUERY)), found)


@query("a19_context_build", _ALL + " SELECT query_id, string_agg('[' || rank || '] ' || left(c.text, 80), chr(10) ORDER BY rank) AS context FROM fused f JOIN corpus c USING (doc_id) WHERE rank <= 3 GROUP BY query_id")
def context_build(spark: SparkSession, sf: str) -> DataFrame:
    rows = hybrid(spark, sf).where("rank <= 3").join(corpus(spark, sf).select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left("text", F.lit(80)))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


@query("q9_rag_pipeline", _ALL + f", r AS (SELECT f.query_id, f.doc_id, c.text, row_number() OVER (PARTITION BY f.query_id ORDER BY round(len(list_filter(string_split(lower(q.query), ''), lambda x: contains(lower(c.text), x))) / length(q.query)::DOUBLE / 2, 9) DESC, f.doc_id) AS rank FROM fused f JOIN queries q USING (query_id) JOIN corpus c USING (doc_id)) SELECT query_id, count(*) AS n_sources, string_agg(doc_id::varchar, ',' ORDER BY rank) AS sources FROM r WHERE NOT {_LOWQ} AND rank <= 5 GROUP BY query_id")
def rag_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieve, rerank, gate and list the sources that a generator would get; the generator itself is a function of the caller's."""
    hits = hybrid(spark, sf).select("query_id", "doc_id").join(R.bounded(queries(spark, sf).select("query_id", "query")), "query_id").join(corpus(spark, sf).select("doc_id", "text"), "doc_id")
    rows = R.rerank_local(hits, 5).where(~T.low_quality(F.col("text")))
    return rows.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("sources"))


#: Rewritings of a query: as it is, its first two words, its two longest words, its longest word.
_WORDS = "string_split(trim(text), ' ')"
_LONGEST = f"list_sort(list_transform(list_distinct({_WORDS}), lambda w: lpad((10000 - length(w))::VARCHAR, 5, '0') || w))"
_REWRITES = ["text", f"array_to_string({_WORDS}[1:2], ' ')", f"array_to_string(list_transform(({_LONGEST})[1:2], lambda w: w[6:]), ' ')", f"({_LONGEST})[1][6:]"]

_TRIES = ["w1", "w2", "w3", "w4"]


def _longest(n: int):
    def rewrite(query: Column) -> Column:
        words = F.array_sort(F.transform(F.array_distinct(F.split(F.trim(query), " ")), lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
        return F.array_join(F.transform(F.slice(words, 1, n), lambda x: x["w"]), " ")

    return rewrite


def _first(query: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(query), " "), 1, 2), " ")


def attempts(spark: SparkSession, sf: str) -> list[recovery.Attempt]:
    docs = R.spread(table(spark, sf, "documents").select("doc_id", "text"))
    c = corpus(spark, sf)
    exact = lambda q: postings.rank_all(q, docs, 3)
    as_is = lambda q: q
    return [*(recovery.Attempt("exact", f, exact) for f in (as_is, _first, _longest(2), _longest(1))), recovery.Attempt("semantic", as_is, lambda q: R.vector_top(q, c, 3))]


_GOOD = f"good AS MATERIALIZED (SELECT doc_id FROM documents WHERE NOT {_LOWQ})"


@query("q11_recovery_attempts", f"WITH {_CORPUS}, {_QUERIES}, {_VECTOR}, {_PLACES}, {', '.join(_full_text(x, text, 3) for x, text in zip(_TRIES, _REWRITES))}, {_GOOD}, tries AS (" + " UNION ALL ".join(f"SELECT query_id, {i} AS attempt, 'exact' AS mode, doc_id, rank FROM {x}f" for i, x in enumerate(_TRIES, 1)) + """ UNION ALL SELECT query_id, 5, 'semantic', doc_id, rank FROM v WHERE rank <= 3),
m AS (SELECT query_id, attempt, mode, count(g.doc_id) AS kept, array_to_string(list(t.doc_id ORDER BY rank), ',') AS sources FROM tries t LEFT JOIN good g USING (doc_id) GROUP BY ALL HAVING count(g.doc_id) > 0), w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY attempt) = 1)
SELECT b.item_id AS query_id, attempt, mode, coalesce(kept, 0) AS kept, CASE WHEN attempt IS NULL THEN 'low_quality_evidence' ELSE 'ok' END AS status, coalesce(sources, '') AS sources FROM benchmark b LEFT JOIN w ON w.query_id = b.item_id""")
def recovery_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Five attempts at each query, exact ones of ever fewer words, then by vector; the first with good evidence answers."""
    out = recovery.recover(queries(spark, sf), table(spark, sf, "documents"), attempts(spark, sf))
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query("q12_query_decomposition", "SELECT item_id, unnest(CASE WHEN len(p) >= 2 THEN p[1:4] ELSE [text] END) AS sub FROM (SELECT item_id, text, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM benchmark)")
def decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Two to four sub-queries from a model's answer; here the commas stand in for the model. Without them, the query itself."""
    parts = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.when(F.size(parts) >= 2, F.slice(parts, 1, 4)).otherwise(F.array("text"))).alias("sub"))


@query("q14_knowledge_tool", _ALL + ", b AS (SELECT query_id, rank, left(c.text, 300) AS t, sum(octet_length(encode(left(c.text, 300)))) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM fused f JOIN corpus c USING (doc_id)) SELECT query_id, count(*) AS n, sum(octet_length(encode(t)))::BIGINT AS bytes FROM b WHERE total <= 900 OR rank = 1 GROUP BY query_id")
def knowledge_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped documents in rank order until the byte budget would be passed; the first always."""
    rows = hybrid(spark, sf).join(corpus(spark, sf).select("doc_id", F.left("text", F.lit(300)).alias("clip")), "doc_id")
    running = F.sum(F.octet_length("clip")).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = rows.withColumn("total", running).where("total <= 900 OR rank = 1")
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("clip")).alias("bytes"))


@query("w1_source_ranks", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def source_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.numbered(table(spark, sf, "documents").select("source", "doc_id", (-F.col("n_chars")).alias("less")), ["source"], "less", "doc_id")
    return rows.select("source", "doc_id", F.col("n").alias("rank"))


@query("w15_first_seen", "SELECT doc_id, lang, key FROM (SELECT doc_id, lang, key, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) AS rn FROM (SELECT doc_id, lang, CASE WHEN n_chars % 7 = 0 THEN '' ELSE (n_chars % 100)::varchar END AS key FROM documents)) WHERE rn = 1 OR key = ''")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("n_chars") % 7 == 0, "").otherwise((F.col("n_chars") % 100).cast("string"))
    return R.first_seen(table(spark, sf, "documents").select("doc_id", "lang", key.alias("key")), ["lang"], "key", "doc_id", True)


@query("w16_first_seen_capped", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM (SELECT lang, min(doc_id) AS doc_id FROM documents WHERE n_chars % 7 <> 0 GROUP BY lang, n_chars % 100)) WHERE n <= 8")
def first_seen_capped(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("n_chars") % 7 == 0, "").otherwise((F.col("n_chars") % 100).cast("string"))
    rows = R.first_seen(table(spark, sf, "documents").select("doc_id", "lang", key.alias("key")), ["lang"], "key", "doc_id", False)
    return R.top(rows, 8, ["lang"], F.asc("doc_id")).select("lang", "doc_id")


@query("u1_union_first_seen", _ALL + " SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM (SELECT query_id, doc_id, min(o) AS o FROM (SELECT query_id, doc_id, rank AS o FROM v UNION ALL SELECT query_id, doc_id, 100 + rank FROM k) GROUP BY query_id, doc_id)) WHERE n <= 25")
def union_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    order = F.col("rank") + F.when(F.col("source") == "keyword", 100).otherwise(0)
    rows = lists(spark, sf).groupBy("query_id", "doc_id").agg(F.min(order).alias("o"))
    return R.top(rows, 25, ["query_id"], F.asc("o")).select("query_id", "doc_id")


@query("j12_rerank_backmap", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN round(1.0 / (1 + n_chars), 6) ELSE 0 END AS score FROM documents")
def rerank_backmap(spark: SparkSession, sf: str) -> DataFrame:
    first = F.col("doc_id") == F.min("doc_id").over(Window.partitionBy(F.sha2("text", 256)))
    return table(spark, sf, "documents").select("doc_id", F.when(first, F.round(1.0 / (1 + F.col("n_chars")), 6)).otherwise(0.0).alias("score"))


@query("j17_query_corpus_pairs", f"WITH {_CORPUS}, {_QUERIES} SELECT query_id, count(*) AS n, round(max(list_cosine_similarity(query_vec::DOUBLE[], vec::DOUBLE[])), 6) AS best FROM queries, corpus WHERE query_vec IS NOT NULL AND vec IS NOT NULL GROUP BY query_id")
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).where("vec IS NOT NULL").join(R.bounded(queries(spark, sf).where("query_vec IS NOT NULL"))).select("query_id", vector.cosine(F.col("query_vec"), F.col("vec")).alias("c"))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("c"), 6).alias("best"))


@query("t5_repository_keywords", "SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rn FROM (SELECT b.item_id, d.doc_id, (length(d.text) - length(replace(lower(d.text), lower(b.text), ''))) // length(b.text) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '')) WHERE rn <= 10")
def repository_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a whole benchmark text, by how often. Candidates come from the rarest trigrams."""
    q = table(spark, sf, "benchmark").where("text <> ''").select("item_id", F.lower("text").alias("needle"))
    docs = R.spread(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")))
    found = trigrams.containing(q, docs).withColumnRenamed("text", "lower")
    times = F.floor((F.char_length("lower") - F.char_length(F.replace("lower", "needle", F.lit("")))) / F.char_length("needle"))
    return R.top(found.select("item_id", "doc_id", times.alias("n")), 10, ["item_id"], F.desc("n"), F.asc("doc_id")).select("item_id", "doc_id")
