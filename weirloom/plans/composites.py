"""Composite queries and variants built from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.functions import text as T
from weirloom.functions import vector
from weirloom.operators import chunking
from weirloom.operators import graph as G
from weirloom.operators import ingest as I
from weirloom.operators import guarded, imports
from weirloom.operators import retrieve as R
from weirloom.plans import graphs, retrieval
from weirloom.plans.registry import query, table

_ALL = retrieval._ALL


@query("a5_rrf_contributions", _ALL + " SELECT query_id, doc_id, round(score, 6) AS score, hits, contributions FROM f")
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Every fused candidate, before the cut."""
    return R.fuse(retrieval.lists(spark, sf), 1_000_000).select("query_id", "doc_id", F.round("score", 6).alias("score"), "hits", "contributions")


@query("j5_full_outer_merge", _ALL + " SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id, v.rank AS vector_rank, k.rank AS keyword_rank FROM v FULL JOIN k ON v.query_id = k.query_id AND v.doc_id = k.doc_id")
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    both = retrieval.lists(spark, sf)
    side = lambda s: both.where(F.col("source") == s).select("query_id", "doc_id", F.col("rank").alias(f"{s}_rank"))
    return side("vector").join(side("keyword"), ["query_id", "doc_id"], "full_outer")


@query("t8_fused_without_blanks", _ALL + ", nb AS (SELECT f.* FROM f JOIN corpus c USING (doc_id) WHERE hits > 1 OR trim(c.text) <> '') SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM nb) WHERE rank <= 10")
def without_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Single-source documents with blank content go before the cut."""
    fused = R.fuse(retrieval.lists(spark, sf), 1_000_000).drop("rank").join(retrieval.corpus(spark, sf).select("doc_id", "text"), "doc_id")
    kept = fused.where((F.col("hits") > 1) | (F.trim("text") != ""))
    return R.top(kept, 10, ["query_id"], F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "rank")


@query("t7_scoped_keyword", f"WITH {retrieval._CORPUS.replace('ON e.vec_id = d.doc_id', 'ON e.vec_id = d.doc_id WHERE d.lang = ' + chr(39) + 'en' + chr(39))}, {retrieval._QUERIES}, {retrieval._KEYWORD} SELECT query_id, doc_id, rank FROM k WHERE rank <= 10")
def scoped_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyword_top(retrieval.queries(spark, sf), retrieval.corpus(spark, sf).where("kb = 'en'"), 10).select("query_id", "doc_id", "rank")


@query("q4_scoped_routing", retrieval._GRAPHED + " SELECT query_id, doc_id, 'graph' AS mode FROM hit JOIN corpus USING (doc_id) WHERE kb = 'es' UNION ALL SELECT query_id, doc_id, 'vector' AS mode FROM fused JOIN corpus USING (doc_id) WHERE kb IN ('en', 'fr') UNION ALL SELECT query_id, doc_id, 'wiki' FROM k JOIN corpus USING (doc_id) WHERE kb = 'de' AND rank <= 10")
def scoped_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Bases of vector mode answer from the fused list, those of wiki mode from keywords, those of graph mode from the graph."""
    kb = retrieval.corpus(spark, sf).select("doc_id", "kb")
    vectors = retrieval.hybrid(spark, sf).join(kb.where("kb IN ('en', 'fr')"), "doc_id").select("query_id", "doc_id", F.lit("vector").alias("mode"))
    words = retrieval.lists(spark, sf).where("source = 'keyword' AND rank <= 10").join(kb.where("kb = 'de'"), "doc_id")
    graph = retrieval.graph_hits(spark, sf).join(kb.where("kb = 'es'"), "doc_id").select("query_id", "doc_id", F.lit("graph"))
    return vectors.union(words.select("query_id", "doc_id", F.lit("wiki"))).union(graph)


@query("q8_retrieval_endpoint", _ALL + " SELECT query_id, doc_id, n, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS snippet FROM (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fused JOIN corpus USING (doc_id) WHERE kb <> 'es') WHERE n <= 5")
def endpoint(spark: SparkSession, sf: str) -> DataFrame:
    scoped = R.in_scope(retrieval.corpus(spark, sf), ["en", "fr", "de"], None, []).select("doc_id", "text")
    rows = retrieval.hybrid(spark, sf).drop("score").withColumnRenamed("rank", "was").join(scoped, "doc_id")
    return R.top(rows, 5, ["query_id"], F.asc("was")).select("query_id", "doc_id", F.col("rank").alias("n"), T.truncated(F.col("text"), 500).alias("snippet"))


@query("q10_streaming_variant", _ALL + " SELECT query_id, string_agg('[' || rank || '] ' || doc_id, ' ' ORDER BY rank) AS sources FROM fused WHERE rank <= 5 GROUP BY query_id")
def ungated(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of the pipeline without its gate, with short labels."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id").cast("string"))
    rows = retrieval.hybrid(spark, sf).where("rank <= 5").groupBy("query_id")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("l")))), lambda x: x["l"]), " ").alias("sources"))


@query("q13_conflicts", _ALL + ", p AS (SELECT a.query_id, a.doc_id AS a, b.doc_id AS b FROM fused a JOIN fused b ON a.query_id = b.query_id AND a.rank < b.rank AND b.rank <= 3 JOIN corpus x ON x.doc_id = a.doc_id JOIN corpus y ON y.doc_id = b.doc_id WHERE x.kb <> y.kb) SELECT query_id, a, b FROM p")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a query's first results that a judge calls contradictory; different languages stand in for the judge's verdict."""
    rows = retrieval.hybrid(spark, sf).where("rank <= 3").join(retrieval.corpus(spark, sf).select("doc_id", "kb"), "doc_id").select("query_id", "doc_id", "kb", "rank")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("a.query_id") == F.col("b.query_id")).where("a.rank < b.rank AND a.kb <> b.kb").select("a.query_id", F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


def _model(pairs: list) -> list:
    """A stand-in for a reranking service, which does not answer where a text has a number of characters that seven divides."""
    if any(len(text) % 7 == 0 for _, text in pairs):
        raise ConnectionError("no answer")
    return [round(1 / (1 + len(text) % 10), 6) for _, text in pairs]


@query("t19_guarded_rerank", _ALL + ", s AS (SELECT f.query_id, f.doc_id, length(c.text) % 7 = 0 AS fallback, round(CASE WHEN length(c.text) % 7 = 0 THEN greatest(0, 1 - 0.05::DOUBLE * (f.rank - 1)) ELSE round(1.0::DOUBLE / (1 + length(c.text) % 10), 6) END, 9) AS score FROM fused f JOIN corpus c USING (doc_id)) SELECT query_id, doc_id, round(score, 6) AS score, fallback, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s")
def guarded_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Reranking by a service that fails for some rows: these are scored by their old places, and none is lost."""
    q, c = retrieval.queries(spark, sf).select("query_id", "query"), retrieval.corpus(spark, sf).select("doc_id", "text")
    hits = retrieval.hybrid(spark, sf).select("query_id", "doc_id", "rank").join(c, "doc_id").join(R.bounded(q), "query_id")
    return guarded.rerank(hits, _model, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "fallback", "rank")


@query("m2_cosine_of_empty", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) END AS c FROM embeddings")
def cosine_of_empty(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("vec_id") % 3 == 0, F.array().cast("array<float>")).otherwise(F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(vector.cosine(F.col("embedding"), other), 6).alias("c"))


@query("m5_mean_and_spread", "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[1]::DOUBLE), 6) AS std FROM embeddings GROUP BY label")
def spread(spark: SparkSession, sf: str) -> DataFrame:
    x = F.get("embedding", 0).cast("double")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))


@query("r2_array_membership", "SELECT conv_id, list_contains(list(role), 'system') AS has_system, count(*) FILTER (WHERE role IN ('user', 'system')) AS n FROM conversations GROUP BY conv_id")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.array(F.lit("user"), F.lit("system"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_contains(F.collect_list("role"), "system").alias("has_system"), F.count_if(F.array_contains(allowed, F.col("role"))).alias("n"))


@query("n4_code_search_answer", "SELECT page_id, '[1] f' || page_id || '.go:' || (page_id % 50) AS line FROM pages")
def code_search_answer(spark: SparkSession, sf: str) -> DataFrame:
    n, at = F.col("page_id").cast("string"), (F.col("page_id") % 50).cast("string")
    found = F.concat(F.lit('{"summary": "s", "results": [{"file": "f'), n, F.lit('.go", "line": '), at, F.lit(', "content": "x"}]}'))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.from_json(found, "summary string, results array<struct<file:string,line:int,content:string>>")["results"]).alias("i", "r"))
    return rows.select("page_id", F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] "), "r.file", F.lit(":"), F.col("r.line").cast("string")).alias("line"))


@query("c7_strategy_dispatch", "SELECT doc_id, CASE lang WHEN 'de' THEN 'markdown' WHEN 'fr' THEN 'recursive' WHEN 'es' THEN 'semantic' ELSE CASE WHEN regexp_matches(text, '(^|\n)#{1,6} ') THEN 'markdown' ELSE 'recursive' END END AS strategy FROM documents WHERE trim(text) <> ''")
def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Each document goes to the chunker that its base names, English ones by their own headers; rows tell which made its chunks."""
    docs = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", "text", F.create_map(F.lit("de"), F.lit("markdown"), F.lit("fr"), F.lit("recursive"), F.lit("es"), F.lit("semantic"))[F.col("lang")].alias("asked"))
    return chunking.dispatched(docs, 400, 40).select("doc_id", "strategy").distinct()


@query("w6_percentile_break", "WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) SELECT user_id, round(v[(len(v) * 0.25)::int + 1], 6) AS limit_value FROM s".replace("(len(v) * 0.25)::int", "floor(len(v) * 0.25)::int"))
def percentile_break(spark: SparkSession, sf: str) -> DataFrame:
    v = F.array_sort(F.collect_list("value"))
    return table(spark, sf, "events").groupBy("user_id").agg(v.alias("v")).select("user_id", F.round(F.element_at("v", (F.floor(F.size("v") * 0.25) + 1).cast("int")), 6).alias("limit_value"))


@query("w7_balanced_chunks")
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    parts = chunking.balanced(F.split("text", "\n"), 120)
    return chunking.split_large(table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("seq", "chunk")), 1000)


@query("u3_chunk_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderkey), [1, 2]))), ',') AS chunks FROM orders GROUP BY o_custkey")
def chunk_union(spark: SparkSession, sf: str) -> DataFrame:
    both = F.array_sort(F.array_union(F.collect_list("o_orderkey"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(both.cast("array<string>"), ",").alias("chunks"))


@query("a18_progress_totals", "SELECT count(*) AS processed, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 400) AS errors FROM documents")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("processed"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 400).alias("errors"))


@query("q16_ingest_parsed", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def ingest_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks numbered into embedding batches of 64 by knowledge base."""
    rows = R.numbered(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id")
    return rows.select("doc_id", F.floor((F.col("n") - 1) / 64).alias("batch"))


@query("q20_enrichment", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[上下文: ' || lang || ']' || chr(10) || text ELSE text END AS chunk FROM documents")
def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """A second batch overwrites the chunks that were enriched, under their ids."""
    base = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("chunk"))
    richer = base.where("doc_id % 4 = 0").withColumn("chunk", chunking.contextual(F.col("chunk"), F.col("lang")))
    return I.upsert(base, richer, ["doc_id"]).select("doc_id", "chunk")


#: What a model would answer for an order: its suppliers as nodes, each related to the one of the next line; of every fiftieth order it answers nonsense.
_EXTRACTED = "x AS (SELECT l_orderkey AS chunk, l_linenumber AS line, 'S' || l_suppkey AS name, l_returnflag AS type, l_linestatus AS attribute FROM lineitem WHERE l_orderkey % 50 <> 0)"


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk, answer): an answer has as many items as its order has lines, seven at most."""
    name = F.concat(F.lit(" S"), F.col("l_suppkey").cast("string"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("name"), F.col("l_returnflag").alias("type"), F.array("l_linestatus").alias("attributes")))).alias("lines"))
    nodes = F.transform("lines", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["attributes"].alias("attributes")))
    pairs = F.zip_with(F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines")), lambda a, b: F.struct(a["name"].alias("src"), b["name"].alias("dst"), F.lit("next to!").alias("type")))
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(nodes.alias("nodes"), pairs.alias("relations"))), F.lit("\n```"))
    return rows.select("chunk", F.when(F.col("chunk") % 50 == 0, "I cannot {").otherwise(answer).alias("answer"))


@query("q21_graph_build", f"WITH {_EXTRACTED}, p AS (SELECT DISTINCT a.chunk, a.name AS src, b.name AS dst FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY line, name) AS n FROM x) a JOIN (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY line, name) AS n FROM x) b ON a.chunk = b.chunk AND b.n = a.n + 1 WHERE a.name <> b.name) SELECT src, dst, 'next_to' AS type, count(*) AS n FROM p GROUP BY ALL")
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """Relations from a model's answers, chunk by chunk."""
    return imports.graph_relations(imports.items(extracted(spark, sf)))


@query("q21_graph_nodes", f"WITH {_EXTRACTED} SELECT name, min_by(type, struct_pack(c := chunk, t := type)) AS type, count(DISTINCT chunk) AS chunks, array_to_string(list_sort(list(DISTINCT attribute)), ',') AS attributes FROM x GROUP BY name")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the same answers, merged by name."""
    return imports.graph_nodes(imports.items(extracted(spark, sf))).withColumn("attributes", F.array_join("attributes", ","))


@query("q22_code_index")
def code_index(spark: SparkSession, sf: str) -> DataFrame:
    """Code entities, with the relations whose ends are both known; imports make module nodes."""
    items = G.code_graph(spark.createDataFrame(graphs.CODE, "source string, content string"))
    names = items.where(F.col("kind").isin("Class", "Interface", "Function", "Method")).select("name").distinct()
    inner = items.where(F.col("kind").isin("CALLS", "INHERITS", "CONTAINS")).join(names, "name", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    return inner.select("kind", "name", "target").union(items.where("kind = 'IMPORTS'").select("kind", "name", "target")).distinct()


@query("e5_tool_loops", "WITH r AS (SELECT user_id, event_type, seq, seq - row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)) SELECT user_id, min(seq) AS warned_at FROM (SELECT user_id, island, event_type, min(seq) + 4 AS seq FROM r GROUP BY ALL HAVING count(*) >= 5) GROUP BY user_id")
def tool_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Where a user first repeats a step five times in a row; a warning is given once."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("seq"))
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", seq.alias("seq")).withColumn("island", F.col("seq") - own)
    runs = rows.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), (F.min("seq") + 4).alias("at")).where("n >= 5")
    return runs.groupBy("user_id").agg(F.min("at").alias("warned_at"))
