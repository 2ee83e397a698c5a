"""Evaluation queries: metrics, percentiles, matrices of strategies, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.functions import text as T
from weirloom.operators import evaluate as E
from weirloom.operators import patterns, sample
from weirloom.plans import retrieval
from weirloom.plans.registry import query, table
from weirloom.sources.sinks import durable

_ALL = retrieval._ALL
_FOUR = ("vector", "hybrid", "hybrid_rerank", "full")
#: Gold of a query: the documents that contain its whole text; results of both strategies.
_RESULTS = "res AS (SELECT 'vector' AS strategy, query_id, doc_id, rank FROM v WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused), gold AS (SELECT DISTINCT q.query_id, c.doc_id FROM queries q JOIN corpus c ON q.query <> '' AND contains(c.text, q.query))"
_IDEAL = "list_sum(list_transform(range(1, {d} + 1), lambda i: 1 / log2(i + 1)))"
_METRICS = f"""s AS (SELECT DISTINCT strategy, q.query_id FROM (VALUES ('vector'), ('hybrid')) x(strategy), queries q),
h AS (SELECT r.strategy, r.query_id, r.doc_id, r.rank, (g.doc_id IS NOT NULL)::int AS rel FROM res r LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id),
per AS (SELECT strategy, query_id, count(*) AS n, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM h GROUP BY ALL),
tot AS (SELECT query_id, count(*) AS total FROM gold GROUP BY query_id),
m AS (SELECT s.strategy, s.query_id, coalesce(total, 0) > 0 AS labelled, CASE WHEN total > 0 THEN coalesce(hits, 0) / total::DOUBLE ELSE 0 END AS recall, CASE WHEN n > 0 THEN hits / n::DOUBLE ELSE 0 END AS precision,
 CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, coalesce(1.0 / first, 0) AS mrr, least(1.0, coalesce(dcg / {_IDEAL.format(d='least(total, n)')}, 0)) AS ndcg FROM s LEFT JOIN tot USING (query_id) LEFT JOIN per USING (strategy, query_id))"""


def results(spark: SparkSession, sf: str, four: bool = False) -> DataFrame:
    """(strategy, query_id, doc_id, rank) of vector and hybrid search; four: also of hybrid search reranked, and of that without evidence of low quality."""
    lists = durable(retrieval.lists(spark, sf))
    fused = durable(retrieval.R.fuse(lists, 10).select("query_id", "doc_id", "rank"))
    out = lists.where("source = 'vector' AND rank <= 10").select(F.lit("vector").alias("strategy"), "query_id", "doc_id", "rank").union(fused.select(F.lit("hybrid"), "query_id", "doc_id", "rank"))
    if four:
        q, c = retrieval.queries(spark, sf).select("query_id", "query"), retrieval.corpus(spark, sf).select("doc_id", "text")
        hits = durable(c.join(fused.drop("rank"), "doc_id").join(retrieval.R.bounded(q), "query_id"))
        for name, rows in (("hybrid_rerank", hits), ("full", hits.where(~T.low_quality(F.col("text"))))):
            out = out.union(retrieval.R.rerank_local(rows, 10).select(F.lit(name), "query_id", "doc_id", "rank"))
    return out


def gold(spark: SparkSession, sf: str) -> DataFrame:
    q = retrieval.queries(spark, sf).select(F.col("query_id").alias("pattern_id"), F.col("query").alias("pattern"))
    found = patterns.matches(q, retrieval.R.spread(table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")))
    return found.select(F.col("pattern_id").alias("query_id"), F.col("text_id").alias("doc_id"))


def measured(spark: SparkSession, sf: str, variant: str, four: bool = False) -> DataFrame:
    key = F.concat_ws("/", "strategy", "query_id")
    res = results(spark, sf, four).select(key.alias("id"), F.col("doc_id").alias("doc"), "rank")
    strategies = spark.createDataFrame([(n,) for n in (_FOUR if four else _FOUR[:2])], "strategy string")
    want = gold(spark, sf).join(F.broadcast(strategies)).select(key.alias("id"), F.col("doc_id").alias("doc"))  # four rows at most
    every = retrieval.queries(spark, sf).select("query_id").join(F.broadcast(strategies)).select(key.alias("id"))
    out = E.metrics(res, want, 10, variant, every)
    return out.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("strategy"), F.split_part("id", F.lit("/"), F.lit(2)).cast("long").alias("query_id"), "labelled", "recall", "precision", "hit", "mrr", "ndcg")


_ROUND = "round(recall, 6) AS recall, round(precision, 6) AS precision, hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("strategy", "query_id", "labelled", *(F.round(c, 6).alias(c) for c in ("recall", "precision")), "hit", *(F.round(c, 6).alias(c) for c in ("mrr", "ndcg")))


@query("a7_retrieval_metrics", f"{_ALL}, {_RESULTS}, {_METRICS} SELECT strategy, query_id, labelled, {_ROUND} FROM m")
def metrics_new(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(measured(spark, sf, "new"))


@query("a8_metrics_exact_match", f"{_ALL}, {_RESULTS}, {_METRICS.replace('least(1.0, coalesce(dcg', '(coalesce(dcg')} SELECT strategy, query_id, labelled, {_ROUND} FROM m")
def metrics_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(measured(spark, sf, "repeat"))


@query("a9_metrics_ideal_at_k", f"{_ALL}, {_RESULTS}, {_METRICS.replace('least(1.0, coalesce(dcg', '(coalesce(dcg').replace('least(total, n)', 'least(total, 10)')} SELECT strategy, query_id, labelled, {_ROUND} FROM m")
def metrics_k(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(measured(spark, sf, "k"))


@query("a10_summary", f"{_ALL}, {_RESULTS}, {_METRICS}, w AS (SELECT *, max(labelled::int) OVER (PARTITION BY strategy) AS has FROM m) SELECT strategy, count(*) AS n, count(*) FILTER (WHERE labelled) AS n_labelled, " + ", ".join(f"round(sum({c}) FILTER (WHERE labelled OR has = 0) / greatest(1, count(*) FILTER (WHERE labelled OR has = 0)), 6) AS {c}" for c in ("recall", "precision", "hit", "mrr", "ndcg")) + ", round(count(*) FILTER (WHERE labelled) / count(*)::DOUBLE, 6) AS coverage FROM w GROUP BY strategy")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summary(measured(spark, sf, "new"), ["strategy"])


_RERANKED = "SELECT f.query_id, f.doc_id, c.body, round(len(list_filter(string_split(lower(q.query), ''), lambda c: contains(lower(body), c))) / length(q.query)::DOUBLE / 2, 9) AS score FROM fused f JOIN queries q USING (query_id) JOIN (SELECT doc_id, text AS body, text FROM corpus) c USING (doc_id)"
_RESULTS4 = f"rr AS MATERIALIZED ({_RERANKED}), lq AS (SELECT doc_id, {retrieval._LOWQ} AS low FROM documents), " + _RESULTS.replace("FROM fused)", "FROM fused UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM rr UNION ALL SELECT 'full', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM rr JOIN lq USING (doc_id) WHERE NOT low)", 1)


@query("q27_strategy_matrix", f"{_ALL}, {_RESULTS4}, {_METRICS.replace("('hybrid'))", "('hybrid'), ('hybrid_rerank'), ('full'))")} SELECT strategy, query_id % 4 AS category, grouping(strategy) AS g1, grouping(query_id % 4) AS g2, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY ROLLUP (strategy, query_id % 4)")
def strategy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Four strategies by category, with totals."""
    rows = measured(spark, sf, "new", four=True).withColumn("category", F.col("query_id") % 4)
    return rows.rollup("strategy", "category").agg(F.grouping("strategy").cast("long").alias("g1"), F.grouping("category").cast("long").alias("g2"), F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "ndcg")))


@query("a11_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf, "events").groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("a12_rounds", "SELECT event_type, round(avg(v), 4) AS mean, round(coalesce(stddev_pop(v), 0), 2) AS std FROM (SELECT event_type, user_id % 3 AS round, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("round")).agg(F.avg("value").alias("v"))
    return each.groupBy("event_type").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.stddev_pop("v"), F.lit(0.0)), 2).alias("std"))


@query("a13_nan_mean", "SELECT event_type, round(avg(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END), 6) AS mean FROM events GROUP BY event_type")
def nan_mean(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value"))
    rows = table(spark, sf, "events").select("event_type", value.alias("v"))
    return rows.groupBy("event_type").agg(F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 6).alias("mean"))


@query("a14_keyword_hits", "SELECT lang, round(avg((contains(lower(text), 'the') AND contains(lower(text), 'of'))::int), 6) AS all_rate, round(avg((contains(lower(text), 'the') OR contains(lower(text), 'der'))::int), 6) AS any_rate FROM documents GROUP BY lang")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    lower = F.lower("text")
    every = F.forall(F.array(F.lit("the"), F.lit("of")), lambda w: F.contains(lower, w))
    some = F.exists(F.array(F.lit("the"), F.lit("der")), lambda w: F.contains(lower, w))
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(every.cast("int")), 6).alias("all_rate"), F.round(F.avg(some.cast("int")), 6).alias("any_rate"))


@query("a15_trace_summary", "SELECT user_id, count(*) AS step_count, count(*) FILTER (WHERE event_type = 'click') AS source_count, round(sum(value), 4) AS latency, max_by(event_id, ts) FILTER (WHERE event_type = 'view') AS last_view FROM (SELECT * FROM events ORDER BY event_id) GROUP BY user_id")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    view = F.when(F.col("event_type") == "view", F.col("ts"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("step_count"), F.count_if(F.col("event_type") == "click").alias("source_count"), F.round(F.sum("value"), 4).alias("latency"), F.max_by("event_id", view).alias("last_view"))


_BUCKETS = [1, 5, 10, 25, 50, 100, 250, 500]


@query("a16_histogram", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([" + ", ".join(map(str, _BUCKETS)) + "]) AS le) GROUP BY event_type, le")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counts by bucket: one row of counters for each group, then unpivoted."""
    wide = table(spark, sf, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(str(b)) for b in _BUCKETS))
    return wide.unpivot("event_type", [F.col(str(b)) for b in _BUCKETS], "le", "n").select("event_type", F.col("le").cast("int").alias("le"), "n")


@query("m6_bucket", "SELECT event_id, CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(_BUCKETS)) + f" ELSE {len(_BUCKETS)} END AS bucket FROM events")
def bucket(spark: SparkSession, sf: str) -> DataFrame:
    cond = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(_BUCKETS))):
        cond = F.when(F.col("value") <= b, i).otherwise(F.lit(len(_BUCKETS)) if i == len(_BUCKETS) - 1 else cond)
    return table(spark, sf, "events").select("event_id", cond.alias("bucket"))


@query("m4_discounts", "SELECT doc_id, round(1 / log2((doc_id % 10 + 1) + 1), 6) AS gain FROM documents")
def discounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(E.discount(F.col("doc_id") % 10 + 1), 6).alias("gain"))


@query("j13_gold_contained", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text) OR contains(d.source, 'src' || b.item_id)")
def gold_contained(spark: SparkSession, sf: str) -> DataFrame:
    """By the whole text, or by what names the source."""
    q, docs = table(spark, sf, "benchmark").where("text IS NOT NULL"), retrieval.R.spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    texts = patterns.matches(q.select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern")), docs.select(F.col("doc_id").alias("text_id"), "text"))
    names = q.select(F.col("item_id").alias("pattern_id"), F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("pattern"))
    sources = patterns.matches(names, docs.where("source IS NOT NULL").select(F.col("source").alias("text_id"), F.col("source").alias("text")).distinct())
    return texts.select(F.col("pattern_id").alias("item_id"), F.col("text_id").alias("doc_id")).union(docs.join(sources, docs.source == sources.text_id).select(F.col("pattern_id").alias("item_id"), "doc_id")).distinct()


@query("j14_gold_exact", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON lower(trim(' D' || d.doc_id)) = lower(trim('d' || l.doc_id || ' '))")
def gold_exact(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.lower(F.trim(c))
    docs = table(spark, sf, "documents").select("doc_id", n(F.concat(F.lit(" D"), F.col("doc_id").cast("string"))).alias("k"))
    labels = table(spark, sf, "labels").select("quality", n(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" "))).alias("k"))
    return docs.join(labels, "k").select("doc_id", "quality")


_JUDGED = "g AS (SELECT l_suppkey AS qid, l_partkey AS pid, max((l_orderkey + l_linenumber) % 4)::INT AS rel FROM lineitem GROUP BY ALL)"
_SAMPLED = f"{_JUDGED}, q AS (SELECT qid FROM (SELECT qid FROM g WHERE rel >= 2 GROUP BY qid HAVING count(*) >= 3) ORDER BY sha256('42:' || qid), qid LIMIT 30)"


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as queries, parts as passages, with relevance 0 to 3."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("pid")).agg(F.max((F.col("l_orderkey") + F.col("l_linenumber")) % 4).cast("int").alias("rel"))


@query("a20_query_sampling", f"WITH {_JUDGED}, {{q}} SELECT qid, pid, rel FROM (SELECT g.*, row_number() OVER (PARTITION BY qid ORDER BY sha256('42:' || pid), pid) AS n FROM g JOIN q USING (qid) WHERE rel >= 2) WHERE n <= 12".format(q=_SAMPLED[len(_JUDGED) + 2:]))
def query_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of queries with enough gold, and of each at most twelve gold passages."""
    g = judged(spark, sf)
    return sample.bottom_k(g.where("rel >= 2").join(sample.sample_queries(g, 30, 3), "qid", "left_semi"), 12, "pid", 42, ["qid"]).select("qid", "pid", "rel")


@query("a20_passage_cap", f"WITH {_SAMPLED} SELECT pid, rel FROM (SELECT pid, max(rel) AS rel FROM g JOIN q USING (qid) GROUP BY pid) ORDER BY rel DESC, sha256('42:' || pid), pid LIMIT 2000")
def passage_cap(spark: SparkSession, sf: str) -> DataFrame:
    g = judged(spark, sf)
    return sample.passages(g, sample.sample_queries(g, 30, 3), 2000)


@query("q26_candidate_labels", "SELECT conv_id, array_to_string(list(k ORDER BY turn), '|') AS candidates FROM (SELECT conv_id, trim(text) AS k, min(turn) AS turn FROM conversations WHERE trim(text) <> '' GROUP BY ALL) GROUP BY conv_id")
def candidate_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where("trim(text) <> ''").groupBy("conv_id", F.trim("text").alias("k")).agg(F.min("turn").alias("turn"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "k"))), lambda x: x["k"]), "|").alias("candidates"))
