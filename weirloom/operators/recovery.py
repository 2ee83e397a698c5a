"""Evidence gate, and recovery: further attempts for the queries that no evidence has answered.

`recover` takes attempts in order, each a rewriting of the query and a search. Only queries that
are still without good evidence go on to the next one (an anti-join after each), so a late and
costly attempt sees few of them. What is left after the last attempt stays unanswered.

Defined results: an attempt that gives a query the same (mode, text) as an earlier one is
skipped for it; a null rewriting too; a query without any answer keeps a row with attempt null
and the status of its last gate; without queries the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.functions import text as T
from weirloom.sources.sinks import durable


def gate(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries (query_id, query), evidence (query_id, doc_id, text) -> (query_id, kept, status): how many pieces are of use, and what to say of the query."""
    here = F.col("doc_id").isNotNull()
    rows = queries.select("query_id", "query").join(evidence.select("query_id", "doc_id", "text"), "query_id", "left")
    low = T.low_quality(F.coalesce("text", F.lit("")))
    off = T.has_any(F.lower("query"), T.STRICT_TOPICS) & ~T.relevant(T.meaningful_terms(F.col("query")), F.coalesce("text", F.lit("")))
    counted = rows.groupBy("query_id").agg(F.first("query").alias("query"), F.count_if(here & ~low & ~off).alias("kept"), F.count_if(here & low).alias("low"), F.count_if(here & ~low & off).alias("off"))
    overview = T.has_any(F.lower("query"), T.OVERVIEW_PHRASES) & (F.col("kept") == 0)
    status = F.when(overview, "insufficient_project_context").when(F.col("kept") > 0, "ok").when((F.col("off") > 0) & (F.col("low") == 0), "irrelevant_evidence").otherwise("low_quality_evidence")
    return counted.select("query_id", "kept", status.alias("status"))


@dataclass
class Attempt:
    """mode: the name of the search; rewrite: the query's text for it; search: queries (query_id, query, ..) -> (query_id, doc_id, rank)."""

    mode: str
    rewrite: Callable[[Column], Column]
    search: Callable[[DataFrame], DataFrame]


def recover(queries: DataFrame, docs: DataFrame, attempts: list[Attempt], judge: Callable[[DataFrame, DataFrame], DataFrame] = gate) -> DataFrame:
    """queries (query_id, query, ..), docs (doc_id, text) -> (query_id, attempt, mode, kept, status, sources: ids in order of rank)."""
    left = durable(queries.withColumns({"tried": F.expr("CAST(array() AS array<string>)"), "status": F.lit(None).cast("string")}))
    ids = docs.schema["doc_id"].dataType.simpleString()
    answers = []
    for number, attempt in enumerate(attempts, 1):
        if not left.limit(1).count():
            break
        asked = left.withColumn("own", attempt.rewrite(F.col("query")))
        asked = asked.withColumn("way", F.concat(F.lit(f"{attempt.mode}|"), "own"))
        fresh = durable(asked.where("own IS NOT NULL AND NOT array_contains(tried, way)"))
        hits = durable(attempt.search(fresh.withColumn("query", F.col("own")).drop("own", "way", "tried", "status")).select("query_id", "doc_id", "rank"))
        found = docs.select("doc_id", "text").join(hits, "doc_id")
        verdict = durable(judge(fresh.select("query_id", "query"), found).select("query_id", "kept", F.col("status").alias("now")))
        good = verdict.where("now = 'ok'")
        sources = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("sources")
        answers.append(durable(hits.join(good, "query_id").groupBy("query_id", "kept").agg(sources).select("query_id", F.lit(number).alias("attempt"), F.lit(attempt.mode).alias("mode"), F.col("kept").cast("long").alias("kept"), F.lit("ok").alias("status"), "sources")))
        ways = fresh.select("query_id", "way")
        rest = left.join(good, "query_id", "left_anti").join(verdict.select("query_id", "now"), "query_id", "left").join(ways, "query_id", "left")
        left = durable(rest.withColumns({"tried": F.when(F.col("way").isNotNull(), F.array_append("tried", F.col("way"))).otherwise(F.col("tried")), "status": F.coalesce("now", "status")}).drop("way", "now"))
    out = left.select("query_id", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("mode"), F.lit(0).cast("long").alias("kept"), "status", F.expr(f"CAST(array() AS array<{ids}>)").alias("sources"))
    for a in answers:
        out = out.unionByName(a)
    return out
