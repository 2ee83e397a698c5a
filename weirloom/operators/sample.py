"""Seeded samples that do not depend on how rows are partitioned: bottom-k by hash.

Every id has a place, the SHA-256 of seed and id; a sample is the k ids of the smallest places.
The bottom k of a union are among the bottom k of its parts, so tasks cut to k before anything
is shuffled, and a sample of more rows can be had by merging samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.operators.retrieve import top


def place(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def bottom_k(rows: DataFrame, k: int, key: str, seed: int, groups: list[str] | None = None) -> DataFrame:
    """The rows of the k smallest places, of each group or of all; ids are unique within a group. null ids take no part."""
    given = rows.where(F.col(key).isNotNull()).withColumn("place", place(seed, F.col(key)))
    if groups:
        return top(given, k, groups, F.asc("place"), F.asc(key)).drop("rank", "place")
    return given.orderBy("place", key).limit(k).drop("place")


def sample_queries(judged: DataFrame, n: int, least: int, relevant: int = 2, seed: int = 42) -> DataFrame:
    """(qid): a sample of n among the queries of judged (qid, pid, rel) that have `least` passages of relevance `relevant` or more."""
    fit = judged.where(F.col("rel") >= relevant).groupBy("qid").agg(F.countDistinct("pid").alias("n")).where(F.col("n") >= least).select("qid")
    return bottom_k(fit, n, "qid", seed)


def passages(judged: DataFrame, queries: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """(pid, rel): cap passages judged for the queries, those of the highest relevance for any of them first; passages of relevance 0 fill what is left. Equal ones by place."""
    best = judged.join(queries.select("qid"), "qid", "left_semi").where("pid IS NOT NULL").groupBy("pid").agg(F.max("rel").alias("rel"))
    return best.withColumn("place", place(seed, F.col("pid"))).orderBy(F.desc("rel"), "place", "pid").limit(cap).drop("place")
