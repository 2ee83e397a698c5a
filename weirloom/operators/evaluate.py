"""Retrieval metrics in three variants, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def metrics(results: DataFrame, gold: DataFrame, k: int, variant: str = "new", samples: DataFrame | None = None) -> DataFrame:
    """results (id, doc, rank), gold (id, doc) -> id, labelled, recall, precision, hit, mrr, ndcg.

    Variants: "new" credits a retrieved document only where it is a new gold one, the ideal is
    min(gold, retrieved), capped at 1; "repeat" credits repeats too, without the cap; "k" as
    "repeat" with the ideal min(gold, k).
    """
    top = results.where(F.col("rank") <= k)
    want = gold.distinct().withColumn("gold", F.lit(1))
    hits = top.join(want, ["id", "doc"], "left")
    new = F.row_number().over(Window.partitionBy("id", "doc").orderBy("rank")) == 1 if variant == "new" else F.lit(True)
    hits = hits.withColumn("rel", F.when(F.col("gold").isNotNull() & new, 1).otherwise(0))
    per = hits.groupBy("id").agg(F.count("*").alias("n"), F.sum("rel").alias("hits"), F.countDistinct(F.when(F.col("rel") == 1, F.col("doc"))).alias("distinct"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") * discount(F.col("rank"))).alias("dcg"))
    total = want.groupBy("id").agg(F.count("*").alias("total"))
    every = (samples or results.select("id").union(gold.select("id"))).select("id").distinct()
    rows = every.join(total, "id", "left").join(per, "id", "left").na.fill(0, ["total", "n", "hits", "distinct"])
    depth = F.least(F.col("total"), F.lit(k) if variant == "k" else F.col("n")).cast("int")
    ideal = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0), lambda a, i: a + discount(i)))
    ndcg = F.coalesce(F.col("dcg") / ideal, F.lit(0.0))
    found = F.col("distinct") if variant == "new" else F.col("hits")
    zero = F.lit(0.0)
    return rows.select(
        "id",
        (F.col("total") > 0).alias("labelled"),
        F.when(F.col("total") > 0, found / F.col("total")).otherwise(zero).alias("recall"),
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(zero).alias("precision"),
        F.when(F.col("hits") > 0, 1.0).otherwise(zero).alias("hit"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        (F.least(F.lit(1.0), ndcg) if variant == "new" else ndcg).alias("ndcg"),
    )


def summary(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the labelled rows of a group, or over all if it has none; counts and coverage."""
    some = measured.withColumn("any", F.max("labelled").over(Window.partitionBy(*keys)))
    used = F.col("labelled") | ~F.col("any")
    names = ["recall", "precision", "hit", "mrr", "ndcg"]
    return some.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("labelled").alias("n_labelled"),
        *(F.round(F.sum(F.when(used, F.col(c))) / F.greatest(F.lit(1), F.count_if(used)), 6).alias(c) for c in names),
        F.round(F.count_if("labelled") / F.greatest(F.lit(1), F.count("*")), 6).alias("coverage"),
    )
