"""Candidate generation, rank fusion and scope for batches of queries.

Queries are a table (query_id, ...); every operator works for all of them in one plan. The
query side of a nested-loop join is broadcast only while it has at most BROADCAST_QUERIES rows.
Vector and keyword search read the corpus once for each block of that many queries: a task
scores its documents against the whole block by a matrix product or from the queries that
each token is in, and keeps k documents a query, so what is shuffled does not grow with
documents times queries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.sources.sinks import durable, scratch

BROADCAST_QUERIES = 10_000
#: Corpus rows that a task scores at once: a matrix of this times BROADCAST_QUERIES numbers at most.
SCORED_ROWS = 500
#: Estimated bytes for each core below which a table counts as small.
SPREAD_BYTES = 64 << 20
RRF_K = 60
KEYWORD_WEIGHT = 0.8
GRAPH_BOOST = 1.2


def bounded(queries: DataFrame) -> DataFrame:
    """The query side of a nested-loop join: broadcast if it is small, else dealt over tasks as it is."""
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    return F.broadcast(queries) if small else queries


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A small scanned table dealt over all cores, since one file's row group is one task; a large one is left as its files are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(n, *keys) if size < n * SPREAD_BYTES else rows


def top(rows: DataFrame, k: int, keys: list[str], *order: Column) -> DataFrame:
    """The k first rows of each group, with rank; a partial top-k runs before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def numbered(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with n, the place from 1 within keys by order, nulls first, where a group may be of any size.

    A range sort deals groups over tasks; a task numbers what it has of a group, and a table of a
    row for each task and group says how many came before. Equal rows are numbered in any order.
    """
    count = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(count, *(F.asc_nulls_first(c) for c in [*keys, *order])).withColumn("_part", F.spark_partition_id())
    dealt = durable(dealt)
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*(F.asc_nulls_first(c) for c in order))))
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_size"))
    so_far = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")
    before = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), so_far.alias("_before"))
    same = [own[k].eqNullSafe(before[f"_{k}"]) for k in keys] + [own["_part"] == before["_p"]]
    return own.join(before, same).select(*rows.columns, (F.col("_before") + F.col("_own")).alias("n"))


Scores = Callable[[pa.RecordBatch], np.ndarray]


def best_rows(value: np.ndarray, order: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k best rows of each query over `least`; `order` sorts the rows as ties are to be ordered."""
    ranked = value[order]
    if len(ranked) <= k:
        row, query = np.nonzero(ranked > least)
        return order[row], query
    cut = np.partition(ranked, -k, axis=0)[-k]
    above, tied = ranked > cut, ranked == cut
    keep = above | (tied & (np.cumsum(tied, axis=0) <= k - above.sum(axis=0)))
    row, query = np.nonzero(keep & (ranked > least))
    return order[row], query


def searched(queries: DataFrame, corpus: DataFrame, k: int, scorer: Callable[[pa.Table], Scores], least: float) -> DataFrame:
    """(query_id, doc_id, score, rank): scorer makes, of a block of queries, the function that scores a batch of corpus rows as (rows, queries). Scores at or below `least` do not count.

    A task sends k rows a query and batch at most, ties by doc_id among them. Beyond one block, each block's rows become a table in the shared folder before the next block is fetched, so the driver holds one at a time.
    """
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"

    def found(block: pa.Table) -> DataFrame:
        scores, names = scorer(block), block.column("query_id").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SCORED_ROWS):
                    part = batch.slice(at, SCORED_ROWS)
                    value = scores(part)
                    row, query = best_rows(value, pc.sort_indices(part.column("doc_id")).to_numpy(), k, least)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), part.column("doc_id").take(pa.array(row)), pa.array(value[row, query])], ["query_id", "doc_id", "score"])

        return corpus.mapInArrow(run, schema)

    best = lambda rows: top(rows, k, ["query_id"], F.desc("score"), F.asc("doc_id"))
    n = -(-queries.count() // BROADCAST_QUERIES)
    if n == 0:
        return best(spark.createDataFrame([], schema))
    if n == 1:
        return best(found(queries.toArrow()))
    path = scratch(spark)
    for i in range(n):
        best(found(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow())).write.parquet(f"{path}/block={i}")
    return spark.read.parquet(path).drop("block")


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; null and zero vectors are zero."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    rows = np.array([v if v and len(v) == width else [0.0] * width for v in lists], np.float64).reshape(len(lists), width)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def vector_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """queries (query_id, query_vec), corpus (doc_id, vec) -> (query_id, doc_id, score, rank), cosine to nine digits.

    Documents and queries without a vector take no part; a query meets its own row if ids are shared.
    """

    def scorer(block: pa.Table) -> Scores:
        own = unit_rows(block.column("query_vec")).T
        return lambda batch: np.round(unit_rows(batch.column("vec")) @ own, 9)

    q, c = queries.select("query_id", "query_vec").where("query_vec IS NOT NULL"), corpus.select("doc_id", "vec").where("vec IS NOT NULL")
    return searched(q, c, k, scorer, -np.inf)


#: White space that separates tokens, so no token spans two words of a text.
_GAPS = re.compile("[ \\t\\n\\x0b\\f\\r]+")


class TokenScores:
    """The share of each query's tokens that a lower-cased text contains."""

    def __init__(self, tokens: list[list[str]]):
        self.sizes = np.array([max(1, len(t)) for t in tokens], np.float64)
        self.number = {t: i for i, t in enumerate(sorted({t for own in tokens for t in own}))}
        self.lengths = sorted({len(t) for t in self.number})
        pairs = np.array(sorted((self.number[t], q) for q, own in enumerate(tokens) for t in own), np.int64).reshape(-1, 2)
        self.queries = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.number) + 1))
        self.known: dict[str, tuple[int, ...]] = {}

    def within(self, word: str) -> tuple[int, ...]:
        """The tokens that a word contains."""
        found = self.known.get(word)
        if found is None:
            number = self.number
            if len(word) * len(self.lengths) > 4 * len(number):
                found = tuple(i for t, i in number.items() if t in word)
            else:
                found = tuple({number[word[a : a + n]] for n in self.lengths for a in range(len(word) - n + 1) if word[a : a + n] in number})
            if len(word) <= 40 and len(self.known) < 500_000:
                self.known[word] = found
        return found

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.sizes)))
        for i, text in enumerate(batch.column("lower").to_pylist()):
            ids = np.array(sorted({x for word in set(_GAPS.split(text or "")) for x in self.within(word)}), np.int64)
            if len(ids):
                first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                out[i] = np.bincount(self.queries[at], minlength=len(self.sizes))
        return out / self.sizes


def keyword_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """queries (query_id, query), corpus (doc_id, text): the share of a query's tokens that a document contains, over 0.

    A document's distinct words tell which tokens of any query it contains, and these which queries gain; null texts contain nothing.
    """
    q = queries.select("query_id", F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda t: t != "").alias("tokens")).where("size(tokens) > 0")
    return searched(q, corpus.select("doc_id", F.lower("text").alias("lower")), k, lambda block: TokenScores(block.column("tokens").to_pylist()), 0.0)


def fuse(lists: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """lists (query_id, doc_id, source, rank) -> top k by the sum of weight / (60 + rank), with match_type and contributions."""
    weight = F.lit(1.0)
    for name, w in (weights or {"keyword": KEYWORD_WEIGHT}).items():
        weight = F.when(F.col("source") == name, F.lit(w)).otherwise(weight)
    part = lists.withColumn("part", weight / (RRF_K + F.col("rank")))
    fused = part.groupBy("query_id", "doc_id").agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.count("*").alias("hits"),
        F.min("source").alias("one"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "rank"))), ",").alias("contributions"),
    )
    fused = fused.withColumn("match_type", F.when(F.col("hits") > 1, "hybrid").otherwise(F.col("one"))).drop("one")
    return top(fused, k, ["query_id"], F.desc("score"), F.asc("doc_id"))


def boost(fused: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """Documents that the graph found too get a higher score, at most 1, and the ranks are made anew."""
    hit = graph_hits.select("query_id", "doc_id").distinct().withColumn("graph", F.lit(True))
    out = fused.drop("rank").join(hit, ["query_id", "doc_id"], "left").withColumn("graph", F.coalesce("graph", F.lit(False)))
    out = out.withColumn("score", F.when(F.col("graph"), F.round(F.least(F.lit(1.0), F.col("score") * GRAPH_BOOST), 9)).otherwise(F.col("score")))
    out = out.withColumn("match_type", F.when(F.col("graph") & F.col("match_type").isin("vector", "keyword"), "hybrid").otherwise(F.col("match_type")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))))


def rerank_local(hits: DataFrame, k: int) -> DataFrame:
    """hits (query_id, query, doc_id, text): half the share of the query's distinct-place characters that the text has."""
    chars = F.split(F.lower("query"), "(?!^)(?!$)")
    lower = F.lower("text")
    share = F.size(F.filter(chars, lambda c: F.contains(lower, c))) / F.nullif(F.char_length("query"), F.lit(0))
    scored = hits.withColumn("score", F.round(F.coalesce(share, F.lit(0.0)) / 2, 9)).drop("rank")
    return top(scored, k, ["query_id"], F.desc("score"), F.asc("doc_id"))


def first_seen(rows: DataFrame, keys: list[str], key: str, order: str, keep_blank: bool) -> DataFrame:
    """The first row of each key within its group, in order; blank keys are all kept, or all dropped."""
    rank = F.row_number().over(Window.partitionBy(*keys, key).orderBy(order))
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    out = rows.withColumn("seen", rank).where((F.col("seen") == 1) | blank).drop("seen")
    return out if keep_blank else out.where(~blank)


def in_scope(docs: DataFrame, kbs: list[str] | None, ids: list[int] | None, columns: list[str]) -> DataFrame:
    """Documents of the bases and with any of the ids; an empty restriction lets nothing through, none lets all."""
    cond = F.lit(True)
    if kbs is not None:
        cond = cond & (F.col("kb").isin(kbs) if kbs else F.lit(False))
    if ids is not None:
        cond = cond & (F.arrays_overlap(F.array(*(F.col(c).cast("long") for c in columns)), F.array(*(F.lit(i).cast("long") for i in ids))) if ids else F.lit(False))
    return docs.where(cond)
