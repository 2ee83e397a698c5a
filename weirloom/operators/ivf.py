"""An inverted-file index over vectors: lists around centroids, compact codes, exact scores at the end.

`build` fits on a bounded sample and indexes every row: centroids of LISTS lists by spherical
k-means, and for each group of WIDTH dimensions a codebook of at most 256 words, so that a
vector becomes a byte for each group. The table is partitioned by list. How many lists a query
must probe for the target recall is measured on the sample too, since it depends on the
vectors: a handful where they form clusters, most lists where they fill their space evenly.

`search` scores the codes of the probed lists only (other partitions are not read), keeps RERANK
candidates a result row, fetches the vectors of these alone by an equi-join on (list, doc_id),
and ranks them by exact cosines. Queries go in blocks of QUERIES; the driver holds one block at
a time and each block's candidates are a table before the next begins. Lists that hold many
rows are many files, so no list is one task.

Defined results: rows and queries without a vector, or with one of another length than the
index, take no part; zero vectors score 0 with everything; ties are ordered by doc_id; an empty
corpus gives an index without lists and no results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.functions import vector
from weirloom.operators.retrieve import best_rows, top, unit_rows

#: Rows that centroids, codebooks and the number of probes are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Lists at most, dimensions of a codebook, rounds of k-means, candidates for each result, queries of a block, sought recall on the sample.
LISTS, WIDTH, ROUNDS, RERANK, QUERIES, RECALL = 4096, 4, 15, 8, 2000, 0.97


def _assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by Euclidean distance, a block of rows at a time."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


def _centres(rows: np.ndarray, k: int, seed: int, unit: bool) -> np.ndarray:
    """k-means from distinct rows; a centre without rows stays where it is. unit: centres of length 1."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS if len(distinct) > k else 0):
        own = _assign(rows, centres)
        order = np.argsort(own, kind="stable")
        found, starts = np.unique(own[order], return_index=True)
        centres[found] = np.add.reduceat(rows[order], starts, axis=0) / np.diff(np.append(starts, len(rows)))[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Index:
    """A built index: the folder of its lists and what was fitted."""

    path: str
    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([_assign(rows[:, i * WIDTH : (i + 1) * WIDTH], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def save(self, spark: SparkSession) -> None:
        rows = [("centroid", i, c.tolist()) for i, c in enumerate(self.centroids)] + [(f"book {n}", i, w.tolist()) for n, b in enumerate(self.books) for i, w in enumerate(b)] + [("probes", self.probes, [])]
        spark.createDataFrame(rows, "part string, place int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fitted")


def load(spark: SparkSession, path: str) -> Index:
    """The index that build wrote; what was fitted is of bounded size."""
    rows = sorted(spark.read.parquet(f"{path}/fitted").collect(), key=lambda r: r["place"])
    books = sorted({r["part"] for r in rows if r["part"].startswith("book")}, key=lambda p: int(p[5:]))
    of = lambda part: np.array([r["vec"] for r in rows if r["part"] == part])
    return Index(path, of("centroid"), [of(b) for b in books], next(r["place"] for r in rows if r["part"] == "probes"))


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10, queries: int = 400) -> int:
    """How many lists hold RECALL of the k nearest other sample rows of some sample rows."""
    if len(sample) < 2:
        return 1
    own, asked = np.argmax(sample @ centroids.T, axis=1), sample[:queries]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argpartition(-near, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[best], axis=1).reshape(-1)
    return int(np.quantile(needed, RECALL, method="higher")) + 1


def build(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 0) -> Index:
    """Indexes vectors (doc_id, vec) below path."""
    given = vectors.select("doc_id", F.col("vec").cast("array<double>").alias("vec")).where("size(vec) > 0")
    shape = given.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, total = (shape["size"], shape["count"]) if shape else (0, 0)
    given = given.where(F.size("vec") == size)
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, total))
    place = F.xxhash64("doc_id", F.lit(seed))
    drawn = given.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(place).limit(SAMPLE_ROWS)
    sample = unit_rows(drawn.select("vec").toArrow().column("vec")) if size else np.zeros((0, 0))
    centroids = _centres(sample, lists or min(LISTS, max(1, round(total**0.5))), seed, unit=True) if size else np.zeros((0, 0))
    books = [_centres(sample[:, a : a + WIDTH], 256, seed, unit=False) for a in range(0, size, WIDTH)]
    index = Index(path, centroids, books, min(len(centroids), _probes(sample, centroids)) if size else 0)
    index.save(given.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("vec"))
            codes = index.codes(rows)
            own = np.argmax(rows @ index.centroids.T, axis=1).astype(np.int32)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("vec"), packed, pa.array(own)], ["doc_id", "vec", "code", "list"])

    kind = given.schema["doc_id"].dataType.simpleString()
    coded = given.mapInArrow(run, f"doc_id {kind}, vec array<double>, code binary, list int")
    coded.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    return index


def candidates(queries: DataFrame, index: Index, keep: int, probes: int | None = None) -> DataFrame:
    """(query_id, doc_id, list): the `keep` documents of each query's probed lists with the best scores by code."""
    spark = queries.sparkSession
    ids = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).where(F.size("query_vec") == index.size)
    blocks = -(-asked.count() // QUERIES) if index.size else 0
    schema = f"query_id {ids}, doc_id {{}}, list int, score double"
    if not blocks:
        return spark.createDataFrame([], schema.format("long")).select("query_id", "doc_id", "list")
    stored = spark.read.parquet(f"{index.path}/lists").select("doc_id", "code", "list")
    folder = f"{index.path}/found-{uuid.uuid4().hex}"
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()
        if not len(block):
            continue
        names, rows = block.column("query_id").combine_chunks(), unit_rows(block.column("query_vec"))
        order = np.argsort(-(rows @ index.centroids.T), axis=1, kind="stable")[:, : probes or index.probes]
        probed = {int(x): np.flatnonzero((order == x).any(axis=1)) for x in np.unique(order)}

        def run(batches: Iterator[pa.RecordBatch], names: pa.Array = names, rows: np.ndarray = rows, probed: dict = probed, books: list = index.books) -> Iterator[pa.RecordBatch]:
            tables = np.stack([np.pad(rows[:, i * WIDTH : (i + 1) * WIDTH] @ b.T, ((0, 0), (0, 256 - len(b)))) for i, b in enumerate(books)]).astype(np.float32)
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
                lists, ordered = batch.column("list").to_numpy(), pc.sort_indices(batch.column("doc_id")).to_numpy()
                for one in np.unique(lists):
                    asked_by, at = probed.get(int(one)), ordered[lists[ordered] == one]
                    if asked_by is None:
                        continue
                    for a in range(0, len(asked_by), 256):
                        who = asked_by[a : a + 256]
                        value = sum(t[who][:, codes[at, i]] for i, t in enumerate(tables))
                        row, query = best_rows(value.T, np.arange(len(at)), keep, -np.inf)
                        chosen = pa.array(at[row])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(who[query])), batch.column("doc_id").take(chosen), batch.column("list").take(chosen), pa.array(value[query, row].astype(np.float64))], ["query_id", "doc_id", "list", "score"])

        one = stored.where(F.col("list").isin([*probed])).mapInArrow(run, schema.format(stored.schema["doc_id"].dataType.simpleString()))
        top(one, keep, ["query_id"], F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "list").write.parquet(f"{folder}/block={number}")
    return spark.read.parquet(folder).drop("block")


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """queries (query_id, query_vec) -> (query_id, doc_id, score, rank): the k best documents by exact cosine among the candidates."""
    spark = queries.sparkSession
    found = candidates(queries, index, k * rerank, probes)
    if not index.size:
        return found.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    stored = spark.read.parquet(f"{index.path}/lists").select("list", "doc_id", vector.unit(F.col("vec")).alias("cv"))
    asked = queries.where("query_vec IS NOT NULL").select("query_id", vector.unit(F.col("query_vec")).alias("qv"))
    met = found.join(stored, ["list", "doc_id"]).join(asked, "query_id")
    scored = met.select("query_id", "doc_id", F.round(vector.dot(F.col("qv"), F.col("cv")), 9).alias("score"))
    return top(scored, k, ["query_id"], F.desc("score"), F.asc("doc_id"))
