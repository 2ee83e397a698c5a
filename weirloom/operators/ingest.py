"""Ingestion: duplicate detection, chunk diffs, upserts, deletes and counters over immutable tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.sources.sinks import durable
from weirloom.sources.versions import BUCKET, Store


def chunk_id(kb: Column, doc: Column, digest: Column, occurrence: Column) -> Column:
    """One deterministic id for a chunk, the same in every store."""
    return F.sha2(F.concat_ws("|", kb.cast("string"), doc.cast("string"), digest, occurrence.cast("string")), 256)


def occurrences(chunks: DataFrame, *dealt: str) -> DataFrame:
    """chunks (doc, seq, hash) with the number of equal chunks before each in its document; dealt: columns that follow from doc and that the rows are dealt by."""
    return chunks.withColumn("occurrence", F.row_number().over(Window.partitionBy(*dealt, "doc", "hash").orderBy("seq")) - 1)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (doc, hash, occurrence, state): multiset difference as retained, removed or added."""
    a = occurrences(old).select("doc", "hash", "occurrence", F.lit(True).alias("was"))
    b = occurrences(new).select("doc", "hash", "occurrence", F.lit(True).alias("is"))
    both = a.join(b, ["doc", "hash", "occurrence"], "full_outer")
    state = F.when(F.col("was") & F.col("is"), "retained").when(F.col("was"), "removed").otherwise("added")
    return both.select("doc", "hash", "occurrence", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new in place of old rows of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: that of the largest order, ties by the whole row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("r")).select(*keys, "r.*")


def checked(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """vectors, with an error at run time for one of another dimension."""
    size = F.size(column)
    return vectors.withColumn(column, F.when(size == dimension, F.col(column)).otherwise(F.raise_error(F.format_string("dimension %d instead of %d", size, F.lit(dimension))).cast(vectors.schema[column].dataType)))


def deleted(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(ids.select(*keys).distinct(), keys, "left_anti")


def chunked(docs: DataFrame) -> DataFrame:
    """The lines of docs (doc, text) as chunks (doc, seq, content, hash): the default of sync."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("seq", "content")).withColumn("hash", F.sha2("content", 256))


def sync(store: Store, docs: DataFrame, kb: str, embed: Callable[[Column], Column], chunks: Callable[[DataFrame], DataFrame] = chunked) -> DataFrame:
    """Brings a store's documents, chunks and vectors to docs (doc, text), in one commit; (doc, state, added, removed, retained) of each document.

    Documents of unchanged digest are skipped. Of the others chunks are compared as multisets of
    (hash, occurrence): only new ones are embedded, only missing ones go. A document with an old
    chunk without hash is indexed anew as a whole. Buckets without changes keep their files.
    """
    commit = store.begin()
    spark, version = store.spark, commit.base
    digests = docs.select("doc", F.sha2("text", 256).alias("digest"))
    known = store.read("documents", version)
    known = spark.createDataFrame([], digests.schema) if known is None else known
    both = digests.join(known.withColumnRenamed("digest", "before"), "doc", "full_outer")
    state = F.when(F.col("digest").eqNullSafe(F.col("before")), "skipped").when(F.col("before").isNull(), "new").when(F.col("digest").isNull(), "deleted").otherwise("changed")
    states = durable(both.select("doc", "digest", state.alias("state")))
    touched = states.where("state <> 'skipped'").select("doc")
    buckets = sorted(r["b"] for r in touched.select(store.bucket(F.col("doc")).alias("b")).distinct().collect())  # of a fixed number
    changed = docs if version == 0 else docs.join(touched, "doc", "left_semi")
    # whole texts are dealt by bucket, and their chunks are cut, numbered and written where they are
    bucket = store.bucket(F.col("doc"))
    fresh = occurrences(chunks(changed.repartition(bucket)).withColumn(BUCKET, bucket), BUCKET)
    fresh = fresh.withColumn("chunk_id", chunk_id(F.lit(kb), F.col("doc"), F.col("hash"), F.col("occurrence")))
    held, vectors = (store.read(n, version, buckets) for n in ("chunks", "vectors"))
    first = held is None
    held = spark.createDataFrame([], fresh.drop(BUCKET).schema) if first else held
    ours = held.join(touched, "doc", "left_semi").select("chunk_id", "doc", "hash")
    whole = ours.where("hash IS NULL").select("doc").distinct()
    marked = None
    if buckets:
        # contents are written once, as the new version's chunks, and all else is read from there
        commit.put("chunks", fresh, "doc", buckets, dealt=True)
        if not first:
            commit.add("chunks", held.join(touched, "doc", "left_anti"), "doc")
        written = commit.read("chunks", buckets)
        if first:
            marked, new = written.select("doc", F.lit(False).alias("was")), written
        else:
            old = ours.join(whole, "doc", "left_anti").select("chunk_id", F.lit(True).alias("was"))
            marked = written.select("chunk_id", "doc").join(touched, "doc", "left_semi").join(old, "chunk_id", "left")
            marked = durable(marked.withColumn("was", F.coalesce("was", F.lit(False))))
            new = written.join(marked.where("NOT was").select("chunk_id"), "chunk_id", "left_semi")
        added = new.select("chunk_id", "doc", embed(F.col("content")).alias("vec"))
        commit.put("documents", states.where("state <> 'deleted'").where(store.bucket(F.col("doc")).isin(buckets)).select("doc", "digest"), "doc", buckets)
        if first or vectors is None:
            commit.put("vectors", added, "doc", buckets, dealt=True)
        else:
            gone = ours.select("chunk_id").join(marked.where("was").select("chunk_id"), "chunk_id", "left_anti")
            commit.put("vectors", vectors.join(gone, "chunk_id", "left_anti").unionByName(added), "doc", buckets)
        commit.commit()
    if marked is None:
        marked = spark.createDataFrame([], fresh.select("doc", F.lit(False).alias("was")).schema)
    n_old = ours.groupBy("doc").agg(F.count("*").alias("old"))
    n_new = marked.groupBy("doc").agg(F.count_if(~F.col("was")).alias("added"), F.count_if("was").alias("retained"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = states.join(n_old, "doc", "left").join(n_new, "doc", "left").join(whole.withColumn("whole", F.lit(True)), "doc", "left")
    state = F.when(F.col("whole") & (F.col("state") == "changed"), "reindexed").otherwise(F.col("state"))
    return durable(out.select("doc", state.alias("state"), zero(F.col("added")).alias("added"), (zero(F.col("old")) - zero(F.col("retained"))).alias("removed"), zero(F.col("retained")).alias("retained")))


def cached_embeddings(store: Store, texts: DataFrame, model: str, embed: Callable[[Column], Column], now: float, ttl: float) -> tuple[DataFrame, int]:
    """(id, vec) of texts (id, text), and how many were embedded: those of which the store has no vector of this model younger than ttl seconds.

    Keys are digests of trimmed texts, so equal texts are embedded once. New vectors are added to
    the cache in one commit.
    """
    keyed = durable(texts.select("id", F.trim("text").alias("text"), F.sha2(F.trim("text"), 256).alias("digest")))
    commit = store.begin()
    cache = store.read("cache", commit.base)
    schema = "model string, digest string, at double, vec array<double>"
    cache = store.spark.createDataFrame([], schema) if cache is None else cache
    live = cache.where((F.col("model") == model) & (F.col("at") > now - ttl)).select("digest", "vec", "at")
    missing = keyed.groupBy("digest").agg(F.min("text").alias("text")).where("digest IS NOT NULL").join(live, "digest", "left_anti")
    made = durable(missing.select(F.lit(model).alias("model"), "digest", F.lit(float(now)).alias("at"), embed(F.col("text")).cast("array<double>").alias("vec")))
    n = made.count()
    if n:
        commit.add("cache", made, "digest").commit()
    every = live.unionByName(made.select("digest", "vec", "at")).groupBy("digest").agg(F.max_by("vec", "at").alias("vec"))
    return keyed.join(every, "digest").select("id", "vec"), n


def compact_cache(store: Store, now: float, ttl: float) -> None:
    """Only the latest vector of each (model, digest), and none older than ttl seconds; readers keep the version they have."""
    commit = store.begin()
    cache = store.read("cache", commit.base)
    if cache is not None:
        rows = cache.where(F.col("at") > now - ttl).groupBy("model", "digest").agg(F.max("at").alias("at"), F.max_by("vec", "at").alias("vec"))
        commit.put("cache", rows, "digest").commit()
