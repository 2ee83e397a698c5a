"""Versioned tables, sync in one commit and the embedding cache."""

import pytest
from pyspark.sql import functions as F

from weirloom.functions import vector
from weirloom.operators import ingest
from weirloom.sources.versions import Conflict, Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pinned_versions_conflicts_and_failed_writes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=4)
    assert store.version() == 0 and store.read("t") is None
    one, two = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b"), (None, "n")], [(3, "c")]))
    assert store.begin().put("t", one, "k").put("u", two, "k").commit() == 1
    slow = store.begin()
    assert store.begin().add("t", two, "k").commit() == 2
    slow.put("t", two, "k")
    with pytest.raises(Conflict):
        slow.commit()
    failing = store.begin()
    with pytest.raises(Exception, match="no luck"):
        failing.put("u", one.withColumn("v", F.raise_error(F.lit("no luck")).cast("string")), "k")
    assert store.version() == 2 and rows(store.read("t", 1)) == rows(one) and rows(store.read("t")) == rows(one.union(two)) and rows(store.read("u")) == rows(two)
    store.begin().put("u", two.limit(0), "k").commit()
    assert store.read("u").count() == 0


def test_sync_embeds_new_chunks_only_and_keeps_other_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=8)
    docs = lambda given: spark.createDataFrame(given, "doc long, text string")
    first = [(i, f"a{i}\nb\nb\n{'x' * i}") for i in range(12)] + [(50, None), (51, "")]
    ingest.sync(store, docs(first), "kb", vector.letter_frequencies)
    assert store.read("chunks").count() == store.read("vectors").count() == sum(len((t or "").split("\n")) for _, t in first if t is not None)
    second = [x for x in first if x[0] not in (3, 4)] + [(3, "a3\nb\nnew"), (90, "fresh")]
    out = {r["doc"]: tuple(r)[1:] for r in ingest.sync(store, docs(second), "kb", vector.letter_frequencies).collect()}
    assert out[3] == ("changed", 1, 2, 2) and out[4] == ("deleted", 0, 4, 0) and out[90] == ("new", 1, 0, 0) and out[5] == ("skipped", 0, 0, 0)
    want = sorted((d, line) for d, t in second if t is not None for line in t.split("\n"))
    assert sorted(map(tuple, store.read("chunks").select("doc", "content").collect())) == want
    assert rows(store.read("chunks").select("chunk_id")) == rows(store.read("vectors").select("chunk_id"))
    a, b = store.manifest(1)["chunks"], store.manifest(2)["chunks"]
    assert any(a[k] == b.get(k) for k in a if k != "schema")  # buckets without changes keep their files
    assert set(ingest.sync(store, docs(second), "kb", vector.letter_frequencies).select("state").distinct().toPandas()["state"]) == {"skipped"} and store.version() == 2


def test_documents_with_chunks_without_hash_are_indexed_anew(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc long, text string")
    ingest.sync(store, docs, "kb", vector.letter_frequencies)
    chunks = store.read("chunks").withColumn("hash", F.when((F.col("doc") == 1) & (F.col("seq") == 0), None).otherwise(F.col("hash")))
    store.begin().put("chunks", chunks, "doc").commit()
    out = {r["doc"]: tuple(r)[1:] for r in ingest.sync(store, docs.withColumn("text", F.concat("text", F.lit("\nend"))), "kb", vector.letter_frequencies).collect()}
    assert out == {1: ("reindexed", 3, 2, 0), 2: ("changed", 1, 0, 1)}
    assert store.read("chunks").where("hash IS NULL").count() == 0 and store.read("chunks").count() == 5 == store.read("vectors").count()


def test_cache_embeds_what_is_new_or_expired(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    texts = lambda given: spark.createDataFrame(list(enumerate(given)), "id long, text string")
    run = lambda given, now, model="m": ingest.cached_embeddings(store, texts(given), model, vector.letter_frequencies, now, 100)
    found, n = run(["ab", " ab ", "c"], 0)
    assert n == 2 and {r["id"]: r["vec"][0] for r in found.collect()} == {0: 0.5, 1: 0.5, 2: 0.0}
    assert run(["ab", "d"], 50)[1] == 1 and run(["ab", "c", "d"], 99)[1] == 0
    assert run(["ab", "d"], 120)[1] == 1  # d is younger
    assert run(["ab"], 120, "other")[1] == 1
    before = store.version()
    ingest.compact_cache(store, 120, 100)
    assert store.read("cache").count() == 3 and store.read("cache", before).count() == 5 and run(["ab", "d"], 121)[1] == 0


def test_sync_writes_contents_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(ingest, "durable", lambda rows, own=ingest.durable: (kept.append(rows.columns), own(rows))[1])
    store = Store(spark, f"file://{tmp_path}", buckets=2)
    given = [(i, f"a{i}\nb\nb") for i in range(8)]
    for rows in (given, given[2:] + [(0, "b\nc"), (9, "d")]):
        ingest.sync(store, spark.createDataFrame(rows, "doc long, text string"), "kb", vector.letter_frequencies)
    assert kept and not any({"content", "text", "vec"} & set(c) for c in kept)
    assert store.read("chunks").columns == store.read("chunks", 1).columns == ["doc", "seq", "content", "hash", "occurrence", "chunk_id"]
    assert sorted(map(tuple, store.read("chunks").where("doc IN (0, 9)").select("doc", "content").collect())) == [(0, "b"), (0, "c"), (9, "d")]
    assert store.read("chunks").count() == store.read("vectors").count() == 21
