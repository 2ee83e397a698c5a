"""Ingestion queries: documents against a changed snapshot of themselves."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.functions import vector
from weirloom.operators import imports
from weirloom.operators import ingest as I
from weirloom.operators import retrieve as R
from weirloom.plans.registry import query, table
from weirloom.sources import documents as D
from weirloom.sources import sinks
from weirloom.sources.sinks import scratch
from weirloom.sources.versions import Store

# chunks are the lines of documents; in the new snapshot every fifth document lost its first line and every seventh gained a copy of it
_OLD = "old AS (SELECT doc_id AS doc, unnest(range(0, len(l))) AS seq, sha256(unnest(l)) AS hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_NEW = "new AS (SELECT doc, seq, hash FROM old WHERE NOT (doc % 5 = 0 AND seq = 0) UNION ALL SELECT doc, 100000, hash FROM old WHERE doc % 7 = 0 AND seq = 0)"
_OCC = "o AS (SELECT doc, hash, row_number() OVER (PARTITION BY doc, hash ORDER BY seq) - 1 AS k FROM old), n AS (SELECT doc, hash, row_number() OVER (PARTITION BY doc, hash ORDER BY seq) - 1 AS k FROM new)"
_DIFF = f"WITH {_OLD}, {_NEW}, {_OCC}, d AS (SELECT coalesce(o.doc, n.doc) AS doc, CASE WHEN o.doc IS NOT NULL AND n.doc IS NOT NULL THEN 'retained' WHEN o.doc IS NOT NULL THEN 'removed' ELSE 'added' END AS state FROM o FULL JOIN n ON o.doc = n.doc AND o.hash = n.hash AND o.k = n.k)"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "line")).select("doc", "seq", F.sha2("line", 256).alias("hash"))
    first = F.col("seq") == 0
    new = old.where(~((F.col("doc") % 5 == 0) & first)).union(old.where((F.col("doc") % 7 == 0) & first).select("doc", F.lit(100000), "hash"))
    return old, new


@query("j7_chunk_diff", f"{_DIFF} SELECT doc, count(*) FILTER (WHERE state = 'retained') AS retained, count(*) FILTER (WHERE state = 'removed') AS removed, count(*) FILTER (WHERE state = 'added') AS added FROM d GROUP BY doc")
def chunk_diff(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return I.diff(*snapshots(spark, sf)).groupBy("doc").agg(n("retained"), n("removed"), n("added"))


#: The documents as they were, and as they are now: every fifth changed, every seventh new since then, every eleventh gone.
_WAS = "was AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN 'a line of before' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"
_NOW = "now AS (SELECT doc_id AS doc, text FROM documents WHERE doc_id % 11 <> 0)"
_LINES = "(SELECT doc, line, count(*) AS n FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM {}) GROUP BY ALL)"


def synced(spark: SparkSession, sf: str) -> tuple[Store, DataFrame]:
    """A store with the documents as they were as version 1 and as they are as version 2, and what the second commit did."""
    docs = R.spread(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    store = Store(spark, scratch(spark))
    before = docs.where("doc % 7 <> 0").withColumn("text", F.when(F.col("doc") % 5 == 0, F.concat(F.lit("a line of before\n"), "text")).otherwise(F.col("text")))
    I.sync(store, before, "kb", vector.letter_frequencies)
    return store, I.sync(store, docs.where("doc % 11 <> 0"), "kb", vector.letter_frequencies)


@query("q18_incremental_sync", f"WITH {_WAS}, {_NOW}, a AS {_LINES.format('was')}, b AS {_LINES.format('now')}, k AS (SELECT coalesce(a.doc, b.doc) AS doc, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS added, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS removed, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS retained FROM a FULL JOIN b ON a.doc = b.doc AND a.line = b.line GROUP BY 1), s AS (SELECT coalesce(was.doc, now.doc) AS doc, CASE WHEN was.text = now.text THEN 'skipped' WHEN was.doc IS NULL THEN 'new' WHEN now.doc IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM was FULL JOIN now ON was.doc = now.doc) SELECT doc, state, CASE WHEN state = 'skipped' THEN 0 ELSE added END AS added, CASE WHEN state = 'skipped' THEN 0 ELSE removed END AS removed, CASE WHEN state = 'skipped' THEN 0 ELSE retained END AS retained FROM s JOIN k USING (doc)")
def incremental_sync(spark: SparkSession, sf: str) -> DataFrame:
    """What a second import does to each document: skip by digest, else chunk differences, vectors of new chunks only."""
    return synced(spark, sf)[1]


@query("k5_commit_of_tables", f"WITH {_WAS}, {_NOW}, x AS (SELECT 1 AS version, doc, text FROM was UNION ALL SELECT 2, doc, text FROM now), c AS (SELECT version, unnest(string_split(text, chr(10))) FROM x) SELECT version, 'documents' AS name, count(*) AS n FROM x GROUP BY version UNION ALL SELECT version, 'chunks', count(*) FROM c GROUP BY version UNION ALL SELECT version, 'vectors', count(*) FROM c GROUP BY version")
def commit_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of documents, chunks and vectors at both versions of a store: they change together."""
    store, _ = synced(spark, sf)
    counts = [store.read(n, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(n).alias("name"), "n") for v in (1, 2) for n in ("documents", "chunks", "vectors")]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


_USER = "u AS (SELECT sha256(trim(text)) AS d, conv_id % 2 = 0 AS early FROM conversations WHERE role = 'user')"


@query("e7_embedding_cache", f"WITH {_USER}, e AS (SELECT DISTINCT d FROM u WHERE early), a AS (SELECT DISTINCT d FROM u) SELECT 1 AS run, (SELECT count(*) FROM u WHERE early) AS texts, (SELECT count(*) FROM e) AS embedded UNION ALL SELECT 2, (SELECT count(*) FROM u), (SELECT count(*) FROM a) - (SELECT count(*) FROM e) UNION ALL SELECT 3, (SELECT count(*) FROM u), (SELECT count(*) FROM e) UNION ALL SELECT 4, (SELECT count(*) FROM u), 0")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Four runs over user messages with a cache of a day: half of the sessions, all an hour later, all when the first half's vectors have expired, and once more after the cache was compacted."""
    texts = table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text", "conv_id")
    store, day, hour, rows = Store(spark, scratch(spark)), 86_400.0, 3600.0, []
    for run, given, now in ((1, texts.where("conv_id % 2 = 0"), 0.0), (2, texts, hour), (3, texts, day + 60), (4, texts, day + 120)):
        found, n = I.cached_embeddings(store, given.drop("conv_id"), "letters", vector.letter_frequencies, now, day)
        rows.append((run, found.count(), n))
        if run == 3:
            I.compact_cache(store, now, day)
    return spark.createDataFrame(rows, "run int, texts long, embedded long")


@query("w2_occurrence_index", f"WITH {_OLD} SELECT doc, seq, row_number() OVER (PARTITION BY doc, hash ORDER BY seq) - 1 AS occurrence FROM old")
def occurrence_index(spark: SparkSession, sf: str) -> DataFrame:
    return I.occurrences(snapshots(spark, sf)[0]).select("doc", "seq", "occurrence")


@query("u4_multiset_operations", f"WITH {_OLD}, {_NEW}, a AS (SELECT doc, hash FROM old), b AS (SELECT doc, hash FROM new) SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'gone', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'come', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def multiset(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (x.select("doc", "hash") for x in snapshots(spark, sf))
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(a.intersectAll(b), "both").union(n(a.exceptAll(b), "gone")).union(n(b.exceptAll(a), "come"))


#: Records of imports: even documents are known, odd ones come in. Every third is a url, every tenth has failed, every seventeenth has no hash.
_RECORD = "doc_id AS id, lang AS kb, CASE WHEN doc_id % 3 = 0 THEN 'url' WHEN doc_id % 41 = 0 THEN 'text' ELSE 'file' END AS source_type, source || '/' || n_chars % 40 AS file_name, CASE WHEN doc_id % 4 < 2 THEN '' ELSE 'http://' || source || '/' || n_chars % 40 END AS url, 'http://' || source || '/' || n_chars % 40 AS metadata_url, CASE WHEN doc_id % 10 = 4 THEN 'failed' ELSE 'completed' END AS status, n_chars % 9 AS chunks"
_RECORDS = f"r AS (SELECT {_RECORD}, CASE WHEN doc_id % 17 = 0 THEN '' ELSE sha256(text) END AS hash FROM documents), old AS (SELECT * FROM r WHERE id % 2 = 0), new AS (SELECT * FROM r WHERE id % 2 = 1)"


def records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "documents").select(F.expr(f"struct({_RECORD}) AS r"), F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.sha2("text", 256)).alias("hash"))
    rows = rows.select("r.*", "hash").withColumn("at", F.col("id"))
    return rows.where("id % 2 = 1"), rows.where("id % 2 = 0")


@query("q17_exact_duplicates", f"WITH {_RECORDS}, l AS (SELECT kb, hash, max_by(struct_pack(id := id, status := status), id) AS last FROM old WHERE source_type = 'file' AND hash <> '' GROUP BY ALL) SELECT new.id, CASE WHEN new.source_type = 'file' AND last.status = 'completed' THEN last.id END AS duplicate_of FROM new LEFT JOIN l USING (kb, hash)")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a completed record of the same base already holds."""
    return imports.duplicates(*records(spark, sf))


_NAMED = "CASE source_type WHEN 'file' THEN nullif(file_name, '') WHEN 'url' THEN coalesce(nullif(url, ''), nullif(metadata_url, '')) END AS name"


@query("q19_same_source_replace", f"WITH {_RECORDS}, o AS (SELECT *, {_NAMED} FROM old), l AS (SELECT kb, source_type, name, max_by(struct_pack(id := id, hash := hash, chunks := chunks), id) AS last FROM o WHERE name IS NOT NULL GROUP BY ALL), n AS (SELECT *, {_NAMED} FROM new) SELECT n.id, coalesce(last.id, n.id) AS use_id, last IS NOT NULL AS replaces, coalesce(nullif(n.hash, ''), last.hash) AS hash, coalesce(last.chunks, 0) AS chunks FROM n LEFT JOIN l ON l.kb = n.kb AND l.source_type = n.source_type AND l.name = n.name")
def same_source(spark: SparkSession, sf: str) -> DataFrame:
    """Files by name and urls by address take over the record they replace."""
    return imports.replacements(*records(spark, sf))


_UP = "u AS (SELECT vec_id + 250 AS vec_id, label + 100 AS label FROM embeddings WHERE label < 5)"


@query("k1_vector_upsert", f"WITH {_UP} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM u) UNION ALL SELECT * FROM u")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = I.checked(table(spark, sf, "embeddings"), "embedding", 64)
    new = old.where("label < 5").withColumns({"vec_id": F.col("vec_id") + 250, "label": F.col("label") + 100})
    return I.upsert(old, new, ["vec_id"]).where(F.size("embedding") == 64).select("vec_id", "label")


@query("k2_last_write_wins", "SELECT user_id, event_type, max_by(value, struct_pack(ts := ts, id := event_id)) AS value FROM events GROUP BY ALL")
def last_write(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return I.last_write(rows, ["user_id", "event_type"], "ts").select("user_id", "event_type", "value")


@query("k3_deletes", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang <> 'es'")
def deletes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return I.deleted(docs, table(spark, sf, "labels").where("toxic = 1"), ["doc_id"]).where("lang <> 'es'").select("doc_id")


@query("k4_chunk_upsert", "WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(n.k, o.k) AS k, round(coalesce(n.v, o.v), 4) AS v FROM o FULL JOIN n ON o.k = n.k")
def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return I.upsert(o.where("k % 2 = 0"), o.where("k % 3 = 0").withColumn("v", F.col("v") * 2), ["k"]).select("k", F.round("v", 4).alias("v"))


@query("k6_link_replacement", "SELECT src, dst FROM (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 4 <> 0 UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def link_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """All links of a replaced page go before its new ones come."""
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    new = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    gone = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("src"))
    return I.deleted(links, gone, ["src"]).unionByName(new).distinct()


@query("k7_natural_key_upsert", "SELECT c_nationkey, c_mktsegment, max_by(c_name, c_custkey) AS name FROM customer GROUP BY ALL")
def natural_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")
    return I.last_write(rows, ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_nationkey", "c_mktsegment", F.col("c_name").alias("name"))


@query("k8_counters", f"{_DIFF} SELECT doc % 10 AS kb, sum(CASE state WHEN 'added' THEN 1 WHEN 'removed' THEN -1 ELSE 0 END)::BIGINT AS delta FROM d GROUP BY doc % 10")
def counters(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("state") == "added", 1).when(F.col("state") == "removed", -1).otherwise(0)
    return I.diff(*snapshots(spark, sf)).groupBy((F.col("doc") % 10).alias("kb")).agg(F.sum(step).alias("delta"))


@query("s19_changed_files", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR doc_id > 990")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are new or whose digest changed against the last snapshot."""
    now = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "!").otherwise("")), 256).alias("hash"))
    before = table(spark, sf, "documents").where("doc_id <= 990").select("doc_id", F.sha2("text", 256).alias("hash"))
    return now.join(before, ["doc_id", "hash"], "left_anti").select("doc_id")


@query("q15_ingest_plain_text", "SELECT doc_id, count(*) AS chunks, count(DISTINCT sha256(c)) AS distinct_chunks FROM (SELECT doc_id, substring(text, i + 1, 500) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 50), 450)) AS i FROM documents WHERE text <> '')) GROUP BY doc_id")
def ingest_text(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, digests, deterministic ids and a stand-in embedding, counted by document."""
    from weirloom.functions.vector import letter_frequencies
    from weirloom.operators.chunking import fixed_windows

    chunks = table(spark, sf, "documents").select(F.col("lang").alias("kb"), F.col("doc_id").alias("doc"), F.posexplode(fixed_windows(F.col("text"), 500, 50)).alias("seq", "chunk"))
    rows = I.occurrences(chunks.withColumn("hash", F.sha2("chunk", 256)))
    stored = rows.select("doc", "hash", I.chunk_id(F.col("kb"), F.col("doc"), F.col("hash"), F.col("occurrence")).alias("id"), letter_frequencies(F.col("chunk")).alias("vec"))
    return stored.groupBy(F.col("doc").alias("doc_id")).agg(F.countDistinct("id").alias("chunks"), F.countDistinct("hash").alias("distinct_chunks"))


@query("w8_overlap_prefix", f"WITH {_OLD.replace('sha256(unnest(l)) AS hash', 'unnest(l) AS line')} SELECT doc, seq, right(coalesce(lag(line) OVER (PARTITION BY doc ORDER BY seq), ''), 10) || line AS chunk FROM old")
def overlap_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    before = F.lag("line").over(Window.partitionBy("doc").orderBy("seq"))
    return rows.select("doc", "seq", F.concat(F.right(F.coalesce(before, F.lit("")), F.lit(10)), "line").alias("chunk"))


@query("w10_total_chunks", f"WITH {_OLD} SELECT doc, seq, count(*) OVER (PARTITION BY doc) AS total FROM old")
def total_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    return snapshots(spark, sf)[0].select("doc", "seq", F.count("*").over(Window.partitionBy("doc")).alias("total"))


@query("s1_text_files", "SELECT source AS folder, count(DISTINCT source) AS files, sum(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')))::BIGINT AS letters FROM documents GROUP BY source")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents written as text files, a folder for each source, and read back recursively: files and characters but white space, which lines and files are trimmed of."""
    path = f"{sinks.scratch(spark)}/texts"
    table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).repartition("source").write.partitionBy("source").text(path)
    rows = D.text_files(spark, path)
    rows = rows.select(F.regexp_extract("source", "/source=([^/]*)/", 1).alias("folder"), "id", F.char_length(F.regexp_replace("content", r"\s+", "")).alias("n"))
    return rows.groupBy("folder").agg(F.countDistinct("id").alias("files"), F.sum("n").cast("bigint").alias("letters"))


_SAMPLES = "x AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS n FROM benchmark WHERE item_id % 7 <> 3)"


@query("s12_eval_lines", f"WITH {_SAMPLES} SELECT CASE WHEN item_id % 5 = 0 THEN 'sample_' || n ELSE item_id::VARCHAR END AS id, text AS question, item_id % 3 AS n_gold, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'default' END AS category FROM x")
def eval_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Samples as JSON lines, some without id or category, some cut off, with blank lines and a byte order mark, read by the evaluation's loader."""
    gold = F.when(F.col("item_id") % 3 > 0, F.transform(F.sequence(F.lit(1), F.col("item_id") % 3), lambda i: F.concat(F.lit("d"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    own = F.to_json(F.struct(F.when(F.col("item_id") % 5 != 0, F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), gold.alias("gold_docs"), F.when(F.col("item_id") % 2 == 0, "even").alias("category")))
    line = F.when(F.col("item_id") % 7 == 3, F.left(own, F.lit(12))).when(F.col("item_id") % 4 == 0, F.concat(own, F.lit("\n  "))).otherwise(own)
    items = table(spark, sf, "benchmark")
    first = items.agg(F.min("item_id").alias("least"))
    lines = items.join(first).select(F.concat(F.when(F.col("item_id") == F.col("least"), "﻿").otherwise(""), line).alias("value"), "item_id")
    path = f"{scratch(spark)}/samples"
    lines.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    rows = D.evaluation_samples(spark, path)
    return rows.select("id", "question", F.size("gold_docs").cast("long").alias("n_gold"), "category")


@query("s11_query_set", "SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END AS n_gold FROM benchmark")
def query_set(spark: SparkSession, sf: str) -> DataFrame:
    """A query set as one JSON array over many lines; such files are small by their nature and read whole."""
    gold = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    item = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), gold.alias("gold_orig_doc_ids")))
    items = table(spark, sf, "benchmark")
    ends = items.agg(F.min("item_id").alias("least"), F.max("item_id").alias("most"))
    lines = items.join(ends).select("item_id", F.concat(F.when(F.col("item_id") == F.col("least"), "[").otherwise(""), item, F.when(F.col("item_id") == F.col("most"), "]").otherwise(",")).alias("value"))
    path = f"{scratch(spark)}/queries"
    lines.repartitionByRange(1, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    return D.query_set(spark, path).select("id", "question", F.size("gold_orig_doc_ids").alias("n_gold"))


@query("s13_judged_queries", "SELECT b.item_id::VARCHAR AS qid, count(*) AS n, sum(e.vec_id % 4)::BIGINT AS total FROM benchmark b JOIN embeddings e ON e.vec_id % 40 = b.item_id % 40 WHERE b.text <> '' AND e.vec_id % 9 <> 0 GROUP BY 1")
def judged_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A file of queries and one of judgements, with headers and lines without a number, through their loaders."""
    path = scratch(spark)
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    header = lambda text: spark.createDataFrame([(text,)], "value string")
    header("qid\ttext").union(b.select(F.concat_ws("\t", F.col("item_id").cast("string"), F.regexp_replace("text", r"\s+", " ")))).write.text(f"{path}/queries")
    pairs = e.join(b, e.vec_id % 40 == b.item_id % 40).select(F.concat_ws("\t", F.col("item_id").cast("string"), F.lit("0"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 9 == 0, "none").otherwise((F.col("vec_id") % 4).cast("string"))))
    header("qid\t0\tpid\trel").union(pairs).write.text(f"{path}/judged")
    judged = D.judgements(spark, f"{path}/judged").join(D.tab_queries(spark, f"{path}/queries").select("qid"), "qid", "left_semi")
    return judged.groupBy("qid").agg(F.count("*").alias("n"), F.sum("rel").alias("total"))


@query("s14_wanted_lines", "SELECT d.doc_id::VARCHAR AS id, md5(regexp_replace(d.text, '\\s+', ' ', 'g')) AS hash FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1")
def wanted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A large tab-separated file scanned by its loader for the ids that are wanted."""
    path = f"{scratch(spark)}/collection"
    table(spark, sf, "documents").select(F.concat_ws("\t", "doc_id", F.regexp_replace("text", r"\s+", " ")).alias("value")).write.text(path)
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("pid"))
    return D.wanted_passages(spark, path, wanted).select(F.col("pid").alias("id"), F.md5("text").alias("hash"))


@query("k9_jsonl_append", "SELECT event_id, event_type, user_id FROM events UNION ALL SELECT event_id, event_type, user_id FROM events")
def jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows appended twice as JSON lines and read back."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    path = os.path.join(sinks.scratch(spark), "audit")
    sinks.append_jsonl(rows, path)
    sinks.append_jsonl(rows, path)
    return spark.read.schema("event_id long, event_type string, user_id long").json(path)
