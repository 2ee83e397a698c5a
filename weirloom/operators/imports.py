"""What an import does before it chunks: exact duplicates, replacement of the same source, graphs from extracted items.

Records are rows (id, kb, source_type, hash, ...); lookups are equi-joins on natural keys, of
which each side is first reduced to its latest record, so a key that many records share does not
multiply.

Defined results: empty and null hashes, names and urls match nothing; ties end on the larger id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.functions import text as T

ITEMS = "nodes array<struct<name:string,type:string,attributes:array<string>>>, relations array<struct<src:string,dst:string,type:string>>"


def duplicates(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(id, duplicate_of): the completed file record of the same base with the same hash, if the latest one with it is that.

    incoming (id, kb, source_type, hash), known (id, kb, source_type, hash, status, at). Only files can be duplicates.
    """
    latest = known.where("source_type = 'file' AND hash <> ''").groupBy("kb", "hash").agg(F.max_by(F.struct("id", "status"), F.struct("at", "id")).alias("last"))
    files = incoming.where("source_type = 'file'")
    found = files.join(latest, ["kb", "hash"]).where("last.status = 'completed'").select("id", F.col("last.id").alias("duplicate_of"))
    return incoming.select("id").join(found, "id", "left")


def _origin(url: Column, metadata_url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(metadata_url, F.lit("")))


def replacements(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(id, use_id, replaces, hash, chunks): files take the place of the record of their name, urls of that of their url, with its id, its number of chunks and, without a hash of their own, its hash.

    Both sides have (id, kb, source_type, file_name, url, metadata_url, hash), known also (chunks, at); other types are always new.
    """
    keyed = lambda rows: rows.withColumn("name", F.when(F.col("source_type") == "file", F.nullif("file_name", F.lit(""))).when(F.col("source_type") == "url", _origin(F.col("url"), F.col("metadata_url"))))
    latest = keyed(known).where("name IS NOT NULL").groupBy("kb", "source_type", "name").agg(F.max_by(F.struct("id", "hash", "chunks"), F.struct("at", "id")).alias("last"))
    rows = keyed(incoming).join(latest, ["kb", "source_type", "name"], "left")
    return rows.select("id", F.coalesce("last.id", "id").alias("use_id"), F.col("last").isNotNull().alias("replaces"), F.coalesce(F.nullif("hash", F.lit("")), F.col("last.hash")).alias("hash"), F.coalesce("last.chunks", F.lit(0).cast("long")).alias("chunks"))


def items(answers: DataFrame) -> DataFrame:
    """(chunk, nodes, relations, failed) of answers (chunk, answer): the JSON object in a model's text, from its first to its last brace. failed: there is none, or it cannot be read."""
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), ITEMS)
    rows = answers.select("chunk", parsed.alias("p"))
    failed = F.col("p").isNull() | (F.col("p.nodes").isNull() & F.col("p.relations").isNull())
    return rows.select("chunk", F.col("p.nodes").alias("nodes"), F.col("p.relations").alias("relations"), failed.alias("failed"))


def graph_nodes(found: DataFrame) -> DataFrame:
    """(name, type, chunks, attributes) merged over chunks: the type that the smallest chunk gives, all chunks' number, all attributes once; nameless nodes are left out."""
    each = found.where("NOT failed").select("chunk", F.explode("nodes").alias("x")).select("chunk", F.trim("x.name").alias("name"), F.col("x.type").alias("type"), F.col("x.attributes").alias("attributes")).where("name <> ''")
    merged = each.groupBy("name").agg(F.min_by("type", F.struct("chunk", "type")).alias("type"), F.countDistinct("chunk").alias("chunks"))
    labels = each.select("name", F.explode("attributes").alias("attribute")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("attribute")).alias("attributes"))
    return merged.join(labels, "name", "left").withColumn("attributes", F.coalesce("attributes", F.expr("CAST(array() AS array<string>)")))


def graph_relations(found: DataFrame) -> DataFrame:
    """(src, dst, type, n): relations whose two ends are nodes of their chunk, n the chunks that have them; types become names, loops and nameless ends are left out."""
    rows = found.where("NOT failed")
    names = rows.select("chunk", F.explode("nodes").alias("x")).select("chunk", F.trim("x.name").alias("name")).where("name <> ''").distinct()
    each = rows.select("chunk", F.explode("relations").alias("x")).select("chunk", F.trim("x.src").alias("src"), F.trim("x.dst").alias("dst"), T.relation_type(F.coalesce("x.type", F.lit(""))).alias("type")).where("src <> dst").distinct()
    known = each.join(names.withColumnRenamed("name", "src"), ["chunk", "src"], "left_semi").join(names.withColumnRenamed("name", "dst"), ["chunk", "dst"], "left_semi")
    return known.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))
