"""A training corpus in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run()
writes what a stage returns to the shared folder and hands the reread table on.

1. quality rules: documents that the base rules or the isolation forest reject go;
2. n-gram Jaccard join: of each group of near copies, the document of the smallest id stays;
3. PII: every span of personal data in the text becomes its kind in brackets;
4. mixing: documents get the copies that the fitted rates give them, without exceptions;
5. SentencePiece: ids of the best segmentation, scores of the N best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.llm import mixing, ngram_join, pieces, pii, quality_rules
from weirloom.llm.common import bounded_batches, durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shares of good, poor and toxic tokens after mixing; the quality rules have left hardly any poor ones by then.
WEIGHTS = (0.997, 0.001, 0.002)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with verdict kept; null and empty texts fail the base rule."""
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select(*COLUMNS), forest).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that link to no other, and one row of each group of near copies, that of the smallest id. Rows are told apart by all their columns, not by their id, which several may share."""
    bounded_batches(spark)
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    found = rows.join(ngram_join.linked_rows(rows, "row"), "row", "left")
    among = F.row_number().over(Window.partitionBy("row").orderBy("row"))  # above 1 for equal rows
    return found.withColumn("among", among).where("first IS NULL OR first AND among = 1").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with redacted texts and their new number of characters."""
    out = pii.annotate(docs.select(*COLUMNS)).withColumn("text", pii.redacted(F.col("text"), F.col("pii_spans")))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies say. The classifier learns from all labelled documents of the table, also those that earlier stages dropped."""
    out = mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents").select("doc_id", "text"), weights=WEIGHTS)
    return out.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))).select(*COLUMNS)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids and nbest_scores of every document."""
    bounded_batches(spark)
    out = pieces.encode(docs.select("doc_id", "source", "text"), pieces.broadcast(spark))
    return out.select("doc_id", "source", "n_pieces", "ids", "nbest_scores")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("PII", personal_data), ("mixing sources", mixture), ("SentencePiece", segmentation)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage-{i + 1}")
    return docs


#: The forest, the span classifier and the mixing rates are fitted models, which SQL cannot express.
ORACLE_SQL = None
