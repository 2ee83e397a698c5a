"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.llm import divergence, media_columns, mixing, ngram_join, page_text, pieces, pii, prefix_trie, quality_rules, quotes, suffix_dedup, url_rules, warc
from weirloom.llm.common import shared_dir, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.broadcast(spark)
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, verify=True, keep=["doc_id"])
    digest = F.sha2(F.array_join("ids", ","), 256)
    return out.select("doc_id", "n_pieces", F.array_join(F.transform("nbest_scores", lambda s: F.format_string("%.1f", s)), ",").alias("nbest_scores"), digest.alias("ids_sha256"), "round_trip")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.load(media_columns.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    shown = [F.round(c, 6).alias(c) for c in (*(f"p_{d}" for d in mixing.DOMAINS), "rate")]
    return out.select("doc_id", "n_tokens", *shown, "copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs, forest)
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.round("anomaly", 6).alias("anomaly"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [f"n_{k}" for k in pii.BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes, so every message is first written with the quotes that quoting() puts before it; text_sha256 is that of the text without them."""
    out = quotes.conversations(quotes.quoting(table(spark, sf_dir, "conversations")), texts=False)
    return out.select("conv_id", "turn", "role", "position", "reply_conv", "reply_turn", "n_quotes", "n_linked", F.col("own_sha256").alias("text_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.arrays(table(spark, sf_dir, "conversations"))))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monolithic files, then one member a record, then reads by offset."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), f"{folder}/monolithic")
    warc.normalise(spark, f"{folder}/monolithic", f"{folder}/records")
    rows = warc.resolve(warc.read(spark, f"{folder}/records"))
    return rows.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_media_columns": op3_media_columns,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_url_filters": op10_url_filters,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {"op5_ngram_jaccard_join": ngram_join.oracle(), "op9_quotation_linking": quotes.oracle(), "op10_url_filters": url_rules.oracle(), "op11_source_divergence": divergence.oracle(), "op12_prefix_trie": prefix_trie.oracle(), "op13_warc": warc.oracle()}
