"""Full-text search by positional postings: (term, doc_id, positions) with document lengths.

Terms are the lower-cased runs of letters and digits of a text, positions their places in it.

* `rank_all`: documents that have all terms of a query, or contain it as it stands. Its rarest
  term's list gives the candidates, the others' lists are met by (term, doc_id), so a common
  term costs no more than the candidates. The score is the cover density: each smallest run of
  the text with all terms adds the number of terms over its length; a text that contains the
  query gets SUBSTRING more. The formula is the engine's own.
* `rank_any`: pages that have any keyword. Each page is read once with an automaton over all
  keywords; it adds n / (1 + n) for n places as a term, and bonuses for being a part of its
  content and of its title. A page goes against a block of queries at a time.

Defined results: null texts have no terms; queries without terms (or keywords) find nothing;
repeated terms of a query count once; ties are ordered by the document's id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.operators import trigrams
from weirloom.operators.patterns import _automaton
from weirloom.operators.retrieve import Scores, bounded, searched, top
from weirloom.sources.sinks import durable

SUBSTRING, IN_CONTENT, IN_TITLE = 0.2, 0.1, 0.3
TERM_GAPS = r"[^\p{L}\p{Nd}]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_GAPS), lambda t: t != "")


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, positions, n_terms) of docs (doc_id, text), for the wanted terms or all: positions ascend, n_terms is the document's length."""
    rows = docs.select("doc_id", terms(F.col("text")).alias("own"))
    placed = rows.select("doc_id", F.size("own").alias("n_terms"), F.posexplode("own").alias("pos", "term"))
    if wanted is not None:
        placed = placed.join(bounded(wanted.select("term").distinct()), "term", "left_semi")
    return placed.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("n_terms").alias("n_terms"))


def _covers(occurrences: Column, n: Column) -> Column:
    """The sum over smallest runs with all n terms of n over their length; occurrences: array<struct<pos, term>> by position, terms numbered from 0."""
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == x["term"], x["pos"]).otherwise(p))
        begun = F.array_min(last)
        fresh = (begun >= 0) & (begun > acc["start"])
        return F.struct(last.alias("last"), F.when(fresh, begun).otherwise(acc["start"]).alias("start"), F.when(fresh, acc["score"] + n / (x["pos"] - begun + 1)).otherwise(acc["score"]).alias("score"))

    return F.aggregate(occurrences, start, step, lambda acc: acc["score"])


def rank_all(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """queries (query_id, query), docs (doc_id, text) -> (query_id, doc_id, score, rank)."""
    asked = queries.select("query_id", F.array_sort(F.array_distinct(terms(F.col("query")))).alias("own"))
    asked = asked.select("query_id", F.size("own").alias("n"), F.posexplode("own").alias("place", "term"))
    lists = durable(postings(docs, asked))
    sizes = lists.groupBy("term").agg(F.count("*").alias("docs"))
    known = durable(asked.join(sizes, "term", "left").select("query_id", "n", "place", "term", F.coalesce("docs", F.lit(0).cast("long")).alias("docs")))
    rarest = known.groupBy("query_id").agg(F.min_by("term", F.struct("docs", "term")).alias("term"), F.min("docs").alias("docs")).where("docs > 0").select("query_id", "term")
    met = lists.select("term", "doc_id").join(rarest, "term").select("query_id", "doc_id")
    every = met.join(known.select("query_id", "n", "place", "term"), "query_id").join(lists.select("term", "doc_id", "positions"), ["term", "doc_id"])
    places = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("place").alias("term")))))
    held = every.groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("has"), F.array_sort(places).alias("places")).where("has = n")
    covers = held.select("query_id", "doc_id", _covers(F.col("places"), F.col("n")).alias("score"))
    needles = queries.select(F.col("query_id").alias("item_id"), F.trim(F.lower("query")).alias("needle"))
    inside = trigrams.containing(needles, docs.select("doc_id", F.lower("text").alias("text"))).select(F.col("item_id").alias("query_id"), "doc_id", F.lit(SUBSTRING).alias("score"))
    scored = covers.unionByName(inside).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top(scored, k, ["query_id"], F.desc("score"), F.asc("doc_id"))


class KeywordScores:
    """Scores of pages (kb, title, content, in small letters) against a block of queries (kb, keywords); another base's pages score 0."""

    def __init__(self, block: pa.Table):
        own, bases = block.column("keywords").to_pylist(), block.column("kb").to_pylist()
        self.bases = np.array(bases, object)
        self.words = sorted({w for words in own for w in words})
        number = {w: i for i, w in enumerate(self.words)}
        pairs = np.array(sorted((number[w], q) for q, words in enumerate(own) for w in words), np.int64).reshape(-1, 2)
        self.queries, self.starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))
        self.number, self.made = number, None

    def __getstate__(self) -> dict:
        return vars(self) | {"made": None}  # each worker builds its own

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        self.made = self.made or _automaton(self.words)
        out = np.zeros((batch.num_rows, len(self.bases)))
        for i, (kb, title, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kb", "title", "content")), strict=True)):
            worth: dict[str, float] = {}
            for text, bonus in ((content, IN_CONTENT), (title, IN_TITLE)):
                for word in {w for _, w in self.made.iter(text or "")}:
                    worth[word] = worth.get(word, 0.0) + bonus
            times: dict[str, int] = {}
            for term in regex.findall(r"[\p{L}\p{Nd}]+", content or ""):
                if term in self.number:
                    times[term] = times.get(term, 0) + 1
            for term, n in times.items():
                worth[term] = worth.get(term, 0.0) + n / (1.0 + n)
            if worth:
                ids = np.array([self.number[w] for w in sorted(worth)])
                first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                value = np.repeat([worth[w] for w in sorted(worth)], size)
                out[i] = np.where(self.bases == kb, np.bincount(self.queries[at], weights=value, minlength=len(self.bases)), 0.0)
        return np.round(out, 9)


def rank_any(queries: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """queries (query_id, kb, keywords), pages (doc_id, kb, title, content) -> (query_id, kb, doc_id, score, rank): the k best pages of the base that each row asks."""

    def scorer(block: pa.Table) -> Scores:
        return KeywordScores(block)

    asked = queries.select(F.struct("query_id", "kb").alias("query_id"), "kb", F.array_distinct("keywords").alias("keywords")).where("size(keywords) > 0")
    given = pages.select("doc_id", "kb", F.lower("title").alias("title"), F.lower("content").alias("content"))
    return searched(asked, given, k, scorer, 0.0).select("query_id.query_id", "query_id.kb", "doc_id", "score", "rank")
