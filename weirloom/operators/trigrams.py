"""Substring search by trigram posting lists.

A text that contains a needle contains all of the needle's trigrams. Trigrams are of UTF-8
bytes, so they are numbers below 2^24 in any script; needles of one or two bytes have numbers
of their own above. Three passes over the texts, none of which pairs texts with needles:

1. In how many texts each trigram of any needle occurs. A task sends one sum for each, and a
   set of numbers of bounded size (a bit for each) tells it which ones to count.
2. Posting lists (gram, doc_id) of the RAREST trigrams of each needle alone.
3. Texts that have all of a needle's rarest trigrams are candidates, and are compared with it.

Lists and needles meet in an equi-join on the trigram, where Spark splits the lists of common
ones; needles are broadcast only while they are few.

Defined results: a null text contains nothing; empty and null needles are in no text; ids of
needles are unique, ids of texts too; case is the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.operators.retrieve import bounded
from weirloom.sources.sinks import durable

#: Rarest trigrams of a needle whose lists are met.
RAREST = 4
#: Bytes of a text that are cut into trigrams at once.
PIECE = 1 << 20
#: Where the numbers of pairs and of single bytes begin, and end.
PAIRS, SINGLES, END = 1 << 24, (1 << 24) + (1 << 16), (1 << 24) + (1 << 16) + (1 << 8)


def grams(text: bytes, sizes: tuple[int, ...] = (3,)) -> np.ndarray:
    """The distinct numbers of a text's trigrams, and of its pairs and single bytes if asked for."""
    found = []
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text, np.uint8, min(PIECE + 2, len(text) - at), at).astype(np.int32)
        if 3 in sizes and len(b) > 2:
            found.append(np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]))
        if 2 in sizes and len(b) > 1:
            found.append(np.unique(PAIRS + ((b[:-1] << 8) | b[1:])))
        if 1 in sizes:
            found.append(np.unique(SINGLES + b))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def needle_grams(needles: DataFrame) -> DataFrame:
    """(item_id, gram) of needles (item_id, needle): trigrams, or the needle itself where it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams(n.encode(), (min(3, len(n.encode())),)) if n else np.zeros(0, np.int32) for n in batch.column("needle").to_pylist()]
            rows = np.repeat(np.arange(len(own)), [len(g) for g in own])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int32))], ["item_id", "gram"])

    return needles.select("item_id", "needle").mapInArrow(run, f"item_id {needles.schema['item_id'].dataType.simpleString()}, gram int")


def _bits(wanted: DataFrame) -> tuple[bytes, tuple[int, ...]]:
    """A bit for each number that wanted (gram) holds, and the sizes among them: two megabytes at most."""
    held = np.zeros(END, bool)
    for batch in wanted.select("gram").distinct().toArrow().to_batches():
        held[batch.column("gram").to_numpy()] = True
    sizes = tuple(n for n, (a, b) in {3: (0, PAIRS), 2: (PAIRS, SINGLES), 1: (SINGLES, END)}.items() if held[a:b].any())
    return np.packbits(held).tobytes(), sizes


def _found(docs: DataFrame, wanted: DataFrame, count: bool) -> DataFrame:
    """Of docs (doc_id, text), the postings (gram, doc_id) of the wanted grams, or (gram, docs), their counts a task."""
    packed, sizes = _bits(wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(packed, np.uint8), count=END).astype(bool)
        times = np.zeros(END if count else 0, np.int64)
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                own = grams(text.as_py() or b"", sizes)
                own = own[held[own]]
                if count:
                    times[own] += 1
                elif len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("doc_id").take(pa.array(np.full(len(own), at)))], ["gram", "doc_id"])
        if count:
            known = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(times[known])], ["gram", "docs"])

    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "gram int, docs long" if count else f"gram int, doc_id {kind}")


def candidates(needles: DataFrame, docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item_id, doc_id): the texts that have all of the rarest trigrams of a needle."""
    asked = durable(needle_grams(needles.where("needle <> ''")))
    counts = _found(docs, asked, count=True).groupBy("gram").agg(F.sum("docs").alias("docs"))
    # a needle with a trigram that no text has is in no text
    rare = asked.join(counts, "gram", "left").withColumn("docs", F.coalesce("docs", F.lit(0).cast("long")))
    order = Window.partitionBy("item_id").orderBy("docs", "gram")
    chosen = rare.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rarest).select("item_id", "gram", "docs")
    chosen = durable(chosen.withColumn("least", F.min("docs").over(Window.partitionBy("item_id"))).where("least > 0").withColumn("grams", F.count("*").over(Window.partitionBy("item_id"))).select("item_id", "gram", "grams"))
    met = _found(docs, chosen, count=False).join(bounded(chosen), "gram")
    return met.groupBy("item_id", "doc_id", "grams").agg(F.count("*").alias("n")).where("n = grams").select("item_id", "doc_id")


def containing(needles: DataFrame, docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item_id, doc_id, needle, text): the texts that contain a needle."""
    found = durable(candidates(needles, docs, rarest))
    texts = docs.select("doc_id", "text").join(found, "doc_id")
    return texts.join(bounded(needles.select("item_id", "needle")), "item_id").where(F.contains("text", "needle")).select("item_id", "doc_id", "needle", "text")
