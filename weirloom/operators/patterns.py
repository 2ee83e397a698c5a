"""Many patterns in many texts: an automaton over the patterns reads each text once.

Patterns are the smaller side. They go to the tasks in blocks of BLOCK_CHARS characters at
most, as text; a Python worker builds the automaton of a block when it first meets it. With one
block the search is a single pass over the texts; with more, each block's matches become a
table before the next block begins, so the driver never holds two.

Defined results: null and empty patterns match nothing, null texts contain nothing; equal
patterns with different ids all match; ids may repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirloom.sources.sinks import scratch

#: Characters of the patterns of a block. An automaton takes some hundred bytes for each.
BLOCK_CHARS = 1 << 20
#: The automaton that a worker built last, by block.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def found_in(text: str, made: ahocorasick.Automaton) -> set[str]:
    return {p for _, p in made.iter(text)}


def distinct_blocks(patterns: DataFrame) -> int:
    total = patterns.agg(F.sum(F.char_length("pattern").cast("long"))).first()[0] or 0
    return -(-total // BLOCK_CHARS)


def matches(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, pattern_id), each pair once, for patterns (pattern_id, pattern) and texts (text_id, text)."""
    spark = texts.sparkSession
    own = patterns.where("pattern <> ''").select("pattern").distinct()
    blocks = distinct_blocks(own)
    id_kind = texts.schema["text_id"].dataType.simpleString()
    schema = f"text_id {id_kind}, pattern string"

    def search(block: list[str]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = _automaton(block)
            made = _BUILT[name]
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for p in found_in(text, made) if text else ():
                        at.append(i)
                        hits.append(p)
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], ["text_id", "pattern"])

        return texts.select("text_id", "text").mapInArrow(run, schema)

    if blocks == 0:
        found = spark.createDataFrame([], schema)
    elif blocks == 1:
        found = search([r["pattern"] for r in own.collect()])
    else:
        path = scratch(spark)
        for i in range(blocks):
            search([r["pattern"] for r in own.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i).collect()]).write.parquet(f"{path}/block={i}")
        found = spark.read.parquet(path).drop("block")
    return found.join(patterns.select("pattern_id", "pattern"), "pattern").select("text_id", "pattern_id")


def within(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, name_id): the names (name_id, name) that texts (text_id, text) contain, where the texts are the smaller side and short.

    Substrings of the lengths that names have are met with the names in an equi-join, so the names are not sent anywhere.
    """
    lengths = [r["n"] for r in names.where("name <> ''").select(F.char_length("name").alias("n")).distinct().collect()]
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = sorted({text[a : a + n] for n in lengths for a in range(len(text) - n + 1)}) if text else []
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array([i] * len(parts), pa.int64())), pa.array(parts, pa.string())], ["text_id", "name"])

    parts = texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, name string")
    return parts.join(names.select("name_id", "name"), "name").select("text_id", "name_id")
