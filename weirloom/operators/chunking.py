"""Chunkers: fixed windows, recursive separators, markdown headers, semantic breaks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.functions.text import sentences
from weirloom.operators.retrieve import spread

#: Fixed value: separators of the recursive chunker, coarse to fine.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", " ", ""]


def _starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows until one reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.floor(F.greatest(F.lit(0), length - overlap - 1) / step).cast("int") * step
    return F.sequence(F.lit(0), last, F.lit(step))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    return F.when(text != "", F.transform(_starts(F.char_length(text), size, overlap), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def positioned_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start_pos,end_pos,chunk>>, trimmed, blanks left out; an overlap of size or more becomes a fifth of it."""
    overlap = overlap if overlap < size else size // 5
    n = F.char_length(text)
    rows = F.transform(_starts(n, size, overlap), lambda i: F.struct(i.alias("start_pos"), F.least(i + size, n).alias("end_pos"), F.trim(F.substring(text, i + 1, F.lit(size))).alias("chunk")))
    return F.when(text != "", F.filter(rows, lambda w: w["chunk"] != "")).otherwise(F.array().cast("array<struct<start_pos:int,end_pos:int,chunk:string>>"))


def split_recursive(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS, level: int = 0) -> list[str]:
    """Greedy packing at the coarsest separator that occurs; pieces still too long go a level down. Overlap is put before each chunk but the first, at every level."""
    if len(text) <= size:
        return [text] if text.strip() else []
    while level < len(separators) - 1 and separators[level] not in text:
        level += 1
    sep = separators[level]
    if sep == "":
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), max(1, size - overlap))]
    chunks: list[str] = []
    held = ""
    for piece in text.split(sep):
        joined = held + sep + piece if held else piece
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            chunks.append(held)
        held = ""
        if len(piece) > size:
            chunks += split_recursive(piece, size, overlap, separators, level + 1)
        else:
            held = piece
    if held.strip():
        chunks.append(held)
    if overlap and len(chunks) > 1:
        chunks = chunks[:1] + [before[-overlap:] + own for before, own in zip(chunks, chunks[1:])]
    return chunks


def split_markdown(text: str, size: int) -> list[str]:
    """Chunks of lines below a header, prefixed by the path of headers; longer ones are flushed at a line's end."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    out: list[str] = []

    def flush() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body:
            head = " > ".join(t for _, t in path)
            out.append(body if body.startswith("#") or not head else f"[{head}]\n{body}")

    for line in text.split("\n"):
        if line.startswith("#"):
            flush()
            level = len(line) - len(line.lstrip("#"))
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, line[level:].strip()))
        held.append(line)
        if sum(map(len, held)) > size:
            flush()
    flush()
    return out


def _exploded(docs: DataFrame, split) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, i, c) for d, t in zip(p["doc_id"], p["text"]) for i, c in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "chunk"])

    return docs.mapInPandas(run, "doc_id long, seq int, chunk string")


def recursive(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _exploded(docs, lambda t: split_recursive(t, size, overlap))


def markdown(docs: DataFrame, size: int) -> DataFrame:
    return _exploded(docs, lambda t: split_markdown(t, size))


def contextual(text: Column, context: Column) -> Column:
    return F.concat(F.lit("[上下文: "), context, F.lit("]\n"), text)


#: Bytes of sentences that one pass of array operations takes at most, but for a longer single text.
SLICE_BYTES = 1 << 20


def letter_counts(sentences: pa.Array) -> np.ndarray:
    """How often each of a to z is in each sentence, without regard to case."""
    lower = pc.utf8_lower(sentences).cast(pa.large_binary())
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(lower)), np.diff(offsets))
    letter = (data >= 97) & (data <= 122)
    return np.bincount(row[letter] * 26 + (data[letter].astype(np.int64) - 97), minlength=26 * len(lower)).reshape(-1, 26)


def neighbour_similarity(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cosine of the letter shares of each sentence's window (with the ones before and after it) and of its predecessor's; at a text's first sentence it means nothing.

    A window's letters are those of its sentences. Terms are added from a to z, as `vector.cosine` does.
    """
    first = np.zeros(len(counts), bool)
    first[starts[starts < len(counts)]] = True
    around = counts.copy()
    around[1:] += np.where(first[1:, None], 0, counts[:-1])
    around[:-1] += np.where(first[1:, None], 0, counts[1:])
    n = around.sum(axis=1)
    shares = np.where(n[:, None] > 0, around / np.maximum(n, 1)[:, None], 0.0)
    norm, dot = np.zeros(len(counts)), np.zeros(max(len(counts) - 1, 0))
    for k in range(26):
        norm += shares[:, k] * shares[:, k]
        dot += shares[1:, k] * shares[:-1, k]
    norm = np.sqrt(norm)
    size = norm[1:] * norm[:-1]
    return np.concatenate([np.zeros(min(len(counts), 1)), np.where(size > 0, dot / np.where(size > 0, size, 1.0), 0.0)])


def _similar(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with a column `sentences`: each with its sentences, their offsets by row and the similarity of each to the one before."""
    lists = batch.column(batch.schema.get_field_index("sentences"))
    lists = lists.fill_null([]) if lists.null_count else lists
    offsets, every = lists.offsets.to_numpy(), lists.values
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False))])[offsets] if len(every) else np.zeros(len(offsets), np.int64)
    at = 0
    while at < batch.num_rows:
        to = min(max(int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1, at + 1), batch.num_rows)
        own = every.slice(offsets[at], offsets[to] - offsets[at])
        places = offsets[at : to + 1] - offsets[at]
        yield batch.slice(at, to - at), own, places, neighbour_similarity(letter_counts(own), places[:-1])
        at = to


def adjacent_similarity(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, seq, similarity of the letters around a sentence to those around the next; a text is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, places, similarity in _similar(batch):
                sizes = np.diff(places)
                row = np.repeat(np.arange(len(sizes)), sizes)
                seq = np.arange(len(own)) - places[row]
                later = seq > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[later])), pa.array(seq[later] - 1, pa.int32()), pa.array(similarity[later])], ["doc_id", "seq", "similarity"])

    found = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), sentences(F.col("text")).alias("sentences")).mapInArrow(run, "doc_id long, seq int, similarity double")
    return found.select("doc_id", "seq", F.round("similarity", 6).alias("similarity"))


def join_short(parts: list[str], least: int) -> list[str]:
    """Parts in order, each joined to the one before while that has fewer than `least` characters."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) < least:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def balanced(parts: Column, least: int) -> Column:
    """join_short for a column of arrays: in Python, as a fold in the JVM would copy the array at each step."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: None if own is None else join_short(list(own), least))

    return run(parts)


def split_large(chunks: DataFrame, most: int, overlap: int = 50) -> DataFrame:
    """chunks (doc_id, seq, chunk) with those of more than `most` characters split recursively, numbered anew."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, n, i, c) for d, n, t in zip(p["doc_id"], p["seq"], p["chunk"]) for i, c in enumerate(split_recursive(t, most, overlap) if len(t) > most else [t])]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "part", "chunk"])

    every = chunks.mapInPandas(run, "doc_id long, seq int, part int, chunk string")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part")) - 1
    return every.select("doc_id", number.alias("seq"), "chunk")


def semantic(docs: DataFrame, share: float = 0.25, least: int = 100, most: int = 1000) -> DataFrame:
    """Chunks of sentences, cut where neighbouring windows are among the least similar share of a document; small ones join the next, large ones are split. Fewer than three sentences are split recursively."""

    def cut(own: list[str], similarity: np.ndarray) -> list[str]:
        limit = np.sort(similarity[1:])[int((len(own) - 1) * share)]
        starts = [0, *(np.flatnonzero(similarity[1:] <= limit) + 1).tolist()]
        parts = [" ".join(own[a:b]) for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]
        return [c for chunk in join_short(parts, least) for c in (split_recursive(chunk, most, 50) if len(chunk) > most else [chunk])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, places, similarity in _similar(batch):
                texts, every, bounds = part.column("text").to_pylist(), own.to_pylist(), places.tolist()
                made = [cut(every[a:b], similarity[a:b]) if b - a >= 3 else split_recursive(t or "", most, 50) for t, a, b in zip(texts, bounds, bounds[1:])]
                sizes = np.array([len(m) for m in made], np.int64)
                row = np.repeat(np.arange(len(made)), sizes)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(seq, pa.int32()), pa.array([c for m in made for c in m], pa.string())], ["doc_id", "seq", "chunk"])

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", sentences(F.col("text")).alias("sentences"))
    enough = F.size("sentences") >= 3  # their texts are not needed beside their sentences
    return rows.select("doc_id", F.when(enough, None).otherwise(F.col("text")).alias("text"), "sentences").mapInArrow(run, "doc_id long, seq int, chunk string")


def dispatched(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs (doc_id, text, asked) -> doc_id, strategy, seq, chunk: by the strategy asked for, else markdown where the text has headers, else recursive."""
    headed = F.col("text").rlike(r"(?:^|\n)#{1,6} ")
    rows = docs.withColumn("strategy", F.when(F.col("asked").isin("markdown", "recursive", "semantic"), F.col("asked")).when(headed, "markdown").otherwise("recursive"))
    own = lambda name: rows.where(F.col("strategy") == name).select("doc_id", "text")
    made = {"markdown": markdown(own("markdown"), size), "recursive": recursive(own("recursive"), size, overlap), "semantic": semantic(own("semantic"))}
    out = None
    for name, part in made.items():
        part = part.select("doc_id", F.lit(name).alias("strategy"), "seq", "chunk")
        out = part if out is None else out.union(part)
    return out


def json_array_of(text: str) -> str | None:
    """The first balanced JSON array of a model's answer, code fences and [[links]] passed over."""
    at = 0
    while (at := text.find("[", at)) >= 0:
        if text.startswith("[[", at):
            at += 2
            continue
        try:
            value, _ = json.JSONDecoder().raw_decode(text[at:])
            if isinstance(value, list):
                return json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        at += 1
    return None


def json_arrays(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "items": [json_array_of(t or "") for t in p["text"]]})

    return docs.mapInPandas(run, "doc_id long, items string")
