"""Suffix-array dedup with a run-length index.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a document
that sorts before, or earlier in the same one) is removed. Exact over the corpus:

1. Anchors. The anchor of a string of LENGTH bytes is its K-byte piece of least
   fingerprint (the leftmost such), so equal strings have equal anchors. The strings of one
   anchor are neighbours; they and the bytes they span are its context. Every string
   belongs to one context, and about one position in 39 is an anchor.
2. key_counts tells in how many places each anchor occurs in the corpus. Strings of an
   anchor with one place occur once. Of the others, a batch of documents asks by two
   fingerprints (anchor and whole context): a context that an earlier document has whole is
   removed at once, and one whose anchor has no other context is new. What is left
   ambiguous, the ends of copied passages, is sent with its bytes.
3. Ambiguous contexts meet by anchor and go through run-length compressed Burrows-Wheeler
   indexes with sampled run ends. The first context of each anchor makes the first index;
   the next GROWTH - 1 stream their matching statistics against it and make the second; of
   those after them, GROWTH times as many stream against both, and so on: a string is a
   repeat if its statistic against an earlier index reaches LENGTH, or if the index of its
   own round has it earlier.
4. The removed ranges go back to the documents, which are cut and digested.

Batches and tasks have a fixed size in bytes, so memory does not grow with the input; a
text is held whole in one task.

Defined results: null text is empty; documents sort by key, then by the text's digest, a
null key before all others; repeated rows (equal key and text) get the result of the first
of them; an empty table gives an empty one. Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirloom.llm import key_counts
from weirloom.llm.common import Prints, buffer, durable, slices
from weirloom.llm.run_index import RunIndex

LENGTH = 100
K = 24
#: Bytes of contexts for an index of step 3, for a task, and that a task holds before it starts to index.
BLOCK_BYTES = 2 << 20
TASK_BYTES = 8 << 20
HOLD_BYTES = 24 << 20
#: How much longer than all before it a round is.
GROWTH = 8


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by prefix and suffix minima of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor fingerprint, that of the whole, start, end, row) of each context; end is that of the last byte its strings span."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    every = Prints(data)
    prints = every.rolling(k)
    place = np.arange(len(prints), dtype=np.uint64)
    least = _window_least((prints & np.uint64(0xFFFFFFFF00000000)) | place, length - k + 1)
    start = np.arange(len(least))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    fits = start + length <= offsets[row + 1]
    start, row, anchor = start[fits], row[fits], (least[fits] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(start)) - 1
    begin, end = start[heads], start[last] + length
    return prints[anchor[heads]], every.of(begin, end), begin, end, row[heads]


class _Batch:
    """The texts of a batch in order, without those equal to an earlier one."""

    def __init__(self, own: pa.Table):
        own = own.combine_chunks()
        self.keys = np.array([-(1 << 63) if k is None else k for k in own.column("doc_id").to_pylist()], np.int64)
        self.data, self.offsets = buffer(own.column("text"))
        raw = self.data.tobytes()
        self.digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i], self.digests[i]))
        first: dict[bytes, int] = {}
        self.first_of = np.zeros(len(self.keys), np.int64)
        for i in order:
            self.first_of[i] = first.setdefault(self.digests[i], i)
        self.rank = np.zeros(len(self.keys), np.int64)
        self.rank[order] = np.arange(len(order))
        self.kept = np.array(sorted(first.values(), key=lambda i: self.rank[i]), np.int64)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, bytes, offsets) of the texts kept, in order, a slice of bounded size at a time."""
        table = pa.RecordBatch.from_arrays([pa.array(self.kept), pa.array([self.data[self.offsets[i] : self.offsets[i + 1]].tobytes() for i in self.kept], pa.large_binary())], ["row", "text"])
        for part, data, offsets in slices(table):
            yield part.column("row").to_numpy(), data, offsets


def _anchors(own: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(contexts(data, offsets)[0] for _, data, offsets in _Batch(own).pieces())])


def _shared(batch: _Batch, answers: pa.Table, bits: int) -> tuple[np.ndarray, ...]:
    """Contexts of shared anchors in document order: (anchor, fingerprint of the whole, row, begin, end), places in the text."""
    got = []
    for rows, data, offsets in batch.pieces():
        prints, whole, start, end, row = contexts(data, offsets)
        got.append((prints, whole, rows[row], start - offsets[row], end - offsets[row]))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    prints, *more = (np.concatenate(x) for x in zip(*got, strict=True))
    keep = key_counts.levels_of(prints, answers, bits) > 0
    return prints[keep], *(x[keep] for x in more)


def _first_of_each(prints: np.ndarray, whole: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the anchor, fingerprint of the whole, first index), sorted, of a batch's distinct contexts."""
    key, same_as = prints >> np.uint64(32 - bits), whole
    order = np.lexsort((same_as, key))  # stable: the first in document order leads its group
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (same_as[order][1:] != same_as[order][:-1])
    at = order[new]
    return key[at], same_as[at], at


def _ask(own: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    batch = _Batch(own)
    prints, whole, rows, _, _ = _shared(batch, answers, bits)
    key, same_as, at = _first_of_each(prints, whole, bits)
    docs = batch.keys[rows[at]]
    ranges = (key >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(key)).astype(np.int64) if len(key) else heads
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    blob = lambda values: pa.array([key_counts._pack(values[a:b]) for a, b in zip(heads, ends, strict=True)], pa.binary())
    steps = np.diff(low, prepend=np.uint32(0))
    steps[heads] = low[heads]
    number = own.column("batch")[0].as_py()
    return pa.table({"batch": pa.array([number] * len(heads), pa.int64()), "range": pa.array(ranges[heads]), "n": pa.array(ends - heads), "keys": blob(steps), "wholes": blob(same_as), "docs": blob(docs.view(np.uint64))})


KNOWN, AMBIGUOUS = 1, 2


def _tell(asked: pa.Table) -> pa.Table:
    """For each context asked for: KNOWN if an earlier document has it, else AMBIGUOUS if its anchor has another one."""
    n = asked.column("n").to_pylist()
    column = lambda name, kind: [key_counts._unpack(b, k, kind) for b, k in zip(asked.column(name).to_pylist(), n, strict=True)]
    key = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in column("keys", np.uint32)])
    same_as, docs = np.concatenate(column("wholes", np.uint64)), np.concatenate(column("docs", np.uint64)).view(np.int64)
    order = np.lexsort((docs, same_as, key))
    same_key = np.append(False, key[order][1:] == key[order][:-1])
    same = same_key & np.append(False, same_as[order][1:] == same_as[order][:-1])
    group = np.cumsum(~same_key) - 1
    several = np.bincount(group, weights=~same) > 1
    flag = np.empty(len(key), np.uint8)
    flag[order] = np.where(same, KNOWN, np.where(several[group], AMBIGUOUS, 0))
    at = np.cumsum([0, *n])
    blobs = [pa.compress(flag[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"batch": asked.column("batch"), "range": asked.column("range"), "n": asked.column("n"), "levels": pa.array(blobs, pa.binary()), "told": pa.array([True] * len(n))})


FOUND = "anchor long, doc_id long, tie binary, at long, size long, bytes binary"


def _give(own: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Ambiguous contexts with their bytes, and with null bytes the ranges known to be repeats."""
    batch = _Batch(own)
    told = pc.fill_null(answers.column("told"), False)
    prints, whole, rows, begin, end = _shared(batch, answers.filter(pc.invert(told)), bits)
    key, same_as, first = _first_of_each(prints, whole, bits)
    flag = np.full(len(prints), KNOWN, np.uint8)  # equal to an earlier one of this batch
    order = answers.filter(told).sort_by("range")
    flag[first] = np.concatenate([np.zeros(0, np.uint8), *(key_counts._unpack(b, n, np.uint8) for b, n in zip(order.column("levels").to_pylist(), order.column("n").to_pylist(), strict=True))])
    out: list[tuple] = []
    known = np.flatnonzero(flag == KNOWN)
    if len(known):
        r, a, b = rows[known], begin[known], end[known]
        new = np.append(True, (r[1:] != r[:-1]) | (a[1:] > b[:-1]))
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(known)) - 1
        for i, x, y in zip(r[heads].tolist(), a[heads].tolist(), b[tails].tolist(), strict=True):
            out.append((0, int(batch.keys[i]), batch.digests[i], x, y - x, None))
    raw = batch.data
    for c in np.flatnonzero(flag == AMBIGUOUS).tolist():
        i, a, b = int(rows[c]), int(begin[c]), int(end[c])
        base = int(batch.offsets[i])
        out.append((int(prints[c].view(np.int64)), int(batch.keys[i]), batch.digests[i], a, b - a, raw[base + a : base + b].tobytes()))
    size = np.diff(batch.offsets)
    for i in np.flatnonzero(batch.first_of != np.arange(len(batch.keys))).tolist():
        if batch.keys[i] != batch.keys[batch.first_of[i]] and size[i] >= LENGTH:
            out.append((0, int(batch.keys[i]), batch.digests[i], 0, int(size[i]), None))
    names = ["anchor", "doc_id", "tie", "at", "size", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _covered(start: np.ndarray, hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes covered by strings that start at `start[hit]`; starts rise."""
    at = start[hit]
    if not len(at):
        return []
    new = np.append(True, at[1:] > at[:-1] + length)
    heads = np.flatnonzero(new)
    return list(zip(at[heads].tolist(), (at[np.append(heads[1:], len(at)) - 1] + length).tolist(), strict=True))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over one task's contexts, sorted by document and place."""
    indexes: list[RunIndex] = []

    def block(table: pa.Table) -> pa.RecordBatch:
        data, offsets = buffer(table.column("bytes"))
        sizes = np.diff(offsets)
        strings = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(sizes)), strings)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        repeat = np.zeros(len(owner), bool)
        for old in indexes:
            repeat |= old.matching_statistics(data, offsets, LENGTH, LENGTH)[offsets[owner] + inner] >= LENGTH
        index = RunIndex(data, offsets, LENGTH)
        classes = index.window_class[index.starts[owner] + inner]
        _, first = np.unique(classes, return_index=True)  # the first place, and places are in document order
        own = np.ones(len(owner), bool)
        own[first] = False
        repeat |= own
        index.window_class = None
        if not repeat.all():
            indexes.append(index)
        doc, tie, at = table.column("doc_id"), table.column("tie"), table.column("at").to_numpy()
        hits = np.flatnonzero(repeat)
        where, begin, end = [], [], []
        edges = np.searchsorted(owner[hits], np.arange(len(sizes) + 1))
        for o in np.flatnonzero(np.diff(edges)).tolist():
            for a, b in _covered(inner, hits[edges[o] : edges[o + 1]], LENGTH):
                where.append(o)
                begin.append(int(at[o]) + a)
                end.append(int(at[o]) + b)
        taken = pa.array(where, pa.int64())
        return pa.RecordBatch.from_arrays([doc.take(taken).combine_chunks(), tie.take(taken).combine_chunks(), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "tie", "begin", "end"])

    def rounds(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table.column("anchor").to_numpy()
        order = np.argsort(anchors, kind="stable")
        heads = np.flatnonzero(np.append(True, anchors[order][1:] != anchors[order][:-1]))
        place = np.empty(len(anchors), np.int64)
        place[order] = np.arange(len(anchors)) - np.repeat(heads, np.diff(np.append(heads, len(anchors))))
        level = sum((place >= GROWTH**k).astype(np.int64) for k in range(int(np.log2(max(1, place.max()))) // 3 + 1))
        for k in range(int(level.max()) + 1):
            own = table.take(pa.array(np.flatnonzero(level == k)))
            sizes = pc.binary_length(own.column("bytes")).to_numpy()
            part = np.cumsum(sizes) // BLOCK_BYTES
            for p in range(int(part[-1]) + 1):
                a, b = np.searchsorted(part, [p, p + 1])
                if b > a:
                    yield block(own.slice(a, b - a).combine_chunks())

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HOLD_BYTES:
            yield from rounds(held)
            held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield from rounds(held)


def _cut(own: pa.Table, ranges: pa.Table) -> pa.Table:
    """Step 4 for a batch: documents with the ranges to remove."""
    by: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for doc, tie, spans in zip(ranges.column("doc_id").to_pylist(), ranges.column("tie").to_pylist(), ranges.column("spans").to_pylist(), strict=True):
        by[doc, tie] = sorted((s["begin"], s["end"]) for s in spans)
    data, offsets = buffer(own.combine_chunks().column("text"))
    raw, out = data.tobytes(), []
    for doc, a, b in zip(own.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = raw[a:b]
        runs: list[list[int]] = []
        for x, y in by.get((-(1 << 63) if doc is None else doc, hashlib.sha256(text).digest()), ()) if by else ():
            if runs and x <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], y)
            else:
                runs.append([x, y])
        kept, at = [], 0
        for x, y in runs:
            kept.append(text[at:x])
            at = y
        kept.append(text[at:])
        rest = b"".join(kept)
        out.append((doc, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], kinds, strict=True))})


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is the rest as bytes, left out on request."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    n_batches = key_counts.batches(rows)
    bits = key_counts.range_bits(n_batches)
    dealt = key_counts.deal(rows, "doc_id", n_batches)
    answers = key_counts.answers(dealt, _anchors, n_batches)
    asked = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda own, got: _ask(own, got, bits), "batch long, range long, n long, keys binary, wholes binary, docs binary")
    told = asked.groupBy("range").applyInArrow(_tell, "batch long, range long, n long, levels binary, told boolean")
    both = answers.withColumn("told", F.lit(False)).union(told)
    found = dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(lambda own, got: _give(own, got, bits), FOUND)
    found = durable(found, "contexts")
    open_ = found.where("bytes IS NOT NULL").drop("size")
    total = open_.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    streamed = open_.repartition(tasks, "anchor").sortWithinPartitions("doc_id", "tie", "at").mapInArrow(_stream, "doc_id long, tie binary, begin long, end long")
    known = found.where("bytes IS NULL").select("doc_id", "tie", F.col("at").alias("begin"), (F.col("at") + F.col("size")).alias("end"))
    ranges = streamed.union(known).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    whole = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    ranges = ranges.withColumn("batch", F.pmod(F.xxhash64(whole), F.lit(n_batches)).cast("long"))
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    cut = (lambda own, got: _cut(own, got)) if with_bytes else (lambda own, got: _cut(own, got).drop_columns(["kept"]))
    return dealt.groupBy("batch").cogroup(ranges.groupBy("batch")).applyInArrow(cut, names)
