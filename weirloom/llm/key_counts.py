"""In how many documents each fingerprint of a corpus occurs, brought back to where the documents are.

Counting fingerprints by a plain shuffle moves a row for each of them, and joining the
counts back moves it again. Here documents are dealt into batches; a batch sends its
sorted, delta-coded keys to key ranges as a blob for each range; a range adds up the
counts and answers with a blob of levels, in the order the batch sent its keys. Some two
to three bytes move for each fingerprint, and the answers are mostly zeros.

A key is a fingerprint's leading bits: the range, then 32 more. Two fingerprints that
share a key are counted together, so a level may be too high, never too low: level 0
proves that a fingerprint is alone in the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirloom.llm.common import input_parts

#: Bytes of text in a batch: a 2000th of the corpus within these bounds, so that blobs stay large as it grows.
BATCH_BYTES = (4 << 20, 256 << 20)
#: At least so many batches, so that small inputs use all cores.
LEAST_BATCHES = 24

Extract = Callable[[pa.Table], np.ndarray]


def batches(docs: DataFrame, text: str = "text") -> int:
    smallest = input_parts(docs, text, BATCH_BYTES[0])
    size = min(BATCH_BYTES[1], max(BATCH_BYTES[0], smallest * BATCH_BYTES[0] // 2000))
    return max(LEAST_BATCHES, -(-smallest * BATCH_BYTES[0] // size))


def range_bits(n_batches: int) -> int:
    return max(1, (n_batches - 1).bit_length())


def _pack(values: np.ndarray) -> bytes:
    """zstd over the byte planes of an array of unsigned integers."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).reshape(-1)


def _keys(prints: np.ndarray, bits: int) -> np.ndarray:
    return prints >> np.uint64(32 - bits)  # range in the bits above 32


def levels_of(prints: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """The level of each fingerprint of a batch: 0 if no other document has it, else the binary logarithm of the count, rounded up."""
    keys = _keys(prints, bits)
    known, where = np.unique(keys, return_inverse=True)
    return in_ranges(known, answers)[where]


def in_ranges(known: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answers to a batch's distinct keys, in order, from the blobs of all ranges."""
    level = np.zeros(len(known), np.uint8)
    for r, n, blob in zip(answers.column("range").to_pylist(), answers.column("n").to_pylist(), answers.column("levels").to_pylist(), strict=True):
        at = int(np.searchsorted(known, np.uint64(r) << np.uint64(32)))
        level[at : at + n] = _unpack(blob, n, np.uint8)
    return level


def answers(dealt: DataFrame, extract: Extract, n_batches: int) -> DataFrame:
    """Rows (batch, range, n, levels) for `dealt`, which has a column batch; extract gives a batch's fingerprints, once for each document that has it."""
    bits = range_bits(n_batches)

    def send(own: pa.Table) -> pa.Table:
        keys, counts = np.unique(_keys(extract(own), bits), return_counts=True)
        batch = own.column("batch")[0].as_py()
        ranges = (keys >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(keys)) if len(keys) else heads
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        rows = [(int(ranges[a]), int(b - a), _pack(np.diff(low[a:b], prepend=np.uint32(0))), _pack(counts[a:b])) for a, b in zip(heads, ends, strict=True)]
        return pa.table({"batch": pa.array([batch] * len(rows), pa.int64()), "range": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})

    def add(sent: pa.Table) -> pa.Table:
        n = sent.column("n").to_pylist()
        keys = [np.cumsum(_unpack(b, k, np.uint32), dtype=np.uint32) for b, k in zip(sent.column("keys").to_pylist(), n, strict=True)]
        counts = np.concatenate([_unpack(b, k, np.uint16) for b, k in zip(sent.column("counts").to_pylist(), n, strict=True)]).astype(np.float64)
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(every))
        level = np.ceil(np.log2(total)).astype(np.uint8)[where]
        at = np.cumsum([0, *n])
        blobs = [pa.compress(level[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"batch": sent.column("batch"), "range": sent.column("range"), "n": sent.column("n"), "levels": pa.array(blobs, pa.binary())})

    sent = dealt.groupBy("batch").applyInArrow(send, "batch long, range long, n long, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "batch long, range long, n long, levels binary")


def deal(docs: DataFrame, key: str, n_batches: int) -> DataFrame:
    """docs with the column batch, dealt by it: one exchange that all uses within a plan share."""
    return docs.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n_batches)).cast("long")).repartition(n_batches, "batch")
