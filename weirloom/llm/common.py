"""What the training-data operators share: reading, durable intermediates, vectorised text.

Texts reach numpy as one buffer of UTF-8 bytes with offsets, so that words, shingles
and rolling fingerprints of a slice of documents cost a few array passes, not a Python
loop over words.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of array operations takes at most, but for a longer single text.
SLICE_BYTES = 2 << 20
#: Separators of words: space and the controls 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Rows that reach a Python worker at once: with texts of some kilobytes, a few megabytes.
BATCH_ROWS = 1500


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, so that a worker's memory does not depend on the default of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made where spark.checkpoint.dir is unset, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; where it is unset, a temporary one of a local session, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="weirloom-")
        named = _LOCAL[context.applicationId]
    return named.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def input_parts(df: DataFrame, column: str = "text", part_bytes: int = 16 << 20) -> int:
    """How many parts of part_bytes the texts make."""
    total = df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(1, -(-total // part_bytes))


# --- vectorised text ---------------------------------------------------------------------------


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose texts take up to `most` bytes, each with its (bytes, offsets)."""
    index = batch.schema.get_field_index(column)
    _, offsets = buffer(batch.column(index))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        part = batch.slice(at, to - at)
        yield part, *buffer(part.column(index))
        at = to


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kept(name: str) -> dict:
    """A dictionary that lives as long as a Python worker: functions are sent by value, so their globals do not."""
    return vars(sys).setdefault(f"_weirloom_{name}", {})


def _power(base: int, n: int) -> np.ndarray:
    powers = kept("powers")
    have = powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 1:
            powers[base] = have
    return have[:n]


class Prints:
    """Fingerprints of any byte ranges of one buffer: a polynomial over a random byte table, from prefix sums."""

    def __init__(self, data: np.ndarray, forget: bool = True):
        if forget:  # a worker that goes on to other operators has no more use for word caches
            kept("encoders").clear()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word [^\\x20\\x09-\\x0D]+; words never cross rows."""
    inside = ~_IS_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(values: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, index of the first word) of every run of `size` words within a row."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = values[:n].copy()
    for k in range(1, size):
        mixed = _mix(mixed * np.uint64(0xD1342543DE82EF95) + values[k : k + n])
    keep = np.flatnonzero(row[:n] == row[size - 1 :])
    return mixed[keep], keep


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint), sorted, of each row's distinct word shingles over A-Z lower-cased text.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    values = Prints(data).of(start, end)
    prints, at = windows(values, row, size)
    rows = row[at]
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(row, short)
        own = np.array([np.bitwise_xor.reduce(_mix(values[a : a + c] + np.arange(1, c + 1, dtype=np.uint64))) for a, c in zip(first, count[short])], np.uint64)
        prints, rows = np.concatenate([prints, _mix(own + np.uint64(7))]), np.concatenate([rows, short])
    order = np.lexsort((prints, rows))
    prints, rows = prints[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
    return rows[new], prints[new]


def sorted_copy(column: str) -> F.Column:
    """The text's words, A-Z lower-cased, joined by single spaces: equal exactly if the word sequences are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(F.col(column), F.lit("")), upper, lower)
    return F.regexp_replace(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), "^ | $", "")
