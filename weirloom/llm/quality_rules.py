"""Quality rules: isolation forest on rule statistics.

One pass over the texts gives each document's rule statistics, each taken as a one-sided
rule: how far it exceeds the LIMIT_QUANTILE of the labelled good documents, in spreads of
these. (On raw statistics the tails of good documents are as easy to isolate as junk.) An
isolation forest is grown over labelled documents: each tree takes SUBSAMPLE and splits on random features at random values down to depth log2(SUBSAMPLE); the mean path
length over the trees, normalised by that of a random search tree, gives the anomaly
score. The threshold is the one which rejects the most rows of label quality = 0 among
those that reject at most MAX_GOOD_REJECTED of the rows of quality = 1.

The forest and the threshold are fitted on up to SAMPLE_ROWS labelled documents, those
of the smallest key hash (a documented bound; the rest of the work covers all rows).
Trees reach the executors inside the function that scores: some 0.3 MB whatever the input.

Defined results: a null or empty text has zero statistics and fails the base rule; with
no labelled rows the verdict is the base rule alone; null labels and labels without a
document are ignored; repeated keys are judged row by row; an empty table gives an empty
one; other columns are kept, those with the names of the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirloom.llm.common import _IS_SPACE, Prints, slices, windows, words

SAMPLE_ROWS = 20_000
TREES = 100
SUBSAMPLE = 256
MAX_GOOD_REJECTED = 0.001
LIMIT_QUANTILE = 0.999
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"'()*+,-./:;<=>?@[]^_`{|}~")] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, is the first of its (row, value), size of its group), in sorted order; the sort is stable."""
    order = np.lexsort((value, row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1])
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(order)))
    return order, first, np.repeat(size, size)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS for each row, and the forest's features (rows x features)."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    prints = Prints(data)
    values = prints.of(start, end)
    n_words = np.bincount(row, minlength=n)
    lead = (data & 0xC0) != 0x80
    inside = ~_IS_SPACE[data]
    word_chars = _per_row(lead & inside, offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)
    # lines: a new one begins at each row's start and after each \n within it
    breaks = np.flatnonzero(data == 10) + 1
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = line_end - (data[line_end - 1] == 10)
    word_at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=word_at[1:])
    full = word_at[line_end] > word_at[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    order, first, _ = _again(line_row, prints.of(line_start, line_end))
    n_dup_lines = np.bincount(line_row[order][~first], minlength=n)
    n_lines = np.bincount(line_row, minlength=n)
    # words in windows found twice or more
    seen, at = windows(values, row, WINDOW)
    order, _, size = _again(row[at], seen)
    cover = np.zeros(len(values) + 1, np.int64)
    hit = at[order][size > 1]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)
    order, first, _ = _again(row, values)
    distinct = np.bincount(row[order][first], minlength=n)
    chars, w, lines = np.maximum(word_chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    features = np.stack(
        [
            word_chars / w, n_symbols / w, n_dup_lines / lines, n_repeat / w, distinct / np.sqrt(w), _per_row(_UPPER[data], offsets) / chars,
            _per_row(_DIGIT[data], offsets) / chars, _per_row(_MARK[data], offsets) / w, np.log1p(w / lines),
        ],
        axis=1,
    ).astype(np.float64)
    counts = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
    return dict(zip(COUNTS, (c.astype(np.int64) for c in counts), strict=True)), features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _usual(n: int | np.ndarray) -> np.ndarray:
    """The mean path of an unsuccessful search in a binary search tree over n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    split: np.ndarray
    path: np.ndarray  # a leaf's depth with the usual path of the rows left in it
    usual: float
    limit: np.ndarray  # of each statistic, from good rows
    spread: np.ndarray
    threshold: float = np.inf

    @classmethod
    def fit(cls, rows: np.ndarray, good: np.ndarray, most: float = MAX_GOOD_REJECTED) -> Forest:
        """Limits from the good rows, trees over all rows, threshold above all but a share `most` of the good rows."""
        base = rows[good] if good.any() else rows
        limit = np.quantile(base, LIMIT_QUANTILE, axis=0, method="higher")
        spread = np.maximum(limit - np.median(base, axis=0), 1e-3)
        out = cls.grow(np.maximum(0, (rows - limit) / spread))
        out.limit, out.spread = limit, spread
        scores = np.sort(out.score(rows[good]))[::-1]
        out.threshold = float(scores[int(most * len(scores))]) + 1e-9 if len(scores) else np.inf
        return out

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
        rng, m = np.random.default_rng(seed), min(subsample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(m, 2)))))
        nodes = 2 ** (depth + 1) - 1
        out = cls(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), float(max(_usual(m), 1e-9)), np.zeros(rows.shape[1]), np.ones(rows.shape[1]))
        for t in range(trees):
            todo = [(0, rows[rng.choice(len(rows), m, replace=False)], 0)]
            while todo:
                node, own, at = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                free = np.flatnonzero(high > low)
                if at == depth or not len(free):
                    out.path[t, node] = at + _usual(len(own))
                    continue
                f = rng.choice(free)
                out.feature[t, node], out.split[t, node] = f, rng.uniform(low[f], high[f])
                left = own[:, f] < out.split[t, node]
                todo += [(2 * node + 1, own[left], at + 1), (2 * node + 2, own[~left], at + 1)] if left.any() and not left.all() else []
                if not left.any() or left.all():
                    out.feature[t, node], out.path[t, node] = -1, at + _usual(len(own))
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        rows = np.maximum(0, (rows - self.limit) / self.spread)
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(inner := np.flatnonzero(feature[node] >= 0)):
                at = node[inner]
                node[inner] = 2 * at + 2 - (rows[each[inner], feature[at]] < split[at])
            total += path[node]
        return np.exp2(-total / len(self.path) / self.usual)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Forest | None:
    """The forest over up to `rows` labelled documents, or None without any."""
    ids = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(F.col(key).alias("q_key"), F.col("quality").alias("q_label"))
    ids = ids.groupBy("q_key").agg(F.max("q_label").alias("q_label")).orderBy(F.xxhash64("q_key"), "q_key").limit(rows)  # bounded: broadcast below
    sample = docs.select(F.col(key).alias("q_key"), F.col(text).alias("q_text")).join(F.broadcast(ids), "q_key")
    names = [f"f{i}" for i in range(9)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "q_text"):
                counts, features = statistics(data, offsets)
                fine = ~base_failed(counts)
                columns = [pa.array(features[fine, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column("q_key").filter(pa.array(fine)), part.column("q_label").cast(pa.int32()).filter(pa.array(fine)), *columns], ["q_key", "q_label", *names])

    schema = T.StructType([sample.schema["q_key"], T.StructField("q_label", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    found = sample.select("q_key", F.col("q_label").cast("int").alias("q_label"), "q_text").mapInArrow(run, schema).groupBy("q_key").agg(F.first("q_label").alias("q_label"), *(F.min(n).alias(n) for n in names)).orderBy("q_key").toPandas()
    if not len(found):
        return None
    matrix = found[names].to_numpy()
    return Forest.fit(matrix, found["q_label"].to_numpy() == 1)


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, anomaly (0 without a forest) and kept put in."""
    own = (*COUNTS, "base_failed", "anomaly", "kept")
    keep = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("q_row"), docs[text].alias("q_text"))
    out = T.StructType([rows.schema["q_row"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "q_text"):
                counts, features = statistics(data, offsets)
                failed = base_failed(counts)
                score = forest.score(features) if forest else np.zeros(len(features))
                kept = ~failed & (score < forest.threshold if forest else True)
                yield pa.RecordBatch.from_arrays([part.column("q_row"), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)], out.names)

    return rows.mapInArrow(run, out).select("q_row.*", *own)
