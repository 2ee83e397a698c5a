"""Mixing sources to target weights by soft membership.

1. Domains come from the labelled table: toxic, else good or poor by quality. A softmax
   regression over hashed words and word ends is fitted on up to SAMPLE_ROWS labelled
   documents (those of the smallest key hash, a documented bound): the FEATURES bins of
   the largest likelihood ratio are kept, found by a distributed count, and the driver
   gets the kept bins of the sample's documents.
2. One pass gives every document its tokens (words) and posteriors, none of them cut off.
3. Document rates r >= 0 are fitted so that the expected tokens of each domain,
   sum(r * tokens * posterior), match targets, by projected gradient on the least squares
   error. The gradient is preconditioned by the pseudo-inverse of the Gram matrix M of the
   documents whose rate is above 0, which makes it a projected Newton step. From rates of 1,
   a step takes r <- max(0, r - posterior . s M^-1 (totals - targets)), with s = 1, quartered
   for as long as the error would grow. Totals and M are one small aggregation a step; the
   rates are never stored: a document's rate follows from the few step vectors.
4. A document gets floor(rate + u) copies, u being a uniform hash of its key, so the
   expected copies equal the rate.

Targets are TARGET_WEIGHTS, the shares of the mixed corpus that each domain is to have, times
the tokens that the corpus has now: of a corpus with 0.80 good, 0.10 poor and 0.10 toxic
tokens, toxic documents go, poor ones are halved and good ones come 1.2 times on average. The
toxic share is not 0, since every document has some toxic membership: least squares would
rather drop clean documents than leave it.

Defined results: a null or empty text has no tokens and rate 1; without labelled rows all
documents are good; null labels are ignored; repeated rows get equal rates; an empty table
gives an empty one; other columns are kept, those with the names of the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirloom.llm.common import _LOWER, Prints, durable, slices, words

DOMAINS = ("good", "poor", "toxic")
SAMPLE_ROWS = 20_000
BIN_BITS = 18
FEATURES = 2000
#: Log likelihood ratio below which a bin is taken for noise.
LEAST_GAIN = 8.0
EPOCHS = 120
RIDGE = 1e-5
#: Shares of good, poor and toxic tokens in the mixed corpus.
TARGET_WEIGHTS = (0.948, 0.05, 0.002)
STEPS = 60
TOLERANCE = 1e-5


def bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin) of the distinct bins of each row's words and word ends, and the words of each row."""
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    prints = Prints(data)
    value = np.concatenate([prints.of(start, end), prints.of(np.maximum(start, end - 2), end) ^ np.uint64(0x5555555555555555)])
    key = np.unique((np.concatenate([row, row]) << BIN_BITS) | (value >> np.uint64(64 - BIN_BITS)).astype(np.int64))
    return key >> BIN_BITS, key & ((1 << BIN_BITS) - 1), np.bincount(row, minlength=len(offsets) - 1)


class Classifier:
    """Softmax regression on the presence of kept bins."""

    def __init__(self, prior: np.ndarray, which: np.ndarray):
        self.slot = np.full(1 << BIN_BITS, -1, np.int32)
        self.slot[which] = np.arange(len(which))
        self.gain = np.zeros((len(which), len(prior)))
        self.base = np.log(prior)

    def train(self, row: np.ndarray, slot: np.ndarray, label: np.ndarray) -> None:
        """Full-batch steps with momentum and a step size for each weight; row and slot are the presences."""
        k, m = self.gain.shape[1], len(self.gain)
        truth = np.eye(k)[label]
        first, second = np.zeros((m + 1, k)), np.zeros((m + 1, k))
        for t in range(1, EPOCHS + 1):
            score = np.stack([np.bincount(row, weights=self.gain[slot, i], minlength=len(label)) for i in range(k)], axis=1) + self.base
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - truth) / len(label)
            grad = np.vstack([np.stack([np.bincount(slot, weights=error[row, i], minlength=m) for i in range(k)], axis=1) + RIDGE * self.gain, error.sum(axis=0)])
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            step = 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
            self.gain -= step[:-1]
            self.base = self.base - step[-1]

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each row."""
        row, found, tokens = bins(data, offsets)
        slot = self.slot[found]
        row, slot = row[slot >= 0], slot[slot >= 0]
        score = np.tile(self.base, (len(offsets) - 1, 1))
        for k in range(score.shape[1]):
            score[:, k] += np.bincount(row, weights=self.gain[slot, k], minlength=len(score))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return tokens.astype(np.int64), p / p.sum(axis=1, keepdims=True)


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Classifier:
    own = labels.select(F.col(key).alias("x_key"), domain(F.col("quality"), F.col("toxic")).alias("x_domain")).where("x_key IS NOT NULL AND x_domain IS NOT NULL")
    own = own.groupBy("x_key").agg(F.max("x_domain").alias("x_domain")).orderBy(F.xxhash64("x_key"), "x_key").limit(rows)
    # one row a key, of those that share it the one of the smallest text: the driver gets `rows` rows at most
    sample = docs.select(F.col(key).alias("x_key"), F.col(text).alias("x_text")).join(F.broadcast(own), "x_key").groupBy("x_key").agg(F.first("x_domain").alias("x_domain"), F.min("x_text").alias("x_text"))
    sample = durable(sample, "sample")
    k = len(DOMAINS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of this part by bin: a row for each bin seen; bin -1 counts documents."""
        total = np.zeros(((1 << BIN_BITS) + 1, k), np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch, "x_text"):
                label = part.column("x_domain").to_numpy(zero_copy_only=False)
                row, found, _ = bins(data, offsets)
                np.add.at(total, (found, label[row]), 1)
                total[-1] += np.bincount(label, minlength=k)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(seen == 1 << BIN_BITS, -1, seen)), *(pa.array(total[seen, i]) for i in range(k))], ["bin", *(f"c{i}" for i in range(k))])

    names = [f"c{i}" for i in range(k)]
    counts = durable(sample.mapInArrow(count, "bin long, " + ", ".join(f"{n} long" for n in names)).groupBy("bin").agg(*(F.sum(n).alias(n) for n in names)), "bins")
    whole = counts.where("bin = -1").first()
    if whole is None:
        return Classifier(np.array([1 - 1e-6] + [5e-7] * (k - 1)), np.zeros(0, np.int64))
    n = np.array([float(whole[c]) for c in names])
    # likelihood ratio of a bin's presence by domain against one rate for all
    rate = lambda c, m: (F.col(c) + 0.5) / F.lit(m + 1.0) if isinstance(c, str) else (c + 0.5) / F.lit(m + 1.0)
    together = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    gain = sum((F.col(c) * F.log(rate(c, m) / rate(together, float(n.sum()))) + (F.lit(m) - F.col(c)) * F.log((1 - rate(c, m)) / (1 - rate(together, float(n.sum())))) for c, m in zip(names, n.tolist(), strict=True)), F.lit(0.0))
    top = counts.where("bin >= 0").withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "bin").limit(FEATURES).collect()  # bounded: FEATURES rows
    out = Classifier((n + 1) / (n.sum() + k), np.array([r["bin"] for r in top], np.int64))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "x_text"):
                row, found, _ = bins(data, offsets)
                slot = out.slot[found]
                row, slot = row[slot >= 0], slot[slot >= 0].astype(np.int16)
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("x_key"), part.column("x_domain"), pa.ListArray.from_arrays(pa.array(at), pa.array(slot))], ["x_key", "x_domain", "slots"])

    rows_ = sample.select(F.col("x_key").cast("string").alias("x_key"), "x_domain", "x_text").mapInArrow(present, "x_key string, x_domain int, slots array<smallint>").orderBy("x_key").toArrow().combine_chunks()  # bounded: SAMPLE_ROWS rows
    slots = rows_.column("slots").combine_chunks()
    sizes = np.diff(slots.offsets.to_numpy())
    out.train(np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy().astype(np.int64), rows_.column("x_domain").to_numpy().astype(np.int64))
    return out


def posteriors(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """Rows (x_row: all columns of docs, n_tokens, p: posteriors by domain)."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("x_row"), docs[text].alias("x_text"))
    out = T.StructType([rows.schema["x_row"], T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "x_text"):
                tokens, p = classifier.posteriors(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("x_row"), pa.array(tokens), lists], out.names)

    return rows.mapInArrow(run, out)


def _dot(weights: Sequence[float]) -> Column:
    return sum((F.get("p", F.lit(i)) * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after the steps taken: from 1, each takes its vector's product with the posteriors away, down to 0."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps)) if steps else None
    if table is None:
        return F.lit(1.0)
    taken = F.aggregate(table, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((F.get(s, i) * F.get("p", F.lit(i)) for i in range(len(steps[0]))), F.lit(0.0))))
    return F.when(F.col("n_tokens") > 0, taken).otherwise(F.lit(1.0))


def weighted_targets(members: DataFrame, weights: Sequence[float] = TARGET_WEIGHTS) -> np.ndarray:
    """Tokens by domain of a corpus as large as this one with the stated shares."""
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    return np.asarray(weights, float) / sum(weights) * total


def solve(members: DataFrame, targets: Sequence[float] | None = None, weights: Sequence[float] = TARGET_WEIGHTS) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(step vectors, targets, totals reached) for members (n_tokens, p), which should be a written table."""
    k = len(DOMAINS)
    part = lambda i: F.get("p", F.lit(i))

    def measured(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """(totals, Gram matrix of documents with a rate above 0)."""
        rows = members.select("n_tokens", "p", rate(steps).alias("r"))
        active = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        row = rows.agg(*(F.sum(F.col("r") * F.col("n_tokens") * part(i)).alias(f"t{i}") for i in range(k)), *(F.sum(active * part(i) * part(j)).alias(f"m{i}{j}") for i in range(k) for j in range(i, k))).first()
        value = lambda name: float(row[name] or 0)
        return np.array([value(f"t{i}") for i in range(k)]), np.array([[value(f"m{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)])

    totals, gram = measured([])
    goal = np.asarray(targets, float) if targets is not None else weighted_targets(members, weights)
    error = lambda t: float(np.linalg.norm(t - goal) / max(1.0, goal.sum()))
    steps: list[list[float]] = []
    size = 1.0
    for _ in range(STEPS):
        if error(totals) < TOLERANCE or size < 1e-4:
            break
        step = np.linalg.pinv(gram + 1e-9 * max(1.0, np.trace(gram)) * np.eye(k)) @ (totals - goal)
        tried, shape = measured([*steps, (size * step).tolist()])
        if error(tried) < error(totals) * (1 - 1e-4):
            steps.append((size * step).tolist())
            totals, gram, size = tried, shape, min(1.0, 2 * size)
        else:
            size /= 4
    return steps, goal, totals


OWN = ("n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, train: DataFrame | None = None, weights: Sequence[float] = TARGET_WEIGHTS) -> DataFrame:
    """The columns `keep` of docs (all unless given) with n_tokens, p_good, p_poor, p_toxic, rate and copies put in.

    The classifier learns from the labelled documents of `train`, by default of docs. targets are tokens by domain; by default they follow from weights.
    """
    classifier = fit(docs if train is None else train, labels, key, text)
    found = posteriors(docs, classifier, text)
    names = [c for c in keep or docs.columns if c.lower() not in OWN]
    found = durable(found.select(F.struct(*(F.col("x_row")[c].alias(c) for c in names)).alias("x_row"), F.col("x_row")[key].alias("x_key"), "n_tokens", "p"), "members")
    steps, _, _ = solve(found.select("n_tokens", "p"), targets, weights)
    uniform = F.pmod(F.xxhash64(F.coalesce(F.col("x_key").cast("string"), F.lit("")), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    out = found.withColumn("rate", F.round(rate(steps), 9))
    return out.select("x_row.*", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", F.floor(F.col("rate") + uniform).cast("bigint").alias("copies"))
