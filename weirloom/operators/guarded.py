"""Calls of the caller's models: bounded batches, retries, a time limit, and a fallback for the rows that fail.

A model is a function from a list of inputs to a list of outputs, called inside tasks. A batch
whose call raises, takes too long or answers with another number of outputs is tried again, then
halved, so that in the end only those rows are without an output for which the model fails
alone. No row is lost: `rerank` gives those a score by position.

Defined results: an output of null or NaN counts as a failure of its row; inputs may be null, the
model sees None; an empty table calls nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weirloom.operators.retrieve import top

BATCH, RETRIES, SECONDS = 64, 1, 30.0
Model = Callable[[list], list]


def outputs(model: Model, inputs: list, retries: int = RETRIES, seconds: float = SECONDS) -> list:
    """An output for each input, None where the model fails."""

    def once(part: list) -> list | None:
        for _ in range(retries + 1):
            pool = ThreadPoolExecutor(1)
            try:
                out = list(pool.submit(model, part).result(seconds))
                if len(out) == len(part):
                    return out
            except (Exception, Late):  # noqa: BLE001, whatever the caller's model raises
                pass
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        return None

    def whole(part: list) -> list:
        out = once(part)
        if out is not None:
            return out
        if len(part) == 1:
            return [None]
        return whole(part[: len(part) // 2]) + whole(part[len(part) // 2 :])

    return whole(inputs) if inputs else []


def called(rows: DataFrame, inputs: list[str], model: Model, name: str, kind: str, batch: int = BATCH, retries: int = RETRIES, seconds: float = SECONDS) -> DataFrame:
    """rows with the model's output for each as a column, null where it fails; inputs are tuples of the columns named."""
    given = rows.select(F.struct("*").alias("row"), F.struct(*inputs).alias("input"))
    out = T.StructType([given.schema["row"], T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(out[name].dataType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                found = outputs(model, [tuple(x.values()) for x in own.column("input").to_pylist()], retries, seconds)
                found = [None if isinstance(v, float) and math.isnan(v) else v for v in found]
                yield pa.RecordBatch.from_arrays([own.column("row"), pa.array(found, arrow)], out.names)

    return given.mapInArrow(run, out).select("row.*", name)


def rerank(hits: DataFrame, model: Model, k: int, **limits) -> DataFrame:
    """hits (query_id, query, doc_id, text, rank) by the model's scores of (query, text); a row it fails for scores 1 less 0.05 a place of its old rank."""
    scored = called(hits, ["query", "text"], model, "own", "double", **limits)
    by_place = F.greatest(F.lit(0.0), 1 - 0.05 * (F.col("rank") - 1))
    rows = scored.select("query_id", "doc_id", F.round(F.coalesce("own", by_place), 9).alias("score"), F.col("own").isNull().alias("fallback"))
    return top(rows, k, ["query_id"], F.desc("score"), F.asc("doc_id"))
