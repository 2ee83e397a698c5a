"""Structured Streaming operators: stateful filters and limits, task states, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def strip_thinking(held: str, inside: bool, chunk: str, final: bool = False) -> tuple[str, str, bool]:
    """(text out, text held back, whether inside a tag) after a chunk; a tag may be split over chunks."""
    text, out = held + chunk, []
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at >= 0:
            if not inside:
                out.append(text[:at])
            text = text[at + len(tag) :]
            if inside:
                text = text.lstrip()
            inside = not inside
            continue
        keep = 0 if final else max((n for n in range(1, len(tag)) if text.endswith(tag[:n])), default=0)
        if not inside:
            out.append(text[: len(text) - keep])
        return "".join(out), text[len(text) - keep :] if keep else "", inside


#: How long a key may be silent in event time, in milliseconds, before its state goes.
IDLE_MS = 600_000


def _until(state: GroupState, times: pd.Series, idle_ms: int) -> None:
    """Keeps a key's state for idle_ms after its latest event."""
    state.setTimeoutTimestamp(max(int(times.max().timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))


def think_filter(chunks: DataFrame, idle_ms: int = IDLE_MS, late: str = "1 minute") -> DataFrame:
    """chunks (stream_id, seq, ts, chunk, last) -> stream_id, text: what is outside of think tags, stateful by stream.

    The chunks of one trigger are taken in order of seq, over all of its Arrow batches. The last chunk, or
    the watermark idle_ms after the latest one, sends what was held back and ends the stream's state.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"stream_id": [key[0]], "text": ["" if inside else held]})
            return
        out, ended = [], False
        rows = pd.concat(list(parts)).sort_values("seq")
        for chunk, last in rows[["chunk", "last"]].itertuples(index=False):
            text, held, inside = strip_thinking(held, bool(inside), chunk or "", bool(last))
            out.append(text)
            ended = bool(last)
        if ended:
            state.remove()
        else:
            state.update((held, inside))
            _until(state, rows["ts"], idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]], "text": ["".join(out)]})

    return chunks.withWatermark("ts", late).groupBy("stream_id").applyInPandasWithState(run, "stream_id long, text string", "held string, inside boolean", "append", GroupStateTimeout.EventTimeTimeout)


def bucket_decisions(times: list[float], per_minute: float, burst: float, tokens: float | None = None, at: float | None = None) -> tuple[list[bool], float, float]:
    """A token bucket's decisions for ascending times in seconds, and its state after them."""
    tokens = burst if tokens is None else tokens
    out = []
    for t in times:
        tokens = min(burst, tokens + (t - at) * per_minute / 60) if at is not None else tokens
        at = t
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, at if at is not None else 0.0


def rate_limited(events: DataFrame, per_minute: float = 60, burst: float = 10, idle_ms: int = IDLE_MS, late: str = "1 minute") -> DataFrame:
    """events (client, event_id, ts) -> client, event_id, allowed: one bucket a client, kept in state until idle_ms without events, by when it is full again at the usual rates."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        tokens, at = state.get if state.exists else (None, None)
        allowed, tokens, at = bucket_decisions([t.timestamp() for t in rows["ts"]], per_minute, burst, tokens, at)
        state.update((float(tokens), float(at)))
        _until(state, rows["ts"], idle_ms)
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.withWatermark("ts", late).groupBy("client").applyInPandasWithState(run, "client long, event_id long, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(tasks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tasks delivered again within the watermark are dropped."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id"])


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Processes what is there and stops; results and progress go below path."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def ingest(stream: DataFrame, path: str, valid) -> None:
    """A durable import: each batch's valid rows to one table, the rest to quarantine; a batch that is repeated writes the same files anew."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        rows.where(valid).write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        rows.where(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
        rows.unpersist()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
