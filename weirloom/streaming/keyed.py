"""Keyed state with expiry: task states, session windows, approvals.

Each processor keeps typed state for its key in RocksDB, so state is bounded by live keys and
not by memory, and ends by itself: values and lists by a time to live, approvals by a time-out in
event time. Streams run in update mode: a batch writes what has changed to a log, a folder a
batch, so a batch that is repeated after a failure writes the same folder again and nothing is
ever rewritten. `latest` reads a log as a table.

Rows of one key and batch are taken in order of time; results do not depend on how rows are cut
into batches, as long as a key's rows come in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Stages of an import task; the last two end it.
STAGES = ["queued", "parsing", "vectorizing", "completed", "failed"]
DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def _rows(parts: Iterator[pd.DataFrame], *order: str) -> Iterator[tuple]:
    """The rows of a key's batch, in order, over all of its Arrow batches."""
    return pd.concat(list(parts)).sort_values(list(order), kind="stable").itertuples(index=False)


class TaskStates(StatefulProcessor):
    """The latest stage of a task by (ts, stage), and how many updates it had; forgotten ttl_ms after the last one."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "stage string, at timestamp, n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, at, n = self.state.get() if self.state.exists() else ("", None, 0)
        for row in _rows(rows, "ts"):
            n += 1
            if at is None or (row.ts, row.stage) >= (pd.Timestamp(at), stage):
                stage, at = row.stage, row.ts
        self.state.update((stage, at, n))
        yield pd.DataFrame({"task_id": [key[0]], "stage": [stage], "n": [n]})

    def close(self) -> None:
        pass


def task_states(updates: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """updates (task_id, stage, ts) -> task_id, stage, n, whenever a task changes."""
    return updates.groupBy("task_id").transformWithStateInPandas(TaskStates(ttl_ms), "task_id long, stage string, n long", "update", "ProcessingTime")


class SessionWindow(StatefulProcessor):
    """The last `keep` messages of a session as a list; forgotten ttl_ms after the last one."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "turn long, role string, text string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.messages.get()) if self.messages.exists() else []
        held = (held + [(int(r.turn), r.role, r.text) for r in _rows(rows, "turn")])[-self.keep :]
        self.messages.put(held)
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(held)], "first": [held[0][0]], "last": [held[-1][0]], "roles": [",".join(r or "" for _, r, _ in held)]})

    def close(self) -> None:
        pass


def session_windows(messages: DataFrame, window: int, ttl_ms: int = HOUR_MS) -> DataFrame:
    """messages (conv_id, turn, role, text) -> conv_id, n, first, last, roles of the last 2 * window messages, whenever a session gets some."""
    out = "conv_id long, n long, first long, last long, roles string"
    return messages.groupBy("conv_id").transformWithStateInPandas(SessionWindow(2 * window, ttl_ms), out, "update", "ProcessingTime")


def action_hash(action: str, user: int) -> str:
    return hashlib.sha256(f"{action}:{user}".encode()).hexdigest()


class Approvals:
    """A user's open requests; a decision settles those of its action that have not expired, the watermark expires the rest.

    A key's batch is one call: its open requests come with its rows and go back as one value, with a time-out at the
    earliest expiry. A state variable and a timer for each request would cost a call to the engine for each of them.
    """

    STATE = "ids array<long>, actions array<string>, expires array<long>"
    OUT = "id long, user_id long, action_hash string, status string, at_ms long"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentWatermarkMs(), []
        held: dict[str, dict[int, int]] = {}  # by action: request and expiry
        for one, action, expires in zip(*state.get, strict=True) if state.exists else ():
            held.setdefault(action, {})[one] = expires
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["us", "id"], kind="stable")
            for one, ms, action, decision in zip(rows["id"].tolist(), (rows["us"] // 1000).tolist(), rows["action"].tolist(), rows["decision"].tolist(), strict=True):
                if decision == "request":
                    held.setdefault(action, {})[one] = ms + self.ttl_ms
                    out.append((one, action, "pending", ms))
                    continue
                status = "approved" if decision == "approve" else "rejected"
                out += [(open_, action, status, ms) if ms <= expires else (open_, action, "expired", expires) for open_, expires in held.pop(action, {}).items()]
        out += [(one, action, "expired", expires) for action, own in held.items() for one, expires in own.items() if expires <= now]
        left = [(one, action, expires) for action, own in held.items() for one, expires in own.items() if expires > now]
        if left:
            state.update(tuple(list(c) for c in zip(*left, strict=True)))
            state.setTimeoutTimestamp(max(min(expires for _, _, expires in left) - 1, now, 1))  # it fires when the watermark is above
        elif state.exists:
            state.remove()
        if out:
            ids, actions, status, at = zip(*out, strict=True)
            hashes = {a: action_hash(a, key[0]) for a in set(actions)}
            yield pd.DataFrame({"id": ids, "user_id": key[0], "action_hash": [hashes[a] for a in actions], "status": status, "at_ms": at})


def approvals(events: DataFrame, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """events (user_id, id, ts, action, decision: request, approve or reject) -> id, user_id, action_hash, status, at_ms, whenever a request is made or settled."""
    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(Approvals(ttl_ms), Approvals.OUT, Approvals.STATE, "update", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def _settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Settings for a while; the session's own come back afterwards."""
    names = {"provider": "spark.sql.streaming.stateStore.providerClass", "idle": "spark.sql.streaming.noDataMicroBatches.enabled"}
    before = {names[k]: spark.conf.get(names[k], None) for k in wanted}
    for k, value in wanted.items():
        spark.conf.set(names[k], value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def log_changes(changes: DataFrame, path: str, timers: bool = False) -> None:
    """Runs the stream until it has caught up; each batch's changes become a folder of path/log. Run again, it goes on where it stopped.

    timers: batches without rows run too, as long as the watermark moves. State by processing time would ask for them for ever.
    """
    with _settings(changes.sparkSession, provider="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", idle=str(timers).lower()):

        def batch(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/log/batch={number}")

        query = changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def latest(spark: SparkSession, path: str, key: str, *order: str) -> DataFrame:
    """The last change of each key in a log: by batch, then by the columns of order."""
    place = Window.partitionBy(key).orderBy(F.desc("batch"), *(F.desc(c) for c in order))
    return spark.read.parquet(f"{path}/log").withColumn("place", F.row_number().over(place)).where("place = 1").drop("place", "batch")
