"""Keyed state: runs that stop and go on equal one run and the batch form; expiry by time to live and by timers."""

import datetime
import random
import time

import pandas as pd
import pytest

from weirloom.streaming import keyed

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def in_runs(spark, tmp_path, schema, runs, stream, **more):
    """Writes each run's rows as a file and lets the stream catch up, from the same checkpoint each time."""
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keyed.log_changes(stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), str(tmp_path), **more)


def test_task_states_over_a_restart(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(8), r.choice(keyed.STAGES), at(i)) for i in range(60)]
    in_runs(spark, tmp_path, "task_id long, stage string, ts timestamp", [rows[:25], rows[25:]], keyed.task_states)
    got = {x["task_id"]: (x["stage"], x["n"]) for x in keyed.latest(spark, str(tmp_path), "task_id", "n").collect()}
    assert got == {t: ([x[1] for x in rows if x[0] == t][-1], sum(x[0] == t for x in rows)) for t, _, _ in rows}
    # the second run wrote the tasks that it changed and nothing else
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.where("batch = 1").count() == len({t for t, _, _ in rows[25:]})


def test_session_windows_over_a_restart_and_time_to_live(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(5) for t in range(c + 2)]
    schema = "conv_id long, turn long, role string, text string"
    in_runs(spark, tmp_path, schema, [[x for x in rows if x[1] < 3], [x for x in rows if x[1] >= 3]], lambda s: keyed.session_windows(s, 2))
    got = {x["conv_id"]: (x["n"], x["first"], x["roles"].count("user")) for x in keyed.latest(spark, str(tmp_path), "conv_id", "last").collect()}
    assert got == {c: (len(w := [x for x in rows if x[0] == c][-4:]), w[0][1], sum(x[2] == "user" for x in w)) for c in range(5)}
    # with a short time to live the second run begins anew
    short = tmp_path / "short"
    for part in ([(1, 0, "user", "a"), (1, 1, "user", "b")], [(1, 2, "user", "c")]):
        in_runs(spark, short, schema, [part], lambda s: keyed.session_windows(s, 2, ttl_ms=500))
        time.sleep(1)
    assert keyed.latest(spark, str(short), "conv_id", "last").first()["n"] == 1


@pytest.mark.parametrize("cut", [3, 8])
def test_approvals_expire_by_timer(spark, tmp_path, cut):
    hour = keyed.HOUR_MS
    rows = [
        (1, 1, at(0), "write", "request"),
        (1, 2, at(10), "delete", "request"),
        (1, 3, at(20), "write", "approve"),  # settles 1 only: 2 is another action
        (2, 4, at(30), "write", "request"),
        (2, 5, at(95), "write", "reject"),  # too late for 4
        (2, 6, at(96), "write", "request"),
        (2, 7, at(97), "write", "reject"),
        (3, 8, at(100), "write", "request"),
        (3, 9, at(190), "write", "request"),
        (4, 10, at(200), "write", "request"),
    ]
    in_runs(spark, tmp_path, "user_id long, id long, ts timestamp, action string, decision string", [rows[:cut], rows[cut:]], lambda s: keyed.approvals(s, hour), timers=True)
    found = {}
    for x in spark.read.parquet(f"{tmp_path}/log").orderBy("batch").collect():
        if found.get(x["id"]) in (None, "pending"):
            found[x["id"]] = x["status"]
        if x["id"] in (2, 4, 8) and x["status"] == "expired":
            assert x["at_ms"] == {2: 70, 4: 90, 8: 160}[x["id"]] * 60_000 + int(T0.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert found == {1: "approved", 2: "expired", 4: "expired", 6: "rejected", 8: "expired", 9: "pending", 10: "pending"}


def test_approvals_touch_their_state_once_a_batch():
    class State:
        """What the engine hands over for a key, with a count of writes."""

        value, hasTimedOut, now, writes, timeout = None, False, 0, 0, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):
            return self.now

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        def remove(self):
            self.value, self.writes = None, self.writes + 1

    state, run = State(), keyed.Approvals(10)
    rows = pd.DataFrame({"id": range(5000), "us": [i * 1000 for i in range(5000)], "action": ["write" if i % 2 else "delete" for i in range(5000)], "decision": ["approve" if i % 7 == 0 else "request" for i in range(5000)]})
    (out,) = run((1,), iter([rows[2500:], rows[:2500]]), state)  # Arrow batches in any order
    assert state.writes == 1
    last = {x.id: x.status for x in out.itertuples()}  # a request's later row is its outcome
    nearest = lambda i: next((j for j in range(i + 1, 5000) if j % 7 == 0 and (j - i) % 2 == 0), None)
    want = {i: "pending" if nearest(i) is None else "approved" if nearest(i) - i <= 10 else "expired" for i in range(5000) if i % 7}
    assert last == want and "expired" in want.values() and "pending" in want.values()
    left = sorted(i for i, s in want.items() if s == "pending")
    assert sorted(state.value[0]) == left and state.timeout == left[0] + 9
    state.hasTimedOut, state.now = True, left[-1] + 10
    (out,) = run((1,), iter([]), state)
    assert sorted(out["id"]) == left and set(out["status"]) == {"expired"} and state.value is None
