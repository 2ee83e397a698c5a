"""Streaming queries: each runs a stream over the events until it has caught up, and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.plans.registry import query, table
from weirloom.sources.sinks import scratch
from weirloom.streaming import keyed as K
from weirloom.streaming import stateful as S


def stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """A table as a file stream; events get timestamps of the session's time zone."""
    schema = table(spark, sf, name).schema
    # a file source takes a folder: the one that holds the table, with the table's name as filter
    folder = _is_folder(spark, f"{sf}/{name}.parquet")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}*").parquet(f"{sf}/{name}.parquet" if folder else sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _is_folder(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("e1_queue_ingestion", "SELECT event_id % 7 = 0 OR value > 150 AS bad, count(*) AS n FROM events GROUP BY 1")
def queue_ingestion(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    S.ingest(stream(spark, sf), path, ~((F.col("event_id") % 7 == 0) | (F.col("value") > 150)))
    good, bad = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/quarantine")
    return good.agg(F.count("*").alias("n")).select(F.lit(False).alias("bad"), "n").union(bad.agg(F.count("*").alias("n")).select(F.lit(True), "n"))


@query("e2_task_states", "SELECT user_id AS task_id, max_by(['queued', 'parsing', 'vectorizing', 'completed', 'failed'][(event_id % 5)::int + 1], struct_pack(ts := ts, s := ['queued', 'parsing', 'vectorizing', 'completed', 'failed'][(event_id % 5)::int + 1])) AS stage, count(*) AS n FROM events GROUP BY user_id")
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    """In update mode: a batch writes the tasks that changed, the log's last rows are the table."""
    stage = F.element_at(F.array(*(F.lit(s) for s in K.STAGES)), (F.col("event_id") % 5 + 1).cast("int"))
    updates = stream(spark, sf).select(F.col("user_id").alias("task_id"), stage.alias("stage"), "ts")
    path = scratch(spark)
    K.log_changes(K.task_states(updates), path)
    return K.latest(spark, path, "task_id", "n")


_PIECES = ("a<thi", "nk>hidden</th", "ink> b", "c", "<x>")


@query("e3_think_filter", "WITH e AS (SELECT user_id, event_id, ['a<thi', 'nk>hidden</th', 'ink> b', 'c', '<x>'][(event_id % 5)::INT + 1] AS piece FROM events) SELECT user_id AS stream_id, regexp_replace(regexp_replace(string_agg(piece, '' ORDER BY event_id), '(?s)<think>.*?</think>\\s*', '', 'g'), '(?s)<think>.*$', '') AS text FROM e GROUP BY user_id")
def think_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as the chunks of a stream whose tags are split between chunks; the greatest event of a user ends it."""
    pieces = F.element_at(F.array(*(F.lit(s) for s in _PIECES)), (F.col("event_id") % 5 + 1).cast("int"))
    ends = table(spark, sf, "events").groupBy(F.col("user_id").alias("u")).agg(F.max("event_id").alias("end"))
    events = stream(spark, sf)
    chunks = events.join(ends, events.user_id == ends.u).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "ts", pieces.alias("chunk"), (F.col("event_id") == F.col("end")).alias("last"))
    path = scratch(spark)
    S.run_once(S.think_filter(chunks), path)
    return spark.read.parquet(f"{path}/out")


@query("e4_rate_limit")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    events = stream(spark, sf).select((F.col("user_id") % 10).alias("client"), "event_id", "ts")
    path = scratch(spark)
    S.run_once(S.rate_limited(events, per_minute=0.1, burst=3), path)
    return spark.read.parquet(f"{path}/out")


@query("e_windowed_counts", "SELECT date_trunc('day', ts::TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the watermarked windows: all of them, closed or not."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(events).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("e9_sessions", "WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts > before + INTERVAL 30 MINUTE OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT event_id, user_id, ts::TIMESTAMP AS ts FROM events))) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(events).select("user_id", F.col("w.start").alias("start"), "n")


@query("e1_redelivery", "SELECT DISTINCT user_id AS task_id FROM events")
def redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks delivered many times: what one trigger brings, each comes through once."""
    tasks = stream(spark, sf).select(F.col("user_id").alias("task_id"), "ts")
    path = scratch(spark)
    S.run_once(S.deduplicated(tasks), path)
    return spark.read.parquet(f"{path}/out").select("task_id")


@query("e6_session_window", "SELECT conv_id, count(*) AS n, min(turn) AS first, array_to_string(list(role ORDER BY turn), ',') AS roles FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4 GROUP BY conv_id")
def session_window(spark: SparkSession, sf: str) -> DataFrame:
    """The last four messages of each session, kept as list state while messages stream in."""
    path = scratch(spark)
    K.log_changes(K.session_windows(stream(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), 2), path)
    return K.latest(spark, path, "conv_id", "last").select("conv_id", "n", "first", "roles")


#: Requests are open for twelve hours.
APPROVAL_MS = 12 * K.HOUR_MS
_KIND = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'request' END"
_ACTION = "CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'delete' END"


@query("e8_approvals", f"""WITH e AS (SELECT event_id AS id, user_id, ts::TIMESTAMP AS ts, {_KIND} AS kind, {_ACTION} AS action FROM events), d AS (SELECT * FROM e WHERE kind <> 'request'),
r AS (SELECT e.id, e.user_id, e.action, e.ts, min_by(struct_pack(ts := d.ts, kind := d.kind), struct_pack(ts := d.ts, id := d.id)) AS d FROM e LEFT JOIN d ON d.user_id = e.user_id AND d.action = e.action AND (d.ts > e.ts OR d.ts = e.ts AND d.id > e.id) WHERE e.kind = 'request' GROUP BY ALL)
SELECT id, user_id, sha256(action || ':' || user_id) AS action_hash, CASE WHEN d.ts <= ts + INTERVAL 12 HOUR THEN CASE d.kind WHEN 'approve' THEN 'approved' ELSE 'rejected' END WHEN d.ts IS NOT NULL OR ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM e) THEN 'expired' ELSE 'pending' END AS status FROM r""")
def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests and decisions: a decision settles the user's open requests of its action, a timer expires them."""
    kind, action = F.expr(_KIND), F.expr(_ACTION)
    path = scratch(spark)
    K.log_changes(K.approvals(stream(spark, sf).select("user_id", F.col("event_id").alias("id"), "ts", action.alias("action"), kind.alias("decision")), APPROVAL_MS), path, timers=True)
    order = F.when(F.col("status") == "pending", 0).otherwise(1)
    log = spark.read.parquet(f"{path}/log").groupBy("id", "user_id", "action_hash").agg(F.max_by("status", F.struct("batch", order)).alias("status"))
    return log.select("id", "user_id", "action_hash", "status")
