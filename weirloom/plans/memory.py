"""Memory queries over conversations: last messages, evidence reuse, budgets, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.functions import text as T
from weirloom.operators import memory as M
from weirloom.operators.retrieve import top
from weirloom.plans.registry import query, table

_BACK = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


def last(messages: DataFrame, n: int) -> DataFrame:
    return top(messages, n, ["conv_id"], F.desc("turn"))


@query("w3_last_messages", f"SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, {_BACK} AS b FROM conversations) WHERE b <= 3")
def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    return last(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


@query("w11_last_evidence", f"SELECT conv_id, max_by(turn, turn) AS turn FROM (SELECT conv_id, turn, role, text, {_BACK} AS b FROM conversations) WHERE b <= 8 AND role = 'assistant' AND length(text) % 2 = 0 GROUP BY conv_id")
def last_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The last assistant message with sources among the last eight; an even length stands in for having sources."""
    rows = last(table(spark, sf, "conversations"), 8).where((F.col("role") == "assistant") & (F.char_length("text") % 2 == 0))
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("w12_character_budget", "SELECT conv_id, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM (SELECT *, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 1500 GROUP BY conv_id")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    """Messages are appended until the budget is reached: the one that passes it is the last."""
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    kept = table(spark, sf, "conversations").withColumn("before", F.coalesce(before, F.lit(0))).where("before < 1500")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("w17_user_snippets", f"WITH u AS (SELECT conv_id, turn, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 40) AS s FROM (SELECT *, {_BACK} AS b FROM conversations) WHERE b <= 6 AND role = 'user'), d AS (SELECT conv_id, s, min(turn) AS turn FROM u WHERE s <> '' GROUP BY ALL) SELECT conv_id, left(string_agg(s, ' | ' ORDER BY turn), 120) AS snippets FROM d GROUP BY conv_id")
def user_snippets(spark: SparkSession, sf: str) -> DataFrame:
    rows = last(table(spark, sf, "conversations"), 6).where("role = 'user'").select("conv_id", "turn", F.left(T.squeezed(F.col("text")), F.lit(40)).alias("s")).where("s <> ''")
    each = rows.groupBy("conv_id", "s").agg(F.min("turn").alias("turn"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), " | ")
    return each.groupBy("conv_id").agg(F.left(joined, F.lit(120)).alias("snippets"))


@query("w14_trace_numbering", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, coalesce(nullif(event_type, 'view'), 'step') AS type FROM events")
def trace_numbering(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", seq.alias("seq"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("step")).alias("type"))


_RUNS = "r AS (SELECT user_id, event_type, seq - row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))"


@query("w13_repeated_runs", f"WITH {_RUNS} SELECT user_id, event_type, island, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3")
def repeated_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of three or more equal steps in a row, as islands."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("seq"))
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", seq.alias("seq")).withColumn("island", F.col("seq") - own)
    return rows.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n")).where("n >= 3")


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _told(last: int, budget: int) -> str:
    """SQL for the lines of each session's last messages within a budget in bytes."""
    clean = _TRIM.format("text")
    clip = f"CASE WHEN length({clean}) > 400 THEN left({clean}, 400) || '...' ELSE {clean} END"
    line = f"CASE WHEN role = 'assistant' THEN '{M.ASSISTANT}' ELSE '{M.USER}' END || ': ' || {clip} || chr(10)"
    told = _TRIM.format("string_agg(line, '' ORDER BY turn)")
    return f"(SELECT conv_id, CASE WHEN length({told}) > {budget} THEN left({told}, {budget}) || '...' ELSE {told} END AS told FROM (SELECT *, coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT conv_id, turn, {line} AS line FROM (SELECT *, {_BACK} AS b FROM conversations) WHERE b <= {min(last, 12)} AND {clean} <> '')) WHERE spent < {budget} GROUP BY conv_id)"


#: Every twentieth session is of the same user, the later the higher its number; every third has a title.
_SESSIONS = "sess AS (SELECT DISTINCT conv_id, conv_id % 20 AS user_id, CASE WHEN conv_id % 3 = 0 THEN 'session ' || conv_id ELSE ' ' END AS title FROM conversations)"


@query("q24_memory_instruction", f"""WITH {_SESSIONS}, a AS {_told(16, 1000)}, o AS {_told(4, 500)},
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conv_id DESC) AS place FROM sess) WHERE place <= 5),
p AS (SELECT s.conv_id, n.place, '{M.SESSION}' || coalesce(nullif(trim(n.title), ''), n.conv_id::VARCHAR) || chr(10) || o.told || chr(10) AS part FROM sess s JOIN n USING (user_id) JOIN o ON o.conv_id = n.conv_id WHERE n.conv_id <> s.conv_id),
l AS (SELECT conv_id, {_TRIM.format("string_agg(part, '' ORDER BY place)")} AS t FROM (SELECT *, coalesce(sum(octet_length(encode(part))) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p) WHERE spent < 1000 GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10) || chr(10), '{M.SHORT_TERM.strip()}' || chr(10) || told, '{M.LONG_TERM.strip()}' || chr(10) || CASE WHEN length(t) > 1000 THEN left(t, 1000) || '...' ELSE t END) AS memory FROM sess LEFT JOIN a USING (conv_id) LEFT JOIN l USING (conv_id) WHERE told IS NOT NULL OR t IS NOT NULL""")
def memory_instruction(spark: SparkSession, sf: str) -> DataFrame:
    """The session's own last messages, then the user's latest other sessions, within half of the budget each."""
    rows = table(spark, sf, "conversations")
    title = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("session "), F.col("conv_id").cast("string"))).otherwise(" ")
    sessions = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").alias("updated"), title.alias("title"))
    return M.instruction(rows, sessions, budget=2000)


@query("q25_follow_up_evidence", "WITH e AS (SELECT conv_id, turn, CASE WHEN length(trim(text)) > 360 THEN left(trim(text), 360) || '...' ELSE trim(text) END AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant'), b AS (SELECT *, sum(octet_length(encode(c))) OVER (PARTITION BY conv_id ORDER BY n) AS total FROM e WHERE n <= 3) SELECT conv_id, count(*) AS n, sum(length(c))::BIGINT AS chars FROM b WHERE total <= 900 GROUP BY conv_id")
def follow_up_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three sources of the last answers, clipped, while the budget lasts."""
    rows = top(table(spark, sf, "conversations").where("role = 'assistant'"), 3, ["conv_id"], F.desc("turn")).withColumn("c", T.truncated(F.trim("text"), 360))
    kept = rows.withColumn("total", F.sum(F.octet_length("c")).over(Window.partitionBy("conv_id").orderBy("rank"))).where("total <= 900")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("c")).alias("chars"))


@query("n2_stored_sources", "SELECT conv_id, turn, json_extract_string(s, '$.doc') AS doc FROM (SELECT conv_id, turn, '{\"doc\": \"d' || turn || '\", \"score\": ' || (turn % 3) || '}' AS s FROM conversations WHERE role = 'assistant') WHERE json_extract_string(s, '$.score')::int > 0")
def stored_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("turn").cast("string")
    steps = F.concat(F.lit('[{"doc": "d'), n, F.lit('", "score": '), (F.col("turn") % 3).cast("string"), F.lit("}]"))
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json(steps, "array<struct<doc:string,score:int>>")).alias("s"))
    return rows.where("s.score > 0").select("conv_id", "turn", "s.doc")


_LEVELS = ", ".join(f"nullif(last_value(CASE WHEN level = {k} THEN trim(line[{k + 1}:]) WHEN level > 0 AND level < {k} THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS h{k}" for k in (1, 2, 3))


@query("w9_header_stack", f"WITH p AS (SELECT doc_id, string_split('# ' || source || chr(10) || '## a' || chr(10) || text || chr(10) || '### b' || chr(10) || 'x' || chr(10) || '## c' || chr(10) || 'y', chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(range(0, len(lines)))::INT AS seq, unnest(lines) AS line FROM p), v AS (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM l), s AS (SELECT doc_id, seq, {_LEVELS} FROM v) SELECT doc_id, seq, concat_ws(' > ', h1, h2, h3) AS path FROM s")
def header_stack(spark: SparkSession, sf: str) -> DataFrame:
    """For each line, the last header of every level above it that no higher one has closed."""
    page = F.concat(F.lit("# "), F.col("source"), F.lit("\n## a\n"), "text", F.lit("\n### b\nx\n## c\ny"))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(page, "\n")).alias("seq", "line"))
    level = F.char_length(F.regexp_extract("line", "^(#+)", 1))
    rows = lines.withColumn("level", level)
    order = Window.partitionBy("doc_id").orderBy("seq")
    parts = []
    for k in (1, 2, 3):
        mark = F.when(F.col("level") == k, F.trim(F.expr(f"substring(line, {k + 1})"))).when((F.col("level") > 0) & (F.col("level") < k), "")
        parts.append(F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))
    return rows.select("doc_id", "seq", F.concat_ws(" > ", *parts).alias("path"))
