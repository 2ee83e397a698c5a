"""What a chat remembers: the session's last messages, and the user's other sessions, each within a budget.

Messages are written as lines until the budget is reached: the line that reaches it still counts,
what comes after does not. The same holds for sessions. Running sums over windows decide, so no
session is gathered before it is cut: at most LINES messages of each are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.functions import text as T
from weirloom.operators.retrieve import top

#: Lines of a session at most, characters of a message, other sessions of a user.
LINES, CLIP, SESSIONS = 12, 400, 5
# What the instruction calls the parties and its parts.
USER, ASSISTANT = "用户", "助手"
SHORT_TERM, LONG_TERM, SESSION = "【会话短期记忆】\n", "【跨会话长期记忆（数据库）】\n", "[历史会话] "


def _within(rows: DataFrame, keys: list[str], order: Column | str, size: Column, budget: int) -> DataFrame:
    """The rows up to and with the one that reaches the budget, in order."""
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("spent", F.coalesce(before, F.lit(0))).where(F.col("spent") < budget).drop("spent")


def _joined(rows: DataFrame, keys: list[str], order: str, part: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part])
    return rows.groupBy(*keys).agg(F.array_join(listed, "").alias("text"))


def lines(messages: DataFrame, last: int, budget: int) -> DataFrame:
    """(conv_id, text): the last messages of each session (conv_id, turn, role, text) as lines within the budget in bytes; sessions without any are left out."""
    recent = top(messages.select("conv_id", "turn", "role", "text"), min(last, LINES), ["conv_id"], F.desc("turn"))
    clean = T.trimmed(F.coalesce("text", F.lit("")))
    who = F.when(F.lower("role") == "assistant", ASSISTANT).otherwise(USER)
    rows = recent.where(clean != "").withColumn("line", F.concat(who, F.lit(": "), T.truncated(clean, CLIP), F.lit("\n")))
    return _joined(_within(rows, ["conv_id"], "turn", F.octet_length("line"), budget), ["conv_id"], "turn", "line").withColumn("text", T.truncated(T.trimmed(F.col("text")), budget))


def instruction(messages: DataFrame, sessions: DataFrame, window: int = 8, budget: int = 5000, each: int = 2) -> DataFrame:
    """(conv_id, memory) for every session of sessions (conv_id, user_id, updated, title) that has any memory: half of the budget for its own messages, half for the user's latest other sessions, of which each has a quarter."""
    short = lines(messages, 2 * window, budget // 2).withColumn("text", F.concat(F.lit(SHORT_TERM), "text"))
    newest = top(sessions, SESSIONS, ["user_id"], F.desc("updated"), F.desc("conv_id")).select("user_id", F.col("conv_id").alias("other"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("conv_id").cast("string")).alias("title"), F.col("rank").alias("place"))
    told = lines(messages, 2 * each, budget // 4).withColumnsRenamed({"conv_id": "other", "text": "told"})
    parts = newest.join(told, "other").withColumn("part", F.concat(F.lit(SESSION), "title", F.lit("\n"), "told", F.lit("\n")))
    # a user has at most SESSIONS of them, so each session meets a handful
    pairs = sessions.where("user_id IS NOT NULL").select("conv_id", "user_id").join(parts, "user_id").where("conv_id <> other")
    kept = _within(pairs, ["conv_id"], "place", F.octet_length("part"), budget // 2)
    clipped = lambda c: T.truncated(T.trimmed(c), budget // 2)
    long = _joined(kept, ["conv_id"], "place", "part").withColumn("text", F.concat(F.lit(LONG_TERM), clipped(F.col("text"))))
    both = sessions.select("conv_id").join(short.withColumnRenamed("text", "a"), "conv_id", "left").join(long.withColumnRenamed("text", "b"), "conv_id", "left")
    return both.withColumn("memory", F.concat_ws("\n\n", "a", "b")).where("memory <> ''").select("conv_id", "memory")
