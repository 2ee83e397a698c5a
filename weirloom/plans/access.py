"""Access control, listings and counters: tenants, shares and members over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.plans.registry import query, table
from weirloom.sources.sinks import durable

# knowledge bases are suppliers, users customers; tenants (5 bases, 75 users) and organisations (15 users) follow from key arithmetic, so both sides of a join grow together
_KB = "kb AS (SELECT s_suppkey AS kb_id, s_suppkey // 5 AS tenant FROM supplier)"
_SHARES = "shares AS (SELECT s_suppkey AS kb_id, s_suppkey AS org, ['viewer', 'editor', 'admin'][(s_suppkey % 3)::int + 1] AS role FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, s_suppkey + 2, 'editor' FROM supplier WHERE s_suppkey % 7 = 0)"
_MEMBERS = "members AS (SELECT c_custkey AS user_id, c_custkey // 75 AS tenant, c_custkey // 15 AS org, ['viewer', 'editor', 'admin'][(c_custkey % 3)::int + 1] AS role FROM customer)"
_RANK = "CASE {c} WHEN 'admin' THEN 3 WHEN 'editor' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END"
_ROLES = ["viewer", "editor", "admin"]


def _role(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(r) for r in _ROLES)), (n % 3 + 1).cast("int"))


def rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "admin", 3).when(c == "editor", 2).when(c == "viewer", 1).otherwise(0)


def role_of(n: Column) -> Column:
    return F.when(n == 3, "admin").when(n == 2, "editor").when(n == 1, "viewer").otherwise("")


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    kb = s.select(F.col("s_suppkey").alias("kb_id"), F.floor(F.col("s_suppkey") / 5).alias("tenant"))
    key = F.col("s_suppkey")
    shares = s.where(key % 4 != 0).select(key.alias("kb_id"), key.alias("org"), _role(key).alias("role")).union(s.where(key % 7 == 0).select(key, key + 2, F.lit("editor")))
    c = F.col("c_custkey")
    members = table(spark, sf, "customer").select(c.alias("user_id"), F.floor(c / 75).alias("tenant"), F.floor(c / 15).alias("org"), _role(c).alias("role"))
    return kb, shares, members


def effective(spark: SparkSession, sf: str) -> DataFrame:
    """(kb_id, user_id, level): the best over shares of the lower of share and member; the owner's tenant is admin."""
    kb, shares, members = parts(spark, sf)
    shared = shares.join(members.withColumnRenamed("role", "member"), "org").select("kb_id", "user_id", F.least(rank("role"), rank("member")).alias("level"))
    own = kb.join(members.select("user_id", "tenant"), "tenant").select("kb_id", "user_id", F.lit(3).alias("level"))
    return shared.union(own).groupBy("kb_id", "user_id").agg(F.max("level").alias("level"))


_EFFECTIVE = f"eff AS (SELECT kb_id, user_id, max(level) AS level FROM (SELECT s.kb_id, m.user_id, least({_RANK.format(c='s.role')}, {_RANK.format(c='m.role')}) AS level FROM shares s JOIN members m ON m.org = s.org UNION ALL SELECT k.kb_id, m.user_id, 3 FROM kb k JOIN members m ON m.tenant = k.tenant) GROUP BY ALL)"
_WITH = f"WITH {_KB}, {_SHARES}, {_MEMBERS}, {_EFFECTIVE}"


@query("a4_effective_role", f"{_WITH} SELECT kb_id, user_id, ['viewer', 'editor', 'admin'][level] AS role FROM eff")
def effective_role(spark: SparkSession, sf: str) -> DataFrame:
    return effective(spark, sf).select("kb_id", "user_id", role_of(F.col("level")).alias("role"))


@query("j3_share_members", f"{_WITH} SELECT s.kb_id, count(*) AS n, count(DISTINCT m.user_id) AS users FROM shares s JOIN members m ON m.org = s.org GROUP BY s.kb_id")
def share_members(spark: SparkSession, sf: str) -> DataFrame:
    _, shares, members = parts(spark, sf)
    return shares.join(members.select("org", "user_id"), "org").groupBy("kb_id").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("j2_accessible_bases", f"{_WITH} SELECT DISTINCT k.kb_id FROM kb k LEFT JOIN shares s ON s.kb_id = k.kb_id LEFT JOIN members m ON m.org = s.org AND m.user_id = 7 WHERE k.tenant = 3 OR m.user_id IS NOT NULL")
def accessible(spark: SparkSession, sf: str) -> DataFrame:
    kb, shares, members = parts(spark, sf)
    mine = members.where("user_id = 7").select(F.col("org").alias("m_org"), "user_id")
    rows = kb.join(shares.select("kb_id", "org"), "kb_id", "left").join(mine, F.col("org") == F.col("m_org"), "left")
    return rows.where("tenant = 3 OR user_id IS NOT NULL").select("kb_id").distinct()


@query("a2_distinct_bases", f"{_WITH} SELECT count(DISTINCT k.kb_id) AS n FROM kb k LEFT JOIN shares s ON s.kb_id = k.kb_id LEFT JOIN members m ON m.org = s.org AND m.user_id = 7 WHERE k.tenant = 3 OR m.user_id IS NOT NULL")
def distinct_bases(spark: SparkSession, sf: str) -> DataFrame:
    return accessible(spark, sf).agg(F.count("*").alias("n"))


@query("u6_requested_bases", f"{_WITH}, r AS (SELECT user_id, list_sort(list(kb_id)) AS allowed FROM eff GROUP BY user_id) SELECT user_id, len(list_filter([1, 2, 3], lambda x: NOT list_contains(allowed, x))) = 0 AS permitted, len(list_filter([1, 2, 3], lambda x: list_contains(allowed, x))) AS n FROM r")
def requested(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    rows = effective(spark, sf).groupBy("user_id").agg(F.collect_set(F.col("kb_id").cast("long")).alias("allowed"))
    return rows.select("user_id", (F.size(F.array_except(wanted, "allowed")) == 0).alias("permitted"), F.size(F.array_intersect(wanted, "allowed")).cast("long").alias("n"))


@query("u5_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("t9_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paging(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("t11_latest_by_key", "SELECT user_id, max_by(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM events GROUP BY user_id")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("t17_audit_list", "SELECT event_id, event_type FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 25")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("user_id = 5").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type")


@query("a1_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers FROM orders")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.countDistinct("o_custkey").alias("customers"))


@query("j15_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_quantity >= 49")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").where("l_quantity >= 49").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j16_state_overlay", "SELECT d.doc_id, coalesce(nullif(s.state, ''), d.lang) AS status, coalesce(s.n, d.n_chars) AS n FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'live' END AS state, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS n FROM labels) s USING (doc_id)")
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise("live").alias("state"), F.when(F.col("doc_id") % 5 != 0, F.col("quality")).alias("n"))
    return table(spark, sf, "documents").join(state, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("state", F.lit("")), "lang").alias("status"), F.coalesce("n", "n_chars").alias("n"))


@query("s20_paged_scan", "SELECT event_id, left(props, 20) AS clipped FROM events WHERE starts_with(event_id::varchar, '1') ORDER BY event_id::varchar LIMIT 50 OFFSET 100")
def paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    return table(spark, sf, "events").where(F.startswith(key, F.lit("1"))).orderBy(key).offset(100).limit(50).select("event_id", F.left("props", F.lit(20)).alias("clipped"))


@query("tag_tree", "WITH RECURSIVE t(id, root, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey <= 5 UNION ALL SELECT p.p_partkey, t.root, t.depth + 1 FROM part p JOIN t ON p.p_partkey // 5 = t.id AND p.p_partkey > 5) SELECT id, root, depth FROM t")
def tag_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A self reference followed level by level, until a level is empty."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 5).alias("parent"))
    level = rows.where("id <= 5").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = durable(rows.where("id > 5").join(level.select(F.col("id").alias("parent"), "root"), "parent").select("id", "root", F.lit(depth).alias("depth")))
        out = out.union(level)
    return out


