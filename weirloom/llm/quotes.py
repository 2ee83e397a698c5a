"""Chat formatting: quotation linking.

1. A message's lines carry a quote level, the number of `>` marks before them (spaces between
   allowed). Runs of lines of one level above 0 are quoted passages; a line that announces a
   quote ("... wrote:" just before one) belongs to it. The rest is the message itself.
2. Passages are normalised (white space to one space, A-Z lower-cased, trimmed) and hashed by
   SHA-256, as are the paragraphs, the lines and the whole of every message without quotes,
   and each run of its lines (blank ones left out) that begins with the first line of some
   passage and has as many lines.
3. An equi-join on the hash finds where a passage was first written: the latest earlier
   message of the same conversation, else the first message of another one that has it. Both
   are reduced by hash before the join (an as-of window for the former, one row for a hash for
   the latter, its first messages in the two smallest conversations), so a passage that many
   messages share does not multiply.
4. A message answers the message of its first linked quote in the conversation (the lowest
   level wins). Conversations are ordered as reply trees: a message follows what it answers,
   siblings by turn; messages that answer nothing keep the order of turns. The tour of a tree
   (into a message, its answers, out of it) is a linked list of two entries a message, ranked
   by pointer doubling, so a chain of n answers takes log n joins of n rows. Siblings and rows
   are numbered by range sorts with a table of a row per task, so neither a conversation nor a
   message with many answers is ever one task's.

Defined results: null text is empty; a null conversation or turn is a value of its own (null
turns first); equal (conv_id, turn) are told apart by text, equal rows get consecutive
positions; a quote of a later or the same message is no link, so there are no cycles; an empty
table gives an empty one; only the four columns of the contract are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "), "^ | $", "")


def line_structs(text: Column) -> Column:
    """array<struct<level,line>>: each line's quote level and what follows the marks."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)  # noqa: E731
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.struct(F.length(F.regexp_replace(marks(line), "[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("line")))


def passages(lines: Column) -> Column:
    """array<struct<level,text>>: runs of lines of equal level, joined by line breaks; blank ones are left out."""
    start = F.expr("named_struct('done', CAST(array() AS array<struct<level:int,text:string>>), 'level', CAST(0 AS int), 'text', '')")

    def step(acc: Column, x: Column) -> Column:
        same = acc["level"] == x["level"]
        held = F.struct(acc["level"].alias("level"), acc["text"].alias("text"))
        return F.struct(
            F.when(same, acc["done"]).otherwise(F.array_append(acc["done"], held)).alias("done"),
            x["level"].alias("level"),
            F.when(same, F.concat(acc["text"], F.lit("\n"), x["line"])).otherwise(x["line"]).alias("text"),
        )

    runs = F.aggregate(lines, start, step, lambda acc: F.array_append(acc["done"], F.struct(acc["level"].alias("level"), acc["text"].alias("text"))))
    return F.filter(runs, lambda r: F.trim(normalised(r["text"])) != "")


def full_lines(text: Column) -> Column:
    """The normalised lines of a text without blank ones; joined by spaces they are the normalised text."""
    return F.filter(F.transform(F.split(text, r"\n"), normalised), lambda x: x != "")


def parse(messages: DataFrame) -> DataFrame:
    """mid (a number of the row), conv_id, turn, role, node (a key of the row's content), own (text without quotes) and quotes (array<struct<level,hash,head,size>>: head is a hash of the first line, size the number of lines)."""
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("runs", passages(line_structs(F.col("text"))))
    quoted = F.filter("runs", lambda r: r["level"] > 0)
    plain = F.filter("runs", lambda r: r["level"] == 0)
    own = F.array_join(F.transform(plain, lambda r: F.trim(F.regexp_replace(F.regexp_replace(r["text"], r"(?:^|\n)[^\n]*wrote:[ \t]*\n?$", ""), r"^\n+|\s+$", ""))), "\n")
    has = F.size(quoted) > 0
    rows = rows.withColumn("own", F.when(has, F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("quotes", F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), F.sha2(normalised(r["text"]), 256).alias("hash"), F.xxhash64(F.get(full_lines(r["text"]), 0)).alias("head"), F.size(full_lines(r["text"])).alias("size"))))
    return rows.select(F.monotonically_increasing_id().alias("mid"), "conv_id", "turn", "role", F.xxhash64("role", "text").alias("node"), "own", "quotes")


def originals(parsed: DataFrame) -> DataFrame:
    """(hash, conv_id, turn, node) of every whole, paragraph and line that a message wrote itself."""
    units = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", r"\n"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(units, normalised), lambda u: u != ""), lambda u: F.sha2(u, 256)))
    return parsed.select(F.explode(keys).alias("hash"), "conv_id", "turn", "node")


def runs(parsed: DataFrame, starts: DataFrame) -> DataFrame:
    """(hash, conv_id, turn, node) of every run of lines that a message wrote itself and that has the first line and the size of one of starts (head, size)."""
    key = ["conv_id", "turn", "node"]
    own = parsed.dropDuplicates(key).select(*key, full_lines(F.col("own")).alias("lines"))
    heads = own.select(*key, F.posexplode(F.transform("lines", lambda x: F.xxhash64(x))).alias("place", "head"))
    found = heads.join(starts, "head").groupBy(*key).agg(F.collect_set(F.struct("place", "size")).alias("at")).withColumnsRenamed({k: f"f_{k}" for k in key})
    joined = own.join(found, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key]).select(*key, "lines", "at")
    held = F.filter("at", lambda x: x["place"] + x["size"] <= F.size("lines"))
    hashes = F.transform(held, lambda x: F.sha2(F.array_join(F.slice("lines", x["place"] + 1, x["size"]), " "), 256))
    return joined.select(F.explode(F.array_distinct(hashes)).alias("hash"), *key)


def link(parsed: DataFrame) -> DataFrame:
    """A row for each linked quote: conv_id, turn, node, place, level, and the origin as o_conv, o_turn, o_node."""
    quotes = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", "node", F.posexplode("quotes").alias("place", "q")).select("conv_id", "turn", "node", "place", F.col("q.level").alias("level"), F.col("q.hash").alias("hash"), F.col("q.head").alias("head"), F.col("q.size").alias("size"))
    quotes = durable(quotes, "quotes")
    wanted = quotes.select("hash").distinct()
    units, starts = originals(parsed), quotes.where("size > 1").select("head", "size").distinct()
    if starts.limit(1).count():
        units = units.union(runs(parsed, starts)).distinct()
    known = durable(units.join(wanted, "hash", "left_semi"), "originals")
    at = F.struct("turn", "node")
    # the latest earlier message of the conversation: an as-of join as a window over both sides
    sides = known.select("hash", "conv_id", "turn", "node", at.alias("origin"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("level")).unionByName(quotes.select("hash", "conv_id", "turn", "node", F.lit(None).cast(known.select(at.alias("x")).schema["x"].dataType).alias("origin"), "place", "level"))
    order = Window.partitionBy("hash", "conv_id").orderBy(F.asc_nulls_first("turn"))
    sides = sides.withColumn("rank", F.dense_rank().over(order))
    before = Window.partitionBy("hash", "conv_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    near = sides.withColumn("origin", F.max(F.when(F.col("origin").isNotNull(), F.struct("rank", "origin"))).over(before)).where("place IS NOT NULL")
    near = near.select("hash", "conv_id", "turn", "node", "place", "level", F.col("origin.origin").alias("origin"))
    least = known.groupBy("hash", "conv_id").agg(F.min(at).alias("at")).withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(F.asc_nulls_first("conv_id")))).where("n <= 2")
    first = least.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("n", "conv_id", F.col("at.turn").alias("turn"), F.col("at.node").alias("node")))).alias("far"))
    both = near.join(first, "hash", "left")
    both = both.withColumn("far", F.get(F.filter("far", lambda x: ~x["conv_id"].eqNullSafe(F.col("conv_id"))), 0))
    other = F.col("far")
    found = both.where(F.col("origin").isNotNull() | other.isNotNull())
    pick = lambda name: F.when(F.col("origin").isNotNull(), F.col(f"origin.{name}")).otherwise(other[name])  # noqa: E731
    return found.select("conv_id", "turn", "node", "place", "level", F.when(F.col("origin").isNotNull(), F.col("conv_id")).otherwise(other["conv_id"]).alias("o_conv"), pick("turn").alias("o_turn"), pick("node").alias("o_node"), F.col("origin").isNotNull().alias("near"))


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows as a table in global order, with part, the number of the range that holds them. Nulls come first."""
    count = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return durable(rows.repartitionByRange(count, *(F.asc_nulls_first(c) for c in order)).withColumn("part", F.spark_partition_id()), "ranged")


def tours(edges: DataFrame) -> DataFrame:
    """Rows (conv_id, id, root, rank) of every message of a tree with answers, from edges (conv_id, id, turn, node, parent): its root and how many messages come before it in the tree."""
    group, order = ["conv_id", "parent"], ["turn", "node", "id"]
    sorted_ = ranged(edges, group + order)
    within = Window.partitionBy("part", *group).orderBy(*(F.asc_nulls_first(c) for c in order))
    over = Window.orderBy("part")  # a row for each task of the sort
    key = F.struct(*group)
    least = sorted_.groupBy("part").agg(F.min_by(F.struct(key.alias("key"), "id"), F.struct(*group, *order)).alias("first"), F.max_by(key, F.struct(*group, *order)).alias("last"))
    least = least.select("part", F.lead("first").over(over).alias("below"), F.lag("last").over(over).alias("above"))
    child = sorted_.withColumns({"following": F.lead("id").over(within), "place": F.row_number().over(within)}).join(least, "part")
    child = child.withColumn("following", F.when(F.col("following").isNull() & F.col("below.key").eqNullSafe(key), F.col("below.id")).otherwise(F.col("following")))
    child = child.withColumn("eldest", (F.col("place") == 1) & ~F.coalesce(F.col("above").eqNullSafe(key), F.lit(False)))
    # entries of the lists: into (True) a message, or out of it; weight counts messages
    eldest = child.where("eldest").select("conv_id", F.col("parent").alias("id"), F.col("id").alias("to"))
    members = child.select("conv_id", "id", "parent", "following", F.lit(True).alias("answer")).unionByName(eldest.select("conv_id", "id", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("following"), F.lit(False).alias("answer")))
    members = members.groupBy("conv_id", "id").agg(F.max("parent").alias("parent"), F.max("following").alias("following"))
    same = members["conv_id"].eqNullSafe(eldest["conv_id"]) & (members["id"] == eldest["id"])
    members = members.join(eldest, same, "left").select(members["conv_id"], members["id"], "parent", "following", "to")
    into, out = lambda c: F.struct(F.col(c).alias("id"), F.lit(True).alias("into")), lambda c: F.struct(F.col(c).alias("id"), F.lit(False).alias("into"))  # noqa: E731
    steps = F.array(
        F.struct(into("id").alias("at"), F.when(F.col("to").isNotNull(), into("to")).otherwise(out("id")).alias("next"), F.lit(1).cast("long").alias("weight")),
        F.struct(out("id").alias("at"), F.when(F.col("following").isNotNull(), into("following")).when(F.col("parent").isNotNull(), out("parent")).alias("next"), F.lit(0).cast("long").alias("weight")),
    )
    entries = durable(members.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.at", "s.next", "s.weight", F.col("s.at.id").alias("end")), "tours")
    while entries.where("next IS NOT NULL").limit(1).count():
        ahead = entries.select(F.col("conv_id").alias("a_conv"), F.col("at").alias("a_at"), F.col("next").alias("a_next"), F.col("weight").alias("a_weight"), F.col("end").alias("a_end"))
        done, open_ = entries.where("next IS NULL"), entries.where("next IS NOT NULL")
        joined = open_.join(ahead, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("next.id") == F.col("a_at.id")) & (F.col("next.into") == F.col("a_at.into")))
        entries = durable(done.unionByName(joined.select("conv_id", "at", F.col("a_next").alias("next"), (F.col("weight") + F.col("a_weight")).alias("weight"), F.col("a_end").alias("end"))), "tours")
    found = entries.where("at.into").select("conv_id", F.col("at.id").alias("id"), F.col("end").alias("root"), "weight")
    size = found.where("id = root").select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("weight").alias("size"))
    return found.join(size, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("root") == F.col("r_id"))).select("conv_id", "id", "root", (F.col("size") - F.col("weight")).alias("rank"))


def positions(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(mid, position) of rows (mid, conv_id, turn, node, id): the place of each in its conversation, from 0."""
    tour = tours(edges).withColumnsRenamed({"conv_id": "t_conv", "id": "t_id"})
    keys = rows.select(F.col("conv_id").alias("k_conv"), F.col("id").alias("k_id"), F.struct("turn", "node").alias("k_key")).dropDuplicates(["k_conv", "k_id"])
    tour = tour.join(keys, F.col("t_conv").eqNullSafe(F.col("k_conv")) & (F.col("root") == F.col("k_id"))).select("t_conv", "t_id", "rank", "k_key")
    placed = rows.join(tour, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("id") == F.col("t_id")), "left")
    placed = placed.select("mid", "conv_id", F.coalesce(F.col("k_key.turn"), F.when(F.col("k_key").isNull(), F.col("turn"))).alias("r_turn"), F.coalesce(F.col("k_key.node"), "node").alias("r_node"), F.coalesce("rank", F.lit(0)).alias("rank"))
    order = ["r_turn", "r_node", "rank", "mid"]
    sorted_ = ranged(placed, ["conv_id", *order])
    counts = sorted_.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that holds some of it
    counts = counts.select(F.col("part").alias("c_part"), F.col("conv_id").alias("c_conv"), F.coalesce(before, F.lit(0)).alias("skip")).where("skip > 0")
    number = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*(F.asc_nulls_first(c) for c in order))) - 1
    numbered = sorted_.withColumn("number", number).join(counts, (F.col("part") == F.col("c_part")) & F.col("conv_id").eqNullSafe(F.col("c_conv")), "left")
    return numbered.select("mid", (F.col("number") + F.coalesce("skip", F.lit(0))).cast("bigint").alias("position"))


def conversations(messages: DataFrame, texts: bool = True) -> DataFrame:
    """conv_id, turn, role, position (from 0, in reply order), reply_conv, reply_turn, n_quotes, n_linked, own (the text without quotes) or, without texts, own_sha256."""
    parsed = durable(parse(messages), "parsed")
    links = durable(link(parsed.drop("mid")), "quote-links")
    key = ["conv_id", "turn", "node"]
    answers = links.groupBy(*key).agg(F.count("*").cast("bigint").alias("n_linked"), F.min_by(F.struct("o_conv", "o_turn", "o_node", "near"), F.struct(~F.col("near"), "level", "place")).alias("to"))
    answers = durable(answers.withColumn("id", F.xxhash64(*key)), "answers")
    edges = answers.where("to.near").select("conv_id", "id", "turn", "node", F.xxhash64("conv_id", "to.o_turn", "to.o_node").alias("parent"))
    rows = parsed.select("mid", *key, F.xxhash64(*key).alias("id"))
    place = positions(rows, edges)
    found = rows.join(answers.select(F.col("conv_id").alias("a_conv"), F.col("id").alias("a_id"), "n_linked", "to"), F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("id") == F.col("a_id")), "left").select("mid", "n_linked", "to")
    own = F.col("own") if texts else F.sha2("own", 256).alias("own_sha256")
    shown = parsed.select("mid", "conv_id", "turn", "role", F.size("quotes").cast("bigint").alias("n_quotes"), own)
    out = shown.join(place.join(found, "mid"), "mid")
    return out.select(
        "conv_id", "turn", "role", "position", F.col("to.o_conv").alias("reply_conv"), F.col("to.o_turn").alias("reply_turn"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), shown.columns[-1],
    )  # fmt: skip


def quoting(messages: DataFrame) -> DataFrame:
    """Messages as mail readers would write them: odd turns quote the whole message of the turn before, every fourth from the third the first line of the message two turns before it.

    A turn with several messages is quoted by the greatest of them; the answered text stays below the quote.
    """
    earlier = messages.groupBy(F.col("conv_id").alias("e_conv"), F.col("turn").alias("e_turn")).agg(F.max("text").alias("e_text"))
    back = F.when(F.col("turn") % 2 == 1, 1).when(F.col("turn") % 4 == 2, 2)
    joined = messages.select("conv_id", "turn", "role", "text").withColumn("back", back).join(earlier, (F.col("conv_id") == F.col("e_conv")) & (F.col("turn") - F.col("back") == F.col("e_turn")), "left")
    quoted = F.when(F.col("back") == 1, F.concat(F.lit("> "), F.replace("e_text", F.lit("\n"), F.lit("\n> ")))).otherwise(F.concat(F.lit("> "), F.regexp_extract("e_text", r"^[^\n]*", 0)))
    said = F.concat(F.lit("Someone wrote:\n"), quoted, F.lit("\n"), F.coalesce("text", F.lit("")))
    return joined.select("conv_id", "turn", "role", F.when(F.col("e_text").isNull() | (F.trim("e_text") == ""), F.col("text")).otherwise(said).alias("text"))


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id and transcript: role and text of each message, in reply order, without quotes."""
    ordered = conversations(messages)
    return ordered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "own"))), lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("unknown")), F.lit("|>\n"), m["own"])), "\n").alias("transcript"))


def oracle() -> str:
    """DuckDB SQL of conversations(quoting(table), texts=False) for (conv_id, turn) that occur once: every unit of every message against every quote."""
    norm = lambda x: f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g')"  # noqa: E731
    full = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {norm('x')}), lambda x: x <> '')"  # noqa: E731
    return rf"""
WITH RECURSIVE m AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN e.text IS NULL OR trim(e.text) = '' THEN c.text ELSE 'Someone wrote:' || chr(10)
    || CASE WHEN c.turn % 2 = 1 THEN '> ' || replace(e.text, chr(10), chr(10) || '> ') ELSE '> ' || regexp_extract(e.text, '^[^
]*') END || chr(10) || coalesce(c.text, '') END AS text
  FROM conversations c LEFT JOIN conversations e ON e.conv_id = c.conv_id AND e.turn = c.turn - CASE WHEN c.turn % 2 = 1 THEN 1 WHEN c.turn % 4 = 2 THEN 2 END),
li AS (SELECT conv_id, turn, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '?
') AS parts FROM m)),
le AS (SELECT conv_id, turn, i, len(regexp_replace(regexp_extract(line, '^[ 	]*(?:>[ 	]?)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ 	]*(?:>[ 	]?)+', '') AS body FROM li),
ch AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS new FROM le),
gr AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM ch),
ru AS (SELECT * FROM (SELECT conv_id, turn, g, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS text FROM gr GROUP BY conv_id, turn, g) WHERE {norm('text')} <> ''),
q AS (SELECT conv_id, turn, level, row_number() OVER (PARTITION BY conv_id, turn ORDER BY g) AS place, {norm('text')} AS quote, len({full('text')}) AS size FROM ru WHERE level > 0),
ow AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.conv_id = m.conv_id AND q.turn = m.turn)
    THEN regexp_replace(coalesce((SELECT string_agg(trim(regexp_replace(regexp_replace(ru.text, '(?:^|
)[^
]*wrote:[ 	]*
?$', ''), '^
+|\s+$', '', 'g')), chr(10) ORDER BY g) FROM ru WHERE ru.level = 0 AND ru.conv_id = m.conv_id AND ru.turn = m.turn), ''), '^\s+|\s+$', '', 'g')
    ELSE coalesce(m.text, '') END AS own FROM m),
sizes AS (SELECT DISTINCT size FROM q WHERE size > 1),
un AS (SELECT DISTINCT * FROM (
  SELECT conv_id, turn, {norm('own')} AS unit FROM ow
  UNION ALL SELECT conv_id, turn, {norm('x')} FROM (SELECT conv_id, turn, unnest(string_split_regex(own, '
[ 	]*
')) AS x FROM ow)
  UNION ALL SELECT conv_id, turn, {norm('x')} FROM (SELECT conv_id, turn, unnest(string_split(own, chr(10))) AS x FROM ow)
  UNION ALL SELECT conv_id, turn, array_to_string(list_slice(fl, i, i + size - 1), ' ') FROM (SELECT conv_id, turn, fl, size, unnest(generate_series(1, len(fl) - size + 1)) AS i FROM (SELECT conv_id, turn, {full('own')} AS fl FROM ow), sizes WHERE len(fl) >= size)
) WHERE unit <> ''),
near AS (SELECT q.conv_id, q.turn, q.place, max(u.turn) AS o_turn FROM q JOIN un u ON u.unit = q.quote AND u.conv_id = q.conv_id AND u.turn < q.turn GROUP BY ALL),
far AS (SELECT * FROM (SELECT q.conv_id, q.turn, q.place, u.conv_id AS o_conv, u.turn AS o_turn, row_number() OVER (PARTITION BY q.conv_id, q.turn, q.place ORDER BY u.conv_id, u.turn) AS n FROM q JOIN un u ON u.unit = q.quote AND u.conv_id <> q.conv_id) WHERE n = 1),
li2 AS (SELECT q.conv_id, q.turn, q.place, q.level, n.o_turn IS NOT NULL AS is_near, CASE WHEN n.o_turn IS NOT NULL THEN q.conv_id ELSE f.o_conv END AS o_conv, coalesce(n.o_turn, f.o_turn) AS o_turn
  FROM q LEFT JOIN near n USING (conv_id, turn, place) LEFT JOIN far f USING (conv_id, turn, place) WHERE n.o_turn IS NOT NULL OR f.o_conv IS NOT NULL),
best AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(struct_pack(c := o_conv, t := o_turn, near := is_near), (NOT is_near)::INT * 1000000000 + level * 1000000 + place) AS t FROM li2 GROUP BY conv_id, turn),
paths AS (SELECT ow.conv_id, ow.turn, [ow.turn] AS path FROM ow LEFT JOIN best b USING (conv_id, turn) WHERE NOT coalesce(b.t.near, FALSE)
  UNION ALL SELECT p.conv_id, b.turn, list_append(p.path, b.turn) FROM paths p JOIN best b ON b.t.near AND b.conv_id = p.conv_id AND b.t.t = p.turn)
SELECT ow.conv_id, ow.turn, ow.role, row_number() OVER (PARTITION BY ow.conv_id ORDER BY p.path) - 1 AS position, b.t.c AS reply_conv, b.t.t AS reply_turn,
  (SELECT count(*) FROM q WHERE q.conv_id = ow.conv_id AND q.turn = ow.turn) AS n_quotes, coalesce(b.n_linked, 0) AS n_linked, sha256(own) AS text_sha256
FROM ow JOIN paths p USING (conv_id, turn) LEFT JOIN best b USING (conv_id, turn)"""
