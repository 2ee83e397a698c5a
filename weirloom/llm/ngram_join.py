"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

Two documents link when 100 * |A and B| >= 80 * |A or B| over their distinct 5-word
shingles. Steps:

1. Documents of equal sets (by a 128-bit fingerprint) become one class.
2. Shingles are ordered by how many classes have them, rarest first (key_counts). A set's
   prefix is its first n - ceil(0.8 n) + 1 shingles: two sets that link share a shingle of
   both prefixes. Those no other class has cannot be shared and are left out.
3. Classes of equal prefix and size form a group; a group's prefix is posted once.
4. Per posting list and size band, a group is paired with the list's most central group of the
   band (that with the fewest prefix shingles of its own), and that with the next band's: as many pairs as postings. Pairs pass
   the size filter and the positional filter (shingles left in both sets must suffice),
   are expanded to members and verified on whole sets. Verified links give components.
5. Lists that still hold several components yield every pair between different components
   that passes the filters and was not verified yet. Pairs inside a component need no look:
   they are connected already. So no link is lost, and a large group of near copies costs
   pairs in proportion to its size.

Set sizes are exact counts of 64-bit shingle fingerprints; verification compares the leading
40 bits within two sets (a false match has a probability near |A||B| / 2^40).

Defined results: null and empty texts and texts without words have an empty set and link to
nothing; fewer than five words are one shingle; repeated rows are equal sets and link; a null
key gets a null component and its row takes part otherwise; an empty table gives an empty
one. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.llm import key_counts
from weirloom.llm.common import _mix, durable, shingles, slices
from weirloom.llm.components import components

SIZE = 5
PERCENT = 80
#: Parts over which the rows of one class are dealt when results go back to documents.
SALTS = 16
#: Width of a size band: sets of one band always pass the size filter.
BAND = 1.2


def _fingerprints(rows: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 128-bit set fingerprint as (n, 2) uint64)."""
    count = np.bincount(rows, minlength=n)
    at = np.cumsum(count) - count
    out = np.zeros((n, 2), np.uint64)
    full = count > 0
    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(prints):
            out[full, i] = np.add.reduceat(_mix(prints ^ np.uint64(salt)), at[full])
    return count, out


def _binary16(values: np.ndarray) -> pa.Array:
    n = len(values)
    return pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, cid): the size and the fingerprint of each document's set; with row, a long column of docs, that too."""
    more = [row] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                count, prints = _fingerprints(*shingles(data, offsets, SIZE), len(offsets) - 1)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(count.astype(np.int64)), _binary16(prints), *(part.column(c) for c in more)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "cid", *more])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(run, "doc_id long, n_shingles long, cid binary" + "".join(f", {c} long" for c in more))


def _of_batch(own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of a whole batch, slice by slice, without sets that an earlier row has; sizes and fingerprints of the rows."""
    rows, prints, counts, cids, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)], 0
    for batch in own.to_batches():
        for part, data, offsets in slices(batch):
            r, p = shingles(data, offsets, SIZE)
            count, cid = _fingerprints(r, p, part.num_rows)
            rows.append(r + base)
            prints.append(p)
            counts.append(count)
            cids.append(cid)
            base += part.num_rows
    count, cid = np.concatenate(counts), np.concatenate(cids)
    _, first = np.unique(cid, axis=0, return_index=True) if base else (None, np.zeros(0, np.int64))
    own_rows = np.concatenate(rows)
    new = np.zeros(base, bool)
    new[first] = True
    keep = new[own_rows] if base else np.zeros(0, bool)
    return own_rows[keep], np.concatenate(prints)[keep], np.where(new, count, 0), cid


def _needed(n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * n // 100)


def postings(docs: DataFrame, n_batches: int) -> DataFrame:
    """(cid, n, prefix, tokens, alone, places, bag) for the sets of docs (doc_id, text) that share a shingle of their prefix; a set may come once for each batch."""
    bits = key_counts.range_bits(n_batches)
    dealt = key_counts.deal(docs, "doc_id", n_batches)
    levels = key_counts.answers(dealt, lambda own: _of_batch(own)[1], n_batches)

    def post(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows, prints, count, cids = _of_batch(own)
        level = key_counts.levels_of(prints, answers, bits)
        order = np.lexsort((prints, level, rows))
        starts = np.cumsum(count) - count
        place = np.arange(len(rows)) - starts[rows]
        prefix = place < (count - _needed(count) + 1)[rows]  # rows are sorted, so places are those of the order too
        sorted_prints, sorted_level = prints[order], level[order]
        shared = prefix & (sorted_level > 0)
        has = np.flatnonzero(np.bincount(rows[shared], minlength=own.num_rows))
        heads, ends = np.searchsorted(rows[shared], has), np.searchsorted(rows[shared], has, "right")
        tokens, places = sorted_prints[shared].view(np.int64), place[shared].astype(np.int32)
        bags = np.ascontiguousarray((prints >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        full, sums = count > 0, np.zeros(own.num_rows, np.uint64)
        if len(prints):
            sums[full] = np.add.reduceat(np.where(prefix, _mix(sorted_prints), np.uint64(0)), starts[full])
        return pa.table(
            {
                "cid": _binary16(cids[has]),
                "n": pa.array(count[has].astype(np.int64)),
                "prefix": pa.array(sums[has].view(np.int64)),
                "tokens": pa.array([tokens[a:b] for a, b in zip(heads, ends, strict=True)], pa.list_(pa.int64())),
                "alone": pa.array((np.bincount(rows[prefix], minlength=own.num_rows)[has] - (ends - heads)).astype(np.int32)),
                "places": pa.array([places[a:b] for a, b in zip(heads, ends, strict=True)], pa.list_(pa.int32())),
                "bag": pa.array([bags[s : s + c].tobytes() for s, c in zip(starts[has], count[has], strict=True)], pa.binary()),
            }
        )

    return dealt.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(post, "cid binary, n long, prefix long, tokens array<long>, alone int, places array<int>, bag binary")


def _fits(a: str, b: str) -> F.Column:
    """Size filter and positional filter of two postings."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.place", f"{b}.place"))
    size = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    left = F.least(na - pa_, nb - pb)
    return size & (left * (100 + PERCENT) >= PERCENT * (na + nb))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values(bag: bytes) -> np.ndarray:
            wide = np.zeros((len(bag) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(bag, np.uint8).reshape(-1, 5)
            return wide.view(np.uint64).reshape(-1)

        for batch in batches:
            keep, last, have = [], None, np.zeros(0, np.uint64)
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if x is not last:
                    last, have = x, values(x)
                both = len(np.intersect1d(have, values(y), assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(have) + len(y) // 5 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = bags.select(F.col("cid").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("cid").alias("b"), F.col("bag").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame) -> DataFrame:
    """Components (node, root) of the sets of docs (doc_id, text); nodes are set fingerprints."""
    posted = durable(postings(docs, key_counts.batches(docs)).dropDuplicates(["cid"]), "postings")
    bags = posted.select("cid", "bag")
    members = posted.select("n", "prefix", "cid")
    groups = posted.groupBy("n", "prefix").agg(F.first(F.struct("tokens", "places", "alone")).alias("t"), F.min("cid").alias("head"))
    lists = groups.select("head", "n", F.col("t.alone").alias("alone"), F.explode(F.arrays_zip("t.tokens", "t.places")).alias("z")).select(F.col("z.tokens").alias("token"), "alone", "head", "n", F.col("z.places").alias("place"))
    # 4. linear pairs
    band = F.floor(F.log("n") / F.log(F.lit(BAND)))
    whole = Window.partitionBy("token", "band")
    me = F.struct("alone", "head", "n", "place")
    banded = lists.withColumn("band", band)
    first = banded.withColumn("c", F.min(me).over(whole)).where(F.col("c.head") != F.col("head")).select(me.alias("p"), F.col("c").alias("q"))
    centres = banded.groupBy("token", "band").agg(F.min(me).alias("c"))
    steps = centres.alias("l").join(centres.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.band") + 1 == F.col("r.band"))).select(F.col("l.c").alias("p"), F.col("r.c").alias("q"))
    pairs = first.union(steps).where(_fits("p", "q")).select(F.least("p.head", "q.head").alias("a"), F.greatest("p.head", "q.head").alias("b"))
    # members of a group share their prefix: each is paired with the group's head
    inside = members.join(groups.select("n", "prefix", "head"), ["n", "prefix"]).where("cid <> head").select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b"))
    pairs = durable(pairs.union(inside).distinct(), "pairs")
    near = durable(_verified(pairs, bags), "links")
    roots = components(near)
    # 5. pairs between components that share a list
    own = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("n", "prefix", "cid", F.coalesce("root", "cid").alias("root"))
    every = posted.select("n", "prefix", "cid", F.explode(F.arrays_zip("tokens", "places")).alias("z")).select("n", "prefix", "cid", F.col("z.tokens").alias("token"), F.col("z.places").alias("place"))
    every = every.join(own, ["n", "prefix", "cid"]).select("token", "cid", "root", "n", "place").distinct()
    mixed = every.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    open_ = durable(every.join(mixed, "token", "left_semi"), "open")
    l, r = open_.alias("l"), open_.alias("r")
    across = l.join(r, F.col("l.token") == F.col("r.token")).where((F.col("l.cid") < F.col("r.cid")) & (F.col("l.root") != F.col("r.root")) & _fits("l", "r"))
    across = across.select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    far = durable(_verified(across, bags), "links")
    if not far.limit(1).count():
        return roots
    return components(near.union(far))


def _components(docs: DataFrame, key: str, text: str, row: str | None = None) -> DataFrame:
    """The rows of sets() with root, the fingerprint that names a group of two rows or more, and its smallest doc_id as component_id; both null for rows that link to nothing."""
    every = durable(sets(docs, key, text, row), "sets")
    classes = every.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    roots = links(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    linked = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("held").alias("held")).where("held > 1")
    known = linked.select("cid", "root").join(least, "root").select("cid", "root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(known, ["cid", "salt"], "left")


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of docs."""
    out = _components(docs, key, text)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def linked_rows(docs: DataFrame, row: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, first) of the rows that link to another, by a fingerprint of the row: whether it is its group's row of the smallest key (null the last), then fingerprint."""
    linked = durable(_components(docs, key, text, row).where("root IS NOT NULL").select("root", "doc_id", row), "linked")
    firsts = linked.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("null"), "doc_id", row)).alias("one")).select(F.col(f"one.{row}").alias(row)).distinct()
    return linked.select(row).distinct().join(firsts.withColumn("first", F.lit(True)), row, "left").select(row, F.coalesce("first", F.lit(False)).alias("first"))


def oracle(size: int = SIZE, percent: int = PERCENT) -> str:
    """DuckDB SQL: counts of common shingles for every pair that has one, and reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(ws[i:i + {size} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c_both >= {percent} * (x.n + y.n - c_both)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id"""
