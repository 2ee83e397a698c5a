"""Conversation prefix trie: the prompts that conversations share, as nodes of a trie over turns.

A node is a distinct sequence of first d turns (role, text); its members are the conversations
that start with it. A cache of prompts keeps each node once: a node of n members saves n - 1
times its last turn's words.

1. A turn becomes a key, 128 bits of SHA-256 over role and text, and its number of words; texts
   go no further. A conversation is the concatenation of its turns' keys, so the order of these
   byte strings is the order of turn arrays, with prefixes first.
2. The strings are range-sorted over the cluster, by conversation id among equal ones, so copies
   of one conversation fill as many partitions as they need.
3. A partition is swept once with a stack of open nodes. The longest common prefix of adjacent
   strings tells which nodes end between them: those are whole and are written out, their
   totals added to the parent's. A node waits for its parent's end, since a later sibling may
   hold the parent's smallest member.
4. Nodes on the path of a partition's first or last string may go on next door. They leave as
   fragments, with what ended inside them, and are added up by the chained hash of their path.
   In order of (first partition, side, depth) the sums form a preorder of the open nodes, which
   is swept by the same stack; it holds twice the depth of a conversation for each partition,
   not a row for each conversation.
5. Nodes that ended below an open one get the open node's smallest member by a join on
   (partition, side, depth), so that no node, not even the root, is one join key.
6. Ids that end at a node are hashed in order as they pass. Where a run of them touches an end
   of its partition, its ids go on as pieces of PIECE ids, which one last pass hashes in order.

Memory of a task: the nodes of its partition, some TURNS turns, at most.

Defined results: null role and text are empty; turns are ordered by number, null first, and
turns of one number by the key, so rows may come in any order; repeated rows are repeated
turns; rows without conv_id belong to no conversation and are left out; a conversation without
turns ends at the root; without conversations there is no root, so an empty table gives an
empty one; other columns are not read, so extra ones may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.llm.common import durable

KEY = 16
#: Turns of a partition, ids of a piece, and rows written at once.
TURNS, PIECE, ROWS = 200_000, 4096, 4096
NOTHING = hashlib.sha256(b"").hexdigest()

SWEPT = "kind int, part int, side int, depth int, conv_id long, parent long, n long, children long, leaves long, saved long, words long, ends string, path binary, seq long"
NAMES = [c.split()[0] for c in SWEPT.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
KINDS = [_TYPES[c.split()[1]] for c in SWEPT.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Kinds of rows: a whole node below a whole one, a whole node below an open one, a fragment of an open node, a piece of ids.
WHOLE, BELOW, FRAGMENT, IDS = range(4)


def turn_key(role: Column, text: Column) -> Column:
    """The turn's key in hexadecimal: role and text cannot run into each other, as the role's length comes first."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def arrays(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): an array of the keys and word counts of each conversation's turns, in order."""
    words = F.regexp_count(F.coalesce(turns[text], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(turns[conv_id].isNotNull()).select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"), turn_key(turns[role], turns[text]).alias("key"), words.alias("words"))
    # the flag comes first, so null turns do
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "words")))
    return rows.groupBy("conv_id").agg(F.transform(listed, lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, among: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % among; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % among).withColumn("h", h).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), own).alias("turns"))


class _Node:
    """An open node of the stack; edge: on the path of the partition's first string."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "words", "ends", "edge", "wait")

    def __init__(self, words: int, edge: bool = False, ends: str | None = None):
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.words, self.edge, self.ends, self.wait = words, edge, ends, []

    def meet(self, n: int, least: int) -> None:
        self.n, self.least = self.n + n, least if self.least is None else min(self.least, least)

    def row(self, depth: int) -> tuple:
        """depth, smallest member, members, children, leaves, saved, words, hash of the ids: all below it has ended."""
        return depth, self.least, self.n, self.children, self.leaves or 1, self.saved + (self.n - 1) * self.words, self.words, self.ends or NOTHING

    def end(self, up: _Node) -> None:
        """Adds what the node and its subtree are to its parent."""
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + (self.leaves or 1), up.saved + self.saved + (self.n - 1) * self.words


def _common(a: bytes, b: bytes) -> int:
    """How many whole keys two strings begin with alike."""
    if a == b:
        return len(a) // KEY
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def _paths(string: bytes) -> list[bytes]:
    """Chained hashes of the string's prefixes, the root's first."""
    out = [b""]
    for at in range(0, len(string), KEY):
        out.append(hashlib.sha256(out[-1] + string[at : at + KEY]).digest()[:KEY])
    return out


def _sweep(rows: Iterator[tuple[int, bytes, list[int]]], part: int) -> Iterator[tuple]:
    """Rows (SWEPT) for one partition's sorted conversations (id, string of keys, words of its turns)."""
    stack, paths, first, last, run = [_Node(0, edge=True)], [], None, None, []

    def pieces(path: bytes) -> Iterator[tuple]:
        for seq in range(0, len(run), PIECE):
            yield (IDS, part, None, None, None, None, None, None, None, None, None, ",".join(map(str, run[seq : seq + PIECE])), path, seq)

    def below(row: tuple, side: int) -> tuple:
        return (BELOW, part, side, row[0], row[1], None, *row[2:], None, None)

    def close(depth: int) -> Iterator[tuple]:
        """Ends the nodes deeper than depth."""
        while len(stack) > depth + 1:
            node, up, at = stack.pop(), stack[-1], len(stack)
            up.meet(node.n, node.least)
            yield from ((WHOLE, None, None, x[0], x[1], node.least, *x[2:], None, None) for x in node.wait)
            if node.edge:
                yield (FRAGMENT, part, 0, at, node.least, None, node.n, node.children, node.leaves, node.saved, node.words, node.ends, paths[at], None)
                continue
            node.end(up)
            if up.edge:
                yield below(node.row(at), 0)
            else:
                up.wait.append(node.row(at))

    for conv, string, words in rows:
        if first is None:
            first, paths, common = string, _paths(string), 0
        elif string == last:
            common = len(string) // KEY
        else:
            if last == first:  # this run of ids may have begun in the partition before
                yield from pieces(paths[-1])
            else:
                stack[-1].ends = hashlib.sha256(",".join(map(str, run)).encode()).hexdigest()
            run, common = [], _common(last, string)
        yield from close(common)
        for depth in range(len(stack), len(string) // KEY + 1):
            stack.append(_Node(words[depth - 1], edge=last is None))
        stack[-1].meet(1, conv)
        run.append(conv)
        last = string
    if last is None:
        return
    ends = _paths(last)
    yield from pieces(ends[-1])
    while stack:  # the path of the last string
        node, at = stack.pop(), len(stack)
        side = 0 if node.edge else 1
        if stack:
            stack[-1].meet(node.n, node.least)
        yield from (below(x, side) for x in node.wait)
        yield (FRAGMENT, part, side, at, node.least, None, node.n, node.children, node.leaves, node.saved, node.words, node.ends, ends[at], None)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open nodes, in preorder, to rows of the result."""

    def nodes() -> Iterator[tuple]:
        stack: list[_Node] = []

        def close(depth: int) -> Iterator[tuple]:
            while len(stack) > depth:
                node = stack.pop()
                at, least, n, children, leaves, saved, _, ends = node.row(len(stack))
                if stack:
                    node.end(stack[-1])
                yield least, at, stack[-1].least if stack else None, n, children, leaves, saved, ends

        for batch in batches:
            for depth, least, n, children, leaves, saved, words, ends in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "n", "children", "leaves", "saved", "words", "ends")), strict=True):
                yield from close(depth)
                node = _Node(words, ends=ends)
                node.n, node.least, node.children, node.leaves, node.saved = n, least, children, leaves, saved
                stack.append(node)
        yield from close(0)

    yield from _batches(nodes(), RESULT, [pa.int64()] * 7 + [pa.string()])


def _hashed(pieces: DataFrame) -> DataFrame:
    """(path, hashed): SHA-256 of each path's pieces of ids, joined by commas in order. Pieces pass one by one; a hash has no other way than in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, digest = None, None
            for batch in batches:
                for at, ids in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                    if digest is not None and at == path:
                        digest.update(b"," + ids.encode())
                        continue
                    if digest is not None:
                        yield path, digest.hexdigest()
                    path, digest = at, hashlib.sha256(ids.encode())
            if digest is not None:
                yield path, digest.hexdigest()

        yield from _batches(rows(), ["path", "hashed"], [pa.binary(), pa.string()])

    return pieces.select("path", "part", "seq", "ends").repartition("path").sortWithinPartitions("path", "part", "seq").mapInArrow(run, "path binary, hashed string")


def trie(convs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The nodes of the trie over convs (conv_id, turns: array<struct<key, words>>), one row each: RESULT.

    conv_id is the node's smallest member and, with depth, names the node; n_leaves and saved_tokens are of its whole subtree.
    """
    rows = durable(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")).alias("string"), F.transform("turns", lambda x: x["words"]).alias("words")), "conversations")
    if partitions is None:
        total = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TURNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(batch.column("conv_id").to_pylist(), batch.column("string").to_pylist(), batch.column("words").to_pylist(), strict=True))
        yield from _batches(_sweep(given, TaskContext.get().partitionId()), NAMES, KINDS)

    swept = durable(rows.repartitionByRange(partitions, "string", "conv_id").sortWithinPartitions("string", "conv_id").mapInArrow(run, SWEPT), "nodes")
    fragments = swept.where(F.col("kind") == FRAGMENT)
    place = F.min(F.struct("part", "side", "depth")).alias("place")
    sums = fragments.groupBy("path").agg(place, F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.max("words").alias("words"), F.max("ends").alias("ends"))
    opened = sums.join(_hashed(swept.where(F.col("kind") == IDS)), "path", "left").select("path", "place.*", "conv_id", "n", "children", "leaves", "saved", "words", F.coalesce("ends", "hashed").alias("ends"))
    opened = durable(opened, "open")
    top = opened.repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(_open_nodes, ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT))
    parents = fragments.select("part", "side", "depth", "path").join(opened.select("path", F.col("conv_id").alias("above")), "path").select("part", "side", (F.col("depth") + 1).alias("depth"), "above")
    shown = lambda parent: [F.col("conv_id"), F.col("depth").cast("long").alias("depth"), F.col(parent).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]  # noqa: E731
    whole = swept.where(F.col("kind") == WHOLE).select(*shown("parent"))
    below = swept.where(F.col("kind") == BELOW).join(parents, ["part", "side", "depth"]).select(*shown("above"))
    return whole.unionByName(below).unionByName(top)


#: Bits of crc32, one by one, over the bytes of a decimal number.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"


def oracle(among: int = 20, most: int = 4) -> str:
    return rf"""WITH r AS (SELECT conv_id, turn, left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), {2 * KEY}) AS key, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'key': key, 'words': words}} ORDER BY turn NULLS FIRST, key) AS turns, {_CRC} % {most} AS h FROM r GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % {among}),
p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
m AS (SELECT conv_id, depth, coalesce(turns[depth]['words'], 0) AS words, list_aggregate(list_transform(turns[1:depth], lambda x: x['key']), 'string_agg', '') AS path, depth = len(turns) AS ends FROM p),
n AS (SELECT coalesce(path, '') AS path, depth, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM m GROUP BY ALL),
k AS (SELECT left(path, {2 * KEY} * (depth - 1)::INT) AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(k.children, 0) AS children FROM n LEFT JOIN k USING (path)),
s AS (SELECT left(path, {2 * KEY} * up::INT) AS path, sum((children = 0)::INT)::BIGINT AS leaves, sum((n - 1) * words)::BIGINT AS saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN n u ON w.depth > 0 AND u.path = left(w.path, {2 * KEY} * (w.depth - 1)::INT)"""
