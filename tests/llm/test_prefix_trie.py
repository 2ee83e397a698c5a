import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from weirloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def key_of(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def listed(rows):
    """Turns of each conversation as (role, text), in the stated order."""
    out = defaultdict(list)
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, key_of(x[2], x[3]))):
        out[c].append((r or "", x or ""))
    return {c: tuple(v) for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), ())[:h] + own[h:]
    return out


def plain(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), sum(not children[x] for x in below), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n, turns=("hi", "Hello there", "what is  it", "", None, "ok\tthen\n")):
    r = random.Random(seed)
    out = []
    for c in range(n):
        depth = r.choice([1, 1, 2, 3, 5, 9])
        out += [(c, t, r.choice(["user", "user", None]), "same again" if c % 3 == 0 and t < 4 else r.choice(turns)) for t in range(depth)]
    r.shuffle(out)
    return out


def trie(spark, rows, partitions=None):
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.arrays(spark.createDataFrame(rows, SCHEMA)), partitions).select(*prefix_trie.RESULT).collect()), key=str)


@pytest.mark.parametrize(("seed", "n", "partitions"), [(1, 60, 1), (2, 60, 7), (3, 90, 40)])
def test_equals_plain_prefixes_however_it_is_cut(spark, seed, n, partitions):
    rows = rows_of(seed, n)
    assert trie(spark, rows, partitions) == plain(listed(rows))


def test_copies_over_many_partitions(spark, monkeypatch):
    """One conversation's copies fill several partitions; their ids are hashed in order across them."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6 if c % 10 else 7)] + [(c, 0, "user", "alone") for c in range(1000, 1020)]
    got = trie(spark, rows, 16)
    assert got == plain(listed(rows))
    assert max(r[3] for r in got if r[1] == 6) == 300


def test_rebuilt_conversations(spark):
    rows = [x for x in rows_of(5, 90) if x[0] not in (40, 60, 80)] + [(-c, 0, "user", "below zero") for c in range(1, 45)]
    convs = prefix_trie.rebuilt(prefix_trie.arrays(spark.createDataFrame(rows, SCHEMA)))
    assert {r["conv_id"]: len(r["turns"]) for r in convs.collect()} == {c: len(t) for c, t in rebuilt(listed(rows)).items()}
    got = sorted((tuple(r) for r in prefix_trie.trie(convs, 9).select(*prefix_trie.RESULT).collect()), key=str)
    assert got == plain(rebuilt(listed(rows)))
    assert any(not t for t in rebuilt(listed(rows)).values())  # some have no turns


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "b", "tie"), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (None, 1, "x", "y"), (2, None, "user", "first")]
    rows += [(3, t, "user", f"long {t % 3}") for t in range(1500)] + [(4, t, "user", f"long {t % 3}") for t in range(1400)] + [(5, 0, "us", "er:x"), (6, 0, "user", ":x"), (7, 0, "", "x " * 200_000)]
    got = trie(spark, rows, 3)
    want = listed(rows)
    assert len(got) == len({t[:d] for t in want.values() for d in range(len(t) + 1)})
    small = {c: t for c, t in want.items() if c not in (3, 4)}
    assert [r for r in got if r[0] not in (3, 4) and r[1] > 0] == [r for r in plain(small) if r[1] > 0]
    deep = {r[1]: r for r in got if r[0] == 3}
    assert deep[1400][3:6] == (2, 1, 1) and deep[1400][6] == 2 and deep[1][6] == 2 * 1400 and deep[1500][3] == 1


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(8, 20), SCHEMA)
    assert prefix_trie.trie(prefix_trie.arrays(df.limit(0))).count() == 0
    odd = df.selectExpr("*", "1 AS depth", "2 AS words", "3 AS key", "4 AS turns", "5 AS string")
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.arrays(odd), 3).collect()), key=str) == sorted(map(tuple, prefix_trie.trie(prefix_trie.arrays(df), 2).collect()), key=str)
