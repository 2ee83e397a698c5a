import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weirloom.llm import common, key_counts
from weirloom.llm.components import components

TEXT = st.text(alphabet=" \t\nabAB\x0b\x0c\réü😀\0,.", max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = common.buffer(pa.array(texts, pa.string()))
    start, end, row = common.words(data, offsets)
    raw = data.tobytes()
    got = [(r, raw[a:b].decode()) for a, b, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_shingles_are_distinct_runs_of_five_words(texts):
    data, offsets = common.buffer(pa.array(texts, pa.string()))
    rows, prints = common.shingles(data, offsets)
    sizes = np.bincount(rows, minlength=len(texts)).tolist() if texts else []
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert sizes == want


def test_slices_keep_rows_and_nulls():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["ab", None, "", "x" * 100, "é"])], ["k", "text"])
    parts = list(common.slices(batch, most=3))
    assert [k for p, _, _ in parts for k in p.column("k").to_pylist()] == [0, 1, 2, 3, 4]
    assert b"".join(d.tobytes() for _, d, _ in parts) == ("ab" + "x" * 100 + "é").encode()


def test_prints_depend_on_content_only():
    data = np.frombuffer(b"abcabcxabd", np.uint8)
    p = common.Prints(data)
    a = p.of(np.array([0, 3, 7]), np.array([3, 6, 10]))
    assert a[0] == a[1] != a[2]
    assert (p.rolling(3)[[0, 3]] == p.rolling(3)[0]).all()


def test_components_against_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_levels_count_documents(spark):
    docs = spark.createDataFrame([(i, " ".join(["all", f"one{i}"] + (["pair"] if i < 2 else []) + (["five"] if i < 5 else []))) for i in range(40)], "doc_id long, text string")
    n = 6

    def prints_of(own):
        data, offsets = common.buffer(own.combine_chunks().column("text"))
        start, end, _ = common.words(data, offsets)
        return common.Prints(data).of(start, end)

    dealt = key_counts.deal(docs, "doc_id", n)
    answers = key_counts.answers(dealt, prints_of, n)

    def read(own, got):
        data, offsets = common.buffer(own.combine_chunks().column("text"))
        start, end, _ = common.words(data, offsets)
        level = key_counts.levels_of(prints_of(own), got, key_counts.range_bits(n))
        return pa.table({"word": [data.tobytes()[a:b].decode() for a, b in zip(start, end)], "level": pa.array(level.astype(np.int32))})

    rows = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(read, "word string, level int").distinct().collect()
    levels = {r["word"]: r["level"] for r in rows}
    assert levels["all"] == 6 and levels["pair"] == 1 and levels["five"] == 3 and all(levels[f"one{i}"] == 0 for i in range(40))
