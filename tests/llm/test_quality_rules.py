import re

import numpy as np
import pyarrow as pa

from weirloom.llm import quality_rules as q
from weirloom.llm.common import buffer


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


HARD = [
    None, "", " \n\t", "a", "a\na\na \n a", "x y z w v u t s " * 5, "a b c d e f g h a b c d e f g h i", "é ü ñ\u00a0x\u2003y", "#*$%&|<> ##", "\n\n\na\n\na", "a\r\na\r\na", "one two three four five six seven eight nine ten " * 3 + "end",
    "\x0b\x0c\x1c\x85 a", "😀 " * 30, "same line here\nsame line here\nother\nsame line here",
]


def test_counts_of_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in q.judge(docs, None).collect()}
    for i, text in enumerate(HARD):
        want = brute(text)
        assert tuple(got[i][c] for c in q.COUNTS) == want, text
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed)


def test_counts_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = q.judge(docs, q.fit(docs, labels)).collect()
    assert len(out) == 1000
    for r in out:
        assert tuple(r[c] for c in q.COUNTS) == brute(r["text"])
        assert not (r["base_failed"] and r["kept"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rest = [r for r in out if r["doc_id"] in truth and not r["base_failed"]]
    bad, good = [r for r in rest if truth[r["doc_id"]] == 0], [r for r in rest if truth[r["doc_id"]] == 1]
    assert sum(r["kept"] for r in good) > 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = q.fit(docs.where("doc_id % 2 = 0"), labels)
    rows = q.judge(docs.where("doc_id % 2 = 1"), forest).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.97 * len(good) and sum(not r["kept"] for r in bad) > 0.9 * len(bad)


def test_path_lengths():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    forest = q.Forest.grow(rows)
    score = forest.score(np.abs(rows))
    assert score.argmax() == 500 and score.max() > 0.6
    one = q.Forest.grow(rows[:1])
    assert (one.score(rows) <= 1).all()


def test_clashes_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, 1, "s"), (1, "a b", 2, "t"), (1, "a b", 2, "t")], "doc_id long, text string, Kept int, q_row string")
    out = q.judge(docs, None)
    assert out.count() == 3 and "q_row" in out.columns
    labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    assert q.fit(docs, labels) is None
    assert q.judge(docs.limit(0), None).count() == 0


def test_slices_do_not_matter():
    texts = [t or "" for t in HARD]
    whole, _ = q.statistics(*buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        alone, _ = q.statistics(*buffer(pa.array([t])))
        assert all(alone[c][0] == whole[c][i] for c in q.COUNTS)
