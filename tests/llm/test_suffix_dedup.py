import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from weirloom.llm import suffix_dedup
from weirloom.llm.common import buffer
from weirloom.llm.run_index import RunIndex


def brute(rows, length=100):
    """rows: (doc_id, text); the same results by a set of every string seen."""
    out, seen = [], set()
    done = {}
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0], hashlib.sha256((rows[i][1] or "").encode()).digest()))
    for i in order:
        doc, text = rows[i][0], (rows[i][1] or "").encode()
        if (doc, text) not in done:
            gone = bytearray(len(text))
            for s in range(len(text) - length + 1):
                w = text[s : s + length]
                if w in seen:
                    gone[s : s + length] = b"\1" * length
                seen.add(w)
            rest = bytes(c for c, g in zip(text, gone) if not g)
            spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
            done[doc, text] = (doc, len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest())
        out.append(done[doc, text])
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in suffix_dedup.dedup(docs, with_bytes=False).collect()), key=str)


def text_of(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.dedup(docs, with_bytes=False).collect()), key=str)
    assert got == brute(rows)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("block", [1 << 10, 64 << 10])
def test_hard_cases_match_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé\0ü") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    shared = [text_of(rng, 60, words) for _ in range(4)]
    rows = [(None, None), (None, shared[0]), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 450), (5, "ab" * 300), (5, "ab" * 300), (5, shared[0]), (900, shared[0])]
    for i in range(60):
        parts = [text_of(rng, rng.randint(0, 40), words)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 80)
            parts += [s[a : a + rng.randint(60, 400)], text_of(rng, rng.randint(0, 5), words)]
        rows.append((100 + i, "".join(parts)))
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_index_against_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc\0") for _ in range(rng.randint(1, 30))).encode() for _ in range(40)]
    index = RunIndex(*buffer(pa.array(texts, pa.binary())), depth=20)
    patterns = ["".join(rng.choice("abcd\0") for _ in range(rng.randint(0, 25))).encode() for _ in range(50)] + texts[:5]
    data, offsets = buffer(pa.array(patterns, pa.binary()))
    got = index.matching_statistics(data, offsets)
    for p, a in zip(patterns, offsets):
        for i in range(len(p)):
            n = max(n for n in range(len(p) - i + 1) if any(p[i : i + n] in t for t in texts))
            assert got[a + i] == n, (p, i)
    repeated = [b"abracadabra" * 3] * 20
    small = RunIndex(*buffer(pa.array(repeated, pa.binary())), depth=40)
    assert small.runs < small.rows / 5


def test_window_least():
    values = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    got = suffix_dedup._window_least(values, 7)
    assert got.tolist() == [min(values[i : i + 7]) for i in range(494)]
