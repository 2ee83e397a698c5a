import random

import pytest

from weirloom.llm import pieces as sp

TINY = [("<unk>", 0.0, "c"), ("<s>", 0.0, "c"), *((f"<0x{b:02X}>", 0.0, "b") for b in range(256)), *((p, s, "n") for p, s in [("▁", -3.0), ("▁▁", -2.5), ("a", -2.0), ("b", -2.0), ("ab", -3.5), ("ba", -3.0), ("aba", -4.5), ("▁a", -4.0), ("▁ab", -6.0), ("é", -2.0), ("bb", -4.0)])]


def brute(p, word, n):
    text = word.replace("▁", "￿").replace(" ", "▁")

    def walk(i):
        if i == len(text):
            yield 0.0
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            k = p.ids.get(text[i:j])
            if k is not None:
                single = single or j == i + 1
                for rest in walk(j):
                    yield p.scores[k] + rest
        if not single:
            for rest in walk(i + 1):
                yield p.unknown + rest

    return sorted(walk(0), reverse=True)[:n]


def test_nbest_against_all_segmentations():
    p, rng = sp.Pieces(TINY), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice(" ababbé▁x") for _ in range(rng.randint(0, 9)))
        for n in (1, 3, 8):
            found = p.nbest(word, n)
            assert [s for s, _ in found] == pytest.approx(brute(p, word, n))
            assert len({ids for _, ids in found}) == len(found)


def test_texts_combine_words():
    p, rng = sp.Pieces(TINY), random.Random(4)
    encoder = sp.Encoder(p, 4)
    for _ in range(60):
        text = "".join(rng.choice(" abab b\né▁x") for _ in range(rng.randint(1, 9)))
        (scores, ids), = encoder.encode([text])
        whole = p.nbest(" " + text, 4)  # over the undivided lattice
        assert scores == pytest.approx([s for s, _ in whole])
        assert p.decode(ids.tolist()) == text
        every = encoder.segmentations(text)
        assert [s for s, _ in every] == pytest.approx(scores) and every[0][1] == ids.tolist()
        assert all(p.decode(x) == text for _, x in every) and len({tuple(x) for _, x in every}) == len(every)


def test_long_and_odd_texts():
    p = sp.Pieces(TINY)
    encoder = sp.Encoder(p)
    for text in ("ab" * 20000, " " * 5000, "\n" * 3000, "▁" * 50, "😀\0￿" * 100, " a", "a ", "  "):
        (scores, ids), = encoder.encode([text])
        assert p.decode(ids.tolist()) == text and scores == sorted(scores, reverse=True)
    assert encoder.encode(["", None])[0][0] == [0.0] and encoder.encode([None])[0][0] == []


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "▁ x ▁▁\n\n "), (-3, "日本語 \U0001f600")], "doc_id long, text string")
    v = sp.broadcast(spark)
    out = sp.decode(sp.encode(docs.union(extra).withColumnRenamed("doc_id", "n_pieces_id"), v), v)
    rows = out.collect()
    assert len(rows) == docs.count() + 4
    assert all(r["decoded"] == r["text"] for r in rows)
    assert all(len(r["nbest_scores"]) == 4 for r in rows if r["text"] and len(r["text"]) > 20)
    assert sp.encode(docs.limit(0), v).count() == 0
    every = sp.encode(docs.union(extra).where("doc_id % 20 <= 0 OR doc_id IS NULL"), v, every=True).collect()
    for r in every:
        if r["text"] is not None:
            assert r["nbest_ids"][0] == r["ids"] and len(r["nbest_ids"]) == len(r["nbest_scores"]) and len(set(map(tuple, r["nbest_ids"]))) == len(r["nbest_ids"])
        else:
            assert r["nbest_ids"] is None


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError):
        sp.Pieces([*TINY, ("a▁b", -1.0, "n")])
