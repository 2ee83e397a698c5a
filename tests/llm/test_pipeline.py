import re

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute as components
from weirloom.llm import mixing
from weirloom.llm.common import durable, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = before = table(spark, SF, "documents")
    kept = []
    for name, stage in cp.STAGES:
        docs = durable(stage(spark, docs, SF), "test")
        kept.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
    quality, near, private, mixed, last = kept
    good = {r["doc_id"] for r in quality.collect()}
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    # quality: low quality goes, nearly all clean documents of some length stay
    long = {r["doc_id"] for r in before.collect() if len(r["text"].split()) >= 40}
    assert sum(d in good for d, r in labels.items() if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in labels.values())
    clean = [d for d, r in labels.items() if r["quality"] == 1 and d in long]
    assert sum(d in good for d in clean) > 0.95 * len(clean)
    # near copies: exactly the smallest of each component, by brute force
    rows = [(r["doc_id"], r["text"]) for r in quality.collect()]
    assert {r["doc_id"] for r in near.collect()} == {d for d, _, c in components(rows) if d == c}
    # personal data: none left, all else unchanged
    for r in private.collect():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+1 \(\d{3}\) 555-\d{4}|token = \"[0-9a-f]{40}", r["text"])
        assert r["n_chars"] == len(r["text"])
    assert private.count() == near.count()
    # mixing: expected tokens of the mixed table meet the stated shares, toxic documents go, clean ones stay
    members = mixing.mix(private, table(spark, SF, "labels"), train=before.select("doc_id", "text"), weights=cp.WEIGHTS).toPandas()
    assert {r["doc_id"] for r in mixed.collect()} == set(members["doc_id"][members["copies"] > 0]) and mixed.count() == members["copies"].sum()
    total = members["n_tokens"].sum()
    for d, share in zip(mixing.DOMAINS, cp.WEIGHTS):
        assert abs((members["rate"] * members["n_tokens"] * members[f"p_{d}"]).sum() / total - share) < 0.01
        assert abs((members["copies"] * members["n_tokens"] * members[f"p_{d}"]).sum() / total - share) < 0.05  # copies are whole, and documents few
    left = {r["doc_id"] for r in mixed.collect()}
    there = {r["doc_id"] for r in private.collect()}
    toxic = [d for d in there if d in labels and labels[d]["toxic"] == 1]
    fine = [d for d in there if d in labels and labels[d]["toxic"] == 0 and labels[d]["quality"] == 1]
    assert sum(d in left for d in toxic) <= 0.1 * len(toxic)
    # 51 toxic documents teach too little to tell some clean ones apart (on sf0.1 all stay, see the README)
    assert sum(d in left for d in fine) >= 0.85 * len(fine)
    # pieces: a row for each copy
    assert last.count() == mixed.count()
    assert cp.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[n : n + 20])
    rows = [(3, text(0)), (5, text(20)), (5, text(0)), (5, text(40)), (7, "x" + text(20)[1:]), (None, text(0)), (None, "no copy of any other row here"), (8, ""), (8, ""), (9, text(0)), (9, text(0)), (2, "same in all"), (2, "same in all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.near_copies(spark, docs, SF).collect())
    want = [(2, "same in all"), (3, text(0)), (5, text(20)), (5, text(40)), (8, ""), (8, ""), (None, "no copy of any other row here")]
    assert got == sorted((str(i), t) for i, t in want)
