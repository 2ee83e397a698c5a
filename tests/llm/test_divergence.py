import random
import re
from collections import Counter, defaultdict

from weirloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top=divergence.TOP):
    """The contract, term by term and pair by pair."""
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        own = [x for x in docs if x[1] == lang]
        within, total, counts = Counter(), Counter(), defaultdict(Counter)
        for terms, _, source in own:
            within.update(set(terms))
            total.update(terms)
            counts[source].update(terms)
        kept = [t for t, n in within.items() if n >= min_docs]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in counts.items()}
        for s in p:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), "pair", o) for o in p if o != s]
            above = [(q[t] - p[s][t], t.encode(), "term", t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part in (sorted(far), sorted(above)[:top]):
                out += [(lang, s, kind, item, -v, i + 1) for i, (v, _, kind, item) in enumerate(part)]
    return sorted(out)


def got(spark, rows, min_docs, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(df, min_docs=min_docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["alpha", "Beta", "beta", "été", "ÉTÉ", "x", "naïve", "日本", "o'clock", "a1b", " ", "zz_top"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 5, 40]), weights=range(1, len(words) + 1))) for _ in range(n)]
    return [(i, r.choice([None, t, t, t, t]), r.choice(["en", "en", "en", "fr", None, ""]), r.choice(["hot", "hot", "hot", "a", "b", "é", "Z", None])) for i, t in enumerate(texts)]


def test_equals_the_plain_sums(spark):
    for seed, least in ((1, 1), (2, 8), (3, 40)):
        rows = rows_of(seed, 120)
        assert got(spark, rows, least) == plain(rows, least)


def test_no_kept_terms_and_groups_without_terms(spark):
    rows = [(1, "one two", "en", "a"), (2, "", "en", "b"), (3, None, None, None), (4, "12 34", "en", "c")]
    assert got(spark, rows, 5) == plain(rows, 5)
    assert [r[4] for r in got(spark, rows, 5)] == [0] * 6
    assert got(spark, rows, 1) == plain(rows, 1)


def test_ranked_terms_ties_and_top(spark):
    rows = [(i, f"t{chr(97 + i % 7)} common", "en", "a" if i % 7 < 5 else "b") for i in range(70)]
    rows = rows + rows  # repeated rows are documents
    assert got(spark, rows, 3, top=2) == plain(rows, 3, 2)


def test_long_text_in_pieces(spark, monkeypatch):
    long = " ".join(f"w{'abcdefghij'[i % 10]}é" for i in range(400_000))  # over a piece, terms across its end
    rows = [(1, long, "en", "a"), (2, "wa other", "en", "b"), (3, "x" * 3_000_000, "en", "b")]
    assert got(spark, rows, 1) == plain(rows, 1)


def test_counts_beyond_64_bits(spark):
    n = spark.sql("SELECT CAST(900000000000000 AS long) AS n, CAST(1000000000000000 AS long) AS t, CAST(7 AS long) AS k")
    import pyspark.sql.functions as F

    assert n.select(divergence._share(F.col("n"), F.col("t"), F.col("k")).alias("p")).first()["p"] == 1 + 10**9 * (900000000000000 + 5) // (1000000000000000 + 35)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(4, 40), SCHEMA)
    assert divergence.audit(df.limit(0)).count() == 0
    odd = df.selectExpr("*", "1 AS value", "2 AS item", "3 AS term", "4 AS n", "5 AS zero", "6 AS rank")
    assert sorted(map(tuple, divergence.audit(odd, min_docs=2).collect())) == sorted(map(tuple, divergence.audit(df, min_docs=2).collect()))


def test_common_terms_send_no_pair_of_zeros(spark):
    """Sources with equal shares differ in nothing, though every pair starts above or at zero."""
    rows = [(i, "same words here", "en", f"s{i % 6}") for i in range(60)]
    assert all(r[4] == 0 for r in got(spark, rows, 5)) and len(got(spark, rows, 5)) == 30
