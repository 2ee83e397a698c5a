"""Substring, pattern and full-text search against plain loops."""

import random
import re

import pytest

from weirloom.operators import graph, patterns, postings, trigrams

ALPHABET = ["a", "b", "ab", "é", "日", " ", "  ", "\n", "x", "%", "_", "😀"]


def texts_of(seed, n, most=40):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, most))) for _ in range(n)]


def test_trigrams_equal_contains(spark):
    docs = [(i, t) for i, t in enumerate(texts_of(1, 150))] + [(900, None), (901, ""), (902, "zq" * 700_000 + "needle at the end"), (903, "ab" * 300)]
    needles = [(i, t) for i, t in enumerate([*texts_of(2, 60, 4), "a", "ab", "é", "日", "😀", "needle at the end", "qqz", "zq", "", None, "ab" * 100, "not there at all"])]
    got = trigrams.containing(spark.createDataFrame(needles, "item_id long, needle string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len({(r["item_id"], r["doc_id"]) for r in got})
    assert {(r["item_id"], r["doc_id"]) for r in got} == {(i, d) for i, n in needles for d, t in docs if n and t and n in t}


def test_trigram_candidates_are_few_and_lists_of_no_use_are_not_made(spark):
    docs = spark.createDataFrame([(i, f"common words and number {i:05d}") for i in range(500)], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "common words and number 00077"), (2, "words missing"), (3, "common")], "item_id long, needle string")
    got = [tuple(r) for r in trigrams.candidates(needles, docs).collect()]
    assert sum(i == 1 for i, _ in got) < 30 and not any(i == 2 for i, _ in got) and sum(i == 3 for i, _ in got) == 500


def test_no_nested_loops(spark):
    docs, needles = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, needle string")
    plans = [trigrams.containing(needles, docs), graph.entity_matches(spark.createDataFrame([(1, "abc")], "query_id long, entity string"), spark.createDataFrame([("b",)], "name string"))]
    for df in plans:
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_patterns_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", block)
    found = [(i % 50, p) for i, p in enumerate([*texts_of(3, 60, 5), "a", "", None, "a"])]
    texts = [(i, t) for i, t in enumerate(texts_of(4, 80))] + [(500, None)]
    got = patterns.matches(spark.createDataFrame(found, "pattern_id long, pattern string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((t, i) for i, p in found if p for t, x in texts if x and p in x)


def test_entities_and_names_in_both_directions(spark):
    entities = [(1, "Alpha Beta"), (2, "b"), (3, "BETA"), (4, None), (1, "zz"), (5, "beta")]
    names = ["beta", "Alphabet", "alpha", "a", "Beta Gamma", None, "ETA"]
    got = graph.entity_matches(spark.createDataFrame(entities, "query_id long, entity string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(q, e, n) for q, e in entities if e and len(e) > 1 for n in names if n and len(n) > 1 and (e.lower() in n.lower() or n.lower() in e.lower())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def covers(tokens, terms):
    """All smallest runs, by trying every pair of ends."""
    runs = [(a, b) for a in range(len(tokens)) for b in range(a, len(tokens)) if set(terms) <= set(tokens[a : b + 1])]
    return [(a, b) for a, b in runs if not any((c, d) != (a, b) and a <= c and d <= b for c, d in runs)]


def test_cover_density(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("one two three four five".split(), k=r.randint(0, 14)))) for i in range(40)] + [(90, None), (91, "One, two-three!"), (92, "bone two threefold")]
    queries = [(1, "one two three"), (2, "Three, one"), (3, "two two"), (4, "absent one"), (5, " "), (6, "one two threefold"), (7, "ne two three")]
    got = {(x["query_id"], x["doc_id"]): x["score"] for x in postings.rank_all(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), 100).collect()}
    want = {}
    for q, query in queries:
        terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
        for d, text in docs:
            tokens = re.findall(r"[^\W_]+", (text or "").lower())
            score = sum(len(terms) / (b - a + 1) for a, b in covers(tokens, terms)) if terms else 0
            score += 0.2 * bool(query.strip() and query.lower().strip() in (text or "").lower())
            if score:
                want[q, d] = round(score, 9)
    assert got == pytest.approx(want)


def test_postings_hold_positions_and_lengths(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "A"), (3, None)], "doc_id long, text string")
    got = {(r["term"], r["doc_id"]): (r["positions"], r["n_terms"]) for r in postings.postings(docs).collect()}
    assert got == {("b", 1): ([0, 2], 3), ("a", 1): ([1], 3), ("a", 2): ([0], 1)}


def test_keyword_scores_by_base(spark):
    pages = [(1, "en", "Guide", "alpha beta alpha"), (2, "en", "Alpha", "nothing"), (3, "fr", "x", "alpha"), (4, "en", None, None), (5, "en", "t", "alphabet")]
    queries = [(1, "en", ["alpha", "beta"]), (2, "fr", ["alpha", "alpha"]), (3, "en", []), (4, "de", ["alpha"])]
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in postings.rank_any(spark.createDataFrame(queries, "query_id long, kb string, keywords array<string>"), spark.createDataFrame(pages, "doc_id long, kb string, title string, content string"), 2).collect()}
    assert got == {(1, 1): (round(0.2 + 2 / 3 + 1 / 2, 9), 1), (1, 2): (0.3, 2), (2, 3): (0.6, 1)}
