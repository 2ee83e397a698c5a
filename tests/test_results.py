"""Queries without SQL against brute force, and operators on cases of their own."""

import math
import re
from collections import defaultdict

import pytest

from weirloom.operators import chunking, retrieve
from weirloom.plans import registry, retrieval

registry.load()
SF = "/root/testdata/sf0.01"


def squeezed(text):
    return " ".join((text or "").split())


def bare(text):
    return set(re.findall(r"[^\W_]+", text or ""))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_recall_of_approximate_search(spark):
    for sf in (SF,):
        exact = {(r["query_id"], r["doc_id"]) for r in retrieve.vector_top(retrieval.queries(spark, sf), retrieval.corpus(spark, sf), 10).collect()}
        found = {(r["query_id"], r["doc_id"]) for r in registry.QUERIES["t2_approximate_topk"](spark, sf).collect()}
        assert len(exact & found) >= 0.9 * len(exact)


def test_keyword_scores_against_plain_containment(spark):
    docs = [(1, "The cat sat"), (2, "concatenate"), (3, None), (4, ""), (5, "a" * 3000 + "cat"), (6, "THE end"), (7, "sat cat the")]
    queries = [(1, "cat sat cat"), (2, "the end"), (3, "   "), (4, "zebra"), (5, "a")]
    got = retrieve.keyword_top(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    want = {}
    for q, text in queries:
        tokens = text.lower().split()
        scored = sorted(((-sum(t in (d or "").lower() for t in tokens) / len(tokens), i) for i, d in docs if tokens), key=lambda x: x)
        for rank, (s, i) in enumerate([x for x in scored if x[0] < 0][:3], 1):
            want[q, i] = (-s, rank)
    assert {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in got} == want


def test_blocks_of_queries_give_what_one_block_gives(spark, monkeypatch):
    q, c = retrieval.queries(spark, SF), retrieval.corpus(spark, SF)
    rows = lambda: [{tuple(r) for r in f(q, c, 5).collect()} for f in (retrieve.vector_top, retrieve.keyword_top)]
    whole = rows()
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 7)
    assert rows() == whole


@pytest.mark.parametrize("name,most", [("c5_semantic_chunks", 1000), ("w7_balanced_chunks", 1000)])
def test_chunks_are_bounded_and_whole(spark, texts, name, most):
    chunks = defaultdict(list)
    for r in registry.QUERIES[name](spark, SF).collect():
        chunks[r["doc_id"]].append((r["seq"], r["chunk"]))
    assert set(chunks) >= {d for d, t in texts.items() if squeezed(t)}
    for d, own in chunks.items():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert all(len(c) <= most + 51 for _, c in own)  # a split chunk begins with some of the one before
        words = bare(texts[d])
        if all(len(w) < most // 2 for w in words):  # no word is cut, only separators between chunks go
            whole = " ".join(c for _, c in own)
            assert all(w in whole for w in words)


def test_few_sentences_are_split_recursively(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, "word " * 500), (3, None)], "doc_id long, text string")
    rows = chunking.semantic(docs, most=300).collect()
    assert [r["chunk"] for r in rows if r["doc_id"] == 1] == ["One. Two."]
    assert len([r for r in rows if r["doc_id"] == 2]) > 5 and all(len(r["chunk"]) <= 351 for r in rows)


def test_adjacent_similarity(spark):
    around = defaultdict(dict)
    for r in registry.QUERIES["w4_sentence_window"](spark, SF).collect():
        around[r["doc_id"]][r["seq"]] = r["around"]
    vector = lambda t: [t.lower().count(chr(97 + i)) for i in range(26)]
    for r in registry.QUERIES["w5_adjacent_similarity"](spark, SF).where("doc_id % 20 = 0").collect():
        a, b = vector(around[r["doc_id"]][r["seq"]]), vector(around[r["doc_id"]][r["seq"] + 1])
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        assert abs(r["similarity"] - (sum(x * y for x, y in zip(a, b)) / size if size else 0)) < 2e-6


def test_similarities_need_no_window_over_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weirloom.functions import text as T

    given = [(1, "One two. Three İx! Four 7. \u212aelvin?"), (2, None), (3, "12. 34. 56."), (4, "Lone"), (5, "Ab. ba! 甲乙。Cc.\nd")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for made in (chunking.adjacent_similarity(docs), chunking.semantic(docs)):
        assert "Window" not in made._jdf.queryExecution().toString()
    monkeypatch.setattr(chunking, "SLICE_BYTES", 10)  # texts longer than a slice, slices of one text
    rows = {r["doc_id"]: r["s"] for r in docs.selectExpr("doc_id", "text").select("doc_id", T.sentences(F.col("text")).alias("s")).collect()}
    want = {}
    for d, s in rows.items():
        around = [" ".join(s[max(i - 1, 0) : i + 2]).lower() for i in range(len(s or []))]
        v = [[a.count(chr(97 + i)) for i in range(26)] for a in around]
        for i, (a, b) in enumerate(zip(v, v[1:])):
            size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            want[d, i] = sum(x * y for x, y in zip(a, b)) / size if size else 0.0
    got = {(r["doc_id"], r["seq"]): r["similarity"] for r in chunking.adjacent_similarity(docs).collect()}
    assert set(got) == set(want) and {d for d, _ in got} == {1, 3, 5} and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {d for d, in chunking.semantic(docs).select("doc_id").collect()} == {1, 3, 4, 5}


def test_rate_limit_against_a_plain_bucket(spark):
    events = [(r["user_id"] % 10, r["ts"].timestamp(), r["event_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "event_id").collect()]
    want, state = {}, {}
    for client, at, event in sorted(events):
        tokens, before = state.get(client, (3.0, at))
        tokens = min(3.0, tokens + (at - before) * 0.1 / 60)
        want[event] = tokens >= 1
        state[client] = (tokens - want[event], at)
    got = {r["event_id"]: r["allowed"] for r in registry.QUERIES["e4_rate_limit"](spark, SF).collect()}
    assert set(got) == set(want) and sum(got[e] != want[e] for e in want) <= 2  # rounding at the edge of a token


def test_wiki_links_as_markdown(spark):
    from pyspark.sql import functions as F

    from weirloom.functions import text as T

    cases = {"see [[ops/run-book.md|the book]]!": "see [ops/run book](ops/run-book.md)!", "[[ a-b ]][[c]]": "[a b](a-b)[c](c)", "none [[]] [x]": "none [[]] [x]", "": ""}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", T.wiki_rendered(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_ties_are_cut_inside_a_batch(spark):
    """A word that all documents have sends k rows a query and batch, not every document."""
    docs = spark.range(2000).select("id", retrieve.F.lit("same word").alias("text")).withColumnRenamed("id", "doc_id").coalesce(1)
    queries = spark.createDataFrame([(i, "word") for i in range(3)], "query_id long, query string")
    found = retrieve.keyword_top(queries, docs, 5)
    assert [(r["query_id"], r["doc_id"]) for r in found.orderBy("query_id", "rank").collect()] == [(q, d) for q in range(3) for d in range(5)]
    value, order = retrieve.np.ones((500, 3)), retrieve.np.arange(500)[::-1]
    row, query = retrieve.best_rows(value, order, 5, 0.0)
    assert sorted(zip(query.tolist(), row.tolist())) == [(q, r) for q in range(3) for r in range(495, 500)]


def test_places_in_groups_of_any_size(spark):
    rows = spark.createDataFrame([("hot", i % 300) for i in range(900)] + [("a", 1), (None, 2), (None, None), ("b", None)], "g string, v long")
    got = retrieve.numbered(rows, ["g"], "v").collect()
    for g in ("hot", "a", "b", None):
        own = sorted((r["n"], r["v"]) for r in got if r["g"] == g and r["v"] is not None)
        assert [v for _, v in own] == sorted(v for _, v in own)
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(1, 1 + sum(r["g"] == g for r in got)))
    assert [r["v"] for r in got if r["g"] is None and r["n"] == 1] == [None]


def test_items_of_answers(spark):
    from weirloom.operators import imports

    good = 'ok {"nodes": [{"name": " A ", "type": "T", "attributes": ["x"]}, {"name": "B"}, {"name": ""}], "relations": [{"src": "A", "dst": "B", "type": "is a"}, {"src": "A", "dst": "A", "type": "t"}, {"src": "A", "dst": "C"}, {"src": "A ", "dst": "B", "type": "is a"}]} done'
    rows = [(1, good), (2, good.replace('"T"', '"U"')), (3, "nothing"), (4, "{broken"), (5, None), (6, '{"nodes": []}')]
    found = imports.items(spark.createDataFrame(rows, "chunk long, answer string"))
    assert [r["chunk"] for r in found.where("failed").orderBy("chunk").collect()] == [3, 4, 5]
    assert sorted(map(tuple, imports.graph_nodes(found).collect())) == [("A", "T", 2, ["x"]), ("B", None, 2, [])]
    assert list(map(tuple, imports.graph_relations(found).collect())) == [("A", "B", "is_a", 2)]


def test_short_chunks_are_joined_in_linear_time():
    import time

    assert chunking.join_short(["a", "bb", "cccc", "d", "e" * 9, "f"], 4) == ["a bb", "cccc", "d eeeeeeeee", "f"]
    began = time.perf_counter()
    assert len(chunking.join_short(["word"] * 420_000, 100)) == 20_000
    assert time.perf_counter() - began < 2


def test_grep_globs_sizes_and_budget(spark):
    from weirloom.operators import graph

    files = [("a/x.py", "hit 1\nno\nhit 2\nhit 3"), ("a/b/y.py", "hit 4"), ("a/z.txt", "hit 5"), ("big.py", "hit " + "x" * 5000), ("c.py", "HIT 6"), ("n.py", None)]
    df = spark.createDataFrame(files, "path string, text string")
    got = lambda **m: [(r["path"], r["line_no"]) for r in graph.grep(df, "(?i)hit", **m).orderBy("path", "line_no").collect()]
    assert got(glob="**.py", largest=100, per_file=2) == [("a/b/y.py", 1), ("a/x.py", 1), ("a/x.py", 3), ("c.py", 1)]
    assert got(glob="a/*.py") == [("a/x.py", 1), ("a/x.py", 3), ("a/x.py", 4)] and got(glob="?.py") == [("c.py", 1)]
    assert got(budget=12, largest=100) == [("a/b/y.py", 1), ("a/x.py", 1)] and len(got(most=3)) == 3


def test_wiki_compile_returns_whole_indexes(spark, tmp_path, monkeypatch):
    """Indexes of more pages than a block has lines, with repeated pages, ids in two bases and rows without base or id; also against the SQL."""
    import duckdb

    from weirloom.plans import graphs

    docs = [(i, "en", "x") for i in range(1, 41)] + [(5, "en", "again"), (7, "fr", None), (10, "fr", ""), (50, None, "x"), (51, None, "x"), (None, "en", "x"), (None, None, None), (60, "", "x")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(graphs, "INDEX_LINES", 7, raising=False)
    got = {r["kb"]: r.asDict() for r in registry.QUERIES["q23_wiki_compile"](spark, str(tmp_path)).collect()}
    assert got["en"]["index"].split("\n") == sorted(f"en/{i}.md" for i in range(1, 41)) and got["en"]["n_pages"] == 40
    assert got["fr"]["index"] == "fr/10.md\nfr/7.md" and got[""]["index"] == "/60.md" and got[None]["index"] is None
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES["q23_wiki_compile"])
    columns = [d[0] for d in cursor.description]
    assert {r[columns.index("kb")]: dict(zip(columns, r)) for r in cursor.fetchall()} == got
