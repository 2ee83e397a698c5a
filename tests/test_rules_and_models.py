"""Compiled rules, guarded model calls, recovery, memory budgets and seeded samples on cases of their own."""

import time

import pytest
from pyspark.sql import functions as F

from weirloom.functions import rules
from weirloom.functions import text as T
from weirloom.operators import guarded, memory, recovery, sample

SCHEMA = {"required": ["q", "n"], "properties": {"q": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "integer"}, "x": {"type": "number"}, "o": {"type": "object"}, "l": {"type": "array"}, "b": {"type": "boolean"}, "any": {}}}


@pytest.mark.parametrize(
    ("document", "errors"),
    [
        ('{"q": "a", "n": 1}', []),
        ('{"q": "a", "n": 2.0, "x": 1.5, "o": {}, "l": [], "b": true, "any": null, "more": 1}', []),
        ('{"q": " ", "x": "y"}', ["q: blank", "n: required"]),
        ('{"q": null, "n": 1}', ["q: required"]),
        ('{"q": "c", "n": 1.5, "x": true, "o": [], "l": {}, "b": 0}', ["q: enum", "n: integer", "x: number", "o: object", "l: array", "b: boolean"]),
        ('{"q": 7, "n": "1"}', ["q: string", "n: integer"]),
        ("[]", ["json: invalid"]),
        ("{", ["json: invalid"]),
        (None, ["json: invalid"]),
    ],
)
def test_schema_errors(spark, document, errors):
    assert spark.createDataFrame([(document,)], "d string").select(rules.schema_errors(F.col("d"), SCHEMA)).first()[0] == errors


def test_url_reasons(spark):
    policy = rules.UrlPolicy(allowed=["ok.com", "bad.ok.com"], blocked=["bad.ok.com"], blocked_hosts=["Secret.ok.com"])
    cases = {
        "https://a.ok.com/x": None, "HTTP://OK.com": None, "ftp://ok.com": "scheme", "nothing": "invalid", "https://notok.com": "not_allowed", "https://x.bad.ok.com/": "blocked_domain",
        "https://secret.OK.com:8080/": "blocked_host", "http:///x": "no_host", " https://ok.com ": None,
    }
    got = {r["u"]: r["r"] for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", rules.url_reason(F.col("u"), policy).alias("r")).collect()}
    assert got == cases
    for host, private in {"10.1.2.3": True, "172.32.0.1": False, "172.31.0.1": True, "[::1]": True, "[2001:db8::1]": False, "8.8.8.8": False, "169.254.1.1": True, "198.19.0.1": True}.items():
        row = spark.createDataFrame([(f"http://{host}/",)], "u string").select(rules.url_reason(F.col("u"), rules.UrlPolicy()), rules.url_reason(F.col("u"), rules.UrlPolicy(private_networks=True))).first()
        assert tuple(row) == ("private_address" if private else None, None)


def test_malformed_urls_keep_their_host(spark):
    cases = {
        "https://[fe80::10178]/x": "private_address", "https://10.0.0.1/a b|c": "private_address", "https://me:pw@10.0.0.1:80/": "private_address", "https://localhost/%zz": "blocked_host",
        "https://ok.com/{a}?q=@10.0.0.1": None, "https://ok.com/^": None, "1http://ok.com": "invalid", None: None,
    }
    got = {r["u"]: r["r"] for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", rules.url_reason(F.col("u"), rules.UrlPolicy()).alias("r")).collect()}
    assert got == cases


def test_bad_patterns_are_left_out(spark):
    extra = rules.valid_rules(spark, [("ok", "high", "drop table"), ("bad", "high", "(unclosed"), ("late", "medium", "[a-z]{2}x")])
    assert [r[0] for r in extra] == ["ok", "late"]
    level, names = T.prompt_risk(F.col("t"), extra)
    assert tuple(spark.createDataFrame([("DROP TABLE abx",)], "t string").select(level, names).first()) == ("high", "ok,late")


def test_failing_models_lose_no_row(spark):
    def model(pairs):
        if any(p[1] is None or "bad" in p[1] for p in pairs):
            raise RuntimeError("no")
        return [float(len(p[1])) for p in pairs]

    hits = [(1, "q", d, "bad" if d % 5 == 0 else None if d == 7 else "x" * d, d + 1) for d in range(12)]
    df = spark.createDataFrame(hits, "query_id long, query string, doc_id long, text string, rank int")
    got = {r["doc_id"]: (r["score"], r["fallback"]) for r in guarded.rerank(df, model, 50, batch=4).collect()}
    assert got == {d: (round(1 - 0.05 * d, 9), True) if d % 5 == 0 or d == 7 else (float(d), False) for d in range(12)}
    assert guarded.rerank(df.limit(0), model, 5).count() == 0


def test_outputs_of_slow_short_and_flaky_models():
    assert guarded.outputs(lambda xs: (time.sleep(0.5), xs)[1] if 3 in xs else xs, [1, 2, 3, 4], retries=0, seconds=0.2) == [1, 2, None, 4]
    assert guarded.outputs(lambda xs: xs[:1], [1, 2, 3]) == [1, 2, 3]  # answers too few until it is asked one by one
    calls = []
    assert guarded.outputs(lambda xs: (calls.append(1), 1 / (len(calls) - 1), xs)[2], [5, 6], retries=1) == [5, 6] and len(calls) == 2


def test_recovery_passes_on_only_what_is_unanswered(spark):
    queries = spark.createDataFrame([(i, f"query {i}") for i in range(5)] + [(9, None)], "query_id long, query string")
    good, bad = "a long and useful piece of evidence with many letters in it", "short"
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    seen = []

    def search(ids, doc):
        def run(q):
            seen.append(sorted(r["query_id"] for r in q.select("query_id").collect()))
            return q.where(F.col("query_id").isin(ids)).select("query_id", F.lit(doc).cast("long").alias("doc_id"), F.lit(1).alias("rank"))

        return run

    as_is, upper = (lambda q: q), F.upper
    out = recovery.recover(queries, docs, [recovery.Attempt("a", as_is, search([0, 1], 1)), recovery.Attempt("a", as_is, search([2], 1)), recovery.Attempt("b", as_is, search([2, 3], 2)), recovery.Attempt("a", upper, search([2], 1))])
    got = {r["query_id"]: (r["attempt"], r["mode"], r["kept"], r["status"], r["sources"]) for r in out.collect()}
    assert seen == [[0, 1, 2, 3, 4], [], [2, 3, 4], [2, 3, 4]]  # the same way twice is not gone twice
    assert got[0] == got[1] == (1, "a", 1, "ok", [1]) and got[2] == (4, "a", 1, "ok", [1])
    assert got[3] == (None, None, 0, "low_quality_evidence", []) and got[9][0] is None and len(got) == 6


def test_memory_budgets(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"m{t} " + "y" * 30) for c in range(8) for t in range(20)] + [(20, 0, "user", None), (21, 0, "User", "  hi  ")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sessions = spark.createDataFrame([(c, 1, c, f"s{c}") for c in range(8)] + [(20, None, 1, None), (21, 2, 1, None)], "conv_id long, user_id long, updated long, title string")
    got = {r["conv_id"]: r["memory"] for r in memory.instruction(messages, sessions, window=3, budget=600).collect()}
    assert 20 not in got and got[21] == "【会话短期记忆】\n用户: hi"
    short, long = got[2].split("\n\n", 1)
    assert short.split("\n")[1].startswith("助手: m14") and len(short.split("\n")) == 7  # six messages of some 45 bytes stay below 300
    # the newest session first, never the own one; each within 150 bytes and the line that reaches them, all within 300 and the session that does
    assert long.startswith("【跨会话长期记忆（数据库）】\n[历史会话] s7\n") and "s2" not in long and long.count("[历史会话]") == 2
    assert "s7" not in got[7].split("\n\n", 1)[1]


def test_bottom_k_does_not_depend_on_partitioning(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id").alias("pid"))
    pick = lambda df, **m: sorted(map(tuple, sample.bottom_k(df, 5, "pid", 3, **m).collect()))
    whole = pick(rows.coalesce(1), groups=["g"])
    assert whole == pick(rows.repartition(9), groups=["g"]) and len(whole) == 35
    # mergeable: the bottom k of two halves' bottom k
    a, b = rows.where("pid < 250"), rows.where("pid >= 250")
    assert pick(rows) == pick(sample.bottom_k(a, 5, "pid", 3).union(sample.bottom_k(b, 5, "pid", 3)))
    judged = spark.createDataFrame([(1, p, 2) for p in range(4)] + [(1, 10 + p, 0) for p in range(30)] + [(2, 99, 3)], "qid long, pid long, rel int")
    q = sample.sample_queries(judged, 5, 2)
    assert [r["qid"] for r in q.collect()] == [1]
    got = sample.passages(judged, q, 10).collect()
    assert sorted(r["pid"] for r in got if r["rel"] == 2) == [0, 1, 2, 3] and sum(r["rel"] == 0 for r in got) == 6
