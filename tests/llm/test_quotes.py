import random

from weirloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    got = quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r["conv_id"], r["turn"]): r for r in got}, got


def test_links_order_and_texts(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\n\nAnd what about cake?"),
        (1, 1, "assistant", "Mix flour and water."),
        (1, 2, "user", "An aside."),
        (1, 3, "user", "On Monday someone wrote:\n> mix   FLOUR and water.\nHow much water?"),
        (1, 4, "assistant", ">> And what about cake?\n> Mix flour and water.\nSugar, mostly."),
        (1, 5, "user", "> How much water?\n\nStill unknown"),
        (2, 0, "user", "> Mix flour and water.\nI read this elsewhere"),
        (2, 1, "user", "> never written anywhere\nhm"),
        (2, 2, None, None),
    ]
    got, _ = run(spark, rows)
    assert (got[1, 3]["reply_turn"], got[1, 3]["own"], got[1, 3]["n_linked"]) == (1, "How much water?", 1)
    assert (got[1, 4]["n_quotes"], got[1, 4]["n_linked"], got[1, 4]["reply_turn"]) == (2, 2, 1)
    assert got[1, 5]["reply_turn"] == 3
    # replies follow what they answer: 0, 1 (3 (5), 4), 2
    order = sorted((r["position"], t) for (c, t), r in got.items() if c == 1)
    assert [t for _, t in order] == [0, 1, 3, 5, 4, 2]
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (1, 1)
    assert (got[2, 1]["n_quotes"], got[2, 1]["n_linked"], got[2, 1]["reply_turn"]) == (1, 0, None)
    assert got[2, 2]["own"] == ""


def test_long_chain(spark):
    rows = [(7, 0, "user", "line 0")] + [(7, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 40)]
    got, _ = run(spark, rows)
    assert all(got[7, t]["position"] == t and got[7, t]["reply_turn"] == (t - 1 if t else None) for t in range(40))


def test_common_passage_repeats_and_nulls(spark):
    rows = [(c, 0, "user", "hello") for c in range(50)] + [(c, 1, "user", "> Hello\nhi") for c in range(50)] + [(None, None, None, None), (3, 1, "user", "> Hello\nhi"), (9, 5, "user", ">" * 300 + " deep")]
    got, every = run(spark, rows)
    assert len(every) == len(rows)
    assert all(got[c, 1]["reply_conv"] == c for c in range(50))
    assert sorted(r["position"] for r in every if r["conv_id"] == 3) == [0, 1, 2]


def test_own_words_are_not_links(spark):
    got, _ = run(spark, [(1, 0, "u", "> a b\nc"), (1, 1, "u", "a b")])
    assert got[1, 0]["n_linked"] == 0  # written later only


def test_documents_and_empty(spark):
    m = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = quotes.conversations(m).collect()
    assert len(got) == m.count() and all(r["n_quotes"] == 0 for r in got)
    assert quotes.conversations(m.limit(0)).count() == 0
    assert quotes.transcripts(m).count() == m.select("conv_id").distinct().count()


def test_runs_of_lines_and_other_conversations(spark):
    rows = [
        (1, 0, "user", "one\ntwo\nthree\nfour\n\nfive\n\nsix"),
        (1, 1, "user", "> two\n> three\ninside a paragraph"),
        (1, 2, "user", "> one\n> two\n> three\n> four\n>\n> Five\ntwo of three paragraphs"),
        (1, 3, "user", "> six\nfirst answer\nof two lines\n> never said\nlast answer"),
        (1, 4, "user", "> first answer\n> of two lines\nquotes an inline answer"),
        (1, 5, "user", "> two\n> four\nnot consecutive"),
        (2, 0, "user", "> said here later\nasks"),
        (2, 1, "user", "said here later"),
        (3, 0, "user", "said here later"),
        (None, 0, "user", "> two\n> three\nelsewhere"),
    ]
    got, _ = run(spark, rows)
    assert [got[1, t]["reply_turn"] for t in range(1, 6)] == [0, 0, 0, 3, None]
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (3, 0)
    assert (got[None, 0]["reply_conv"], got[None, 0]["reply_turn"]) == (1, 0)


def reply_order(parents):
    """Turns in preorder, by a plain walk."""
    out, children = [], {}
    for t, p in parents.items():
        children.setdefault(p, []).append(t)
    stack = sorted(children.get(None, []), reverse=True)
    while stack:
        t = stack.pop()
        out.append(t)
        stack += sorted(children.get(t, []), reverse=True)
    return out


def test_reply_order_against_a_plain_walk(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv, back in ((1, 1), (2, 2), (3, 9), (4, 200), (None, 5)):
        parents = {}
        for t in range(200):
            p = t - rng.randint(1, back) if rng.random() < 0.9 else None
            p = p if p is not None and p >= 0 else None
            parents[t] = p
            rows.append((conv, t, "u", f"message {t} of {conv}" if p is None else f"> message {p} of {conv}\nmessage {t} of {conv}"))
        want[conv] = reply_order(parents)
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        _, got = run(spark, rows)
        for conv, order in want.items():
            own = sorted((r["position"], r["turn"]) for r in got if r["conv_id"] == conv)
            assert [p for p, _ in own] == list(range(200)) and [t for _, t in own] == order
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quotes_put_before_messages_are_linked_and_taken_off(spark):
    m = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    quoted = quotes.quoting(m)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(quoted).collect()}
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in m.collect()}
    assert len(got) == len(texts) and sum(r["n_quotes"] for r in got.values()) > 0.5 * len(got)
    for (c, t), r in got.items():
        assert r["own"] == texts[c, t].strip() or r["own"] == texts[c, t]
        assert r["n_linked"] == r["n_quotes"]
        if r["n_quotes"]:
            assert r["reply_conv"] == c and r["reply_turn"] < t
