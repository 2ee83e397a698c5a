import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weirloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fine(kind, word):
    digits = re.sub("[^0-9]", "", word)
    return {"email": True, "ip": all(int(p) <= 255 for p in word.split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in pii.BASE_KINDS for m in re.finditer(PLAIN[k], text or "") if _fine(k, m[0]))


HARD = [
    None, "", " ", "a@b.c_d@e.f", "x@y@b.c z", "@@a.b@c-.d..e", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111111111111111",
    "12345678901234567890123 4111111111111111", "é4111111111111111ü +1 (523) 555-1055) +12 +1((((", "+49-170-1234567 call +1 2", "\x01a@b.cd\x01 \U0001f600 9.9.9.9", "a" * 5000 + "@b.c " + "1" * 4000 + " " + "1 " * 6000, "1.1.1.1" * 300, "😀😀x.y@z.io,q@r.st",
    "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 16, "+1" * 50, "+1 555 555 5555 +1 555 555 5555\n+", "00000000000000000000256.1.1.1 0000000255.1.1.1",
]


def test_base_spans_match_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(HARD)]
    got = pii.annotate(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in got.select("doc_id", pii.joined(F.col("base_spans")).alias("s")).collect()}
    for i, text in rows:
        assert got[i] == brute(text), text and text[:60]


def test_base_spans_match_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.annotate(docs.select("doc_id", "text")).select("doc_id", "text", pii.joined(F.col("base_spans")).alias("s"), pii.joined(F.col("pii_spans")).alias("m")).collect()
    assert len(got) == 1000
    for r in got:
        assert r["s"] == brute(r["text"])
        assert set(filter(None, r["s"].split(","))) <= set(r["m"].split(","))
        for start, end in re.findall(r"secret:(\d+):(\d+)", r["m"]):
            assert re.fullmatch("[0-9a-f]{40}", r["text"][int(start) : int(end)])
    held = {r["doc_id"] for r in got if re.search('token = "[0-9a-f]{40}"', r["text"])}
    assert held == {r["doc_id"] for r in got if "secret:" in r["m"]}


def test_clashing_columns_empty_and_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd or 10.0.0.1 now", 5, "x"), (1, "mail a@b.cd or 10.0.0.1 now", 5, "x"), (None, None, None, None)], "doc_id long, text string, n_email int, p_row string")
    out = pii.annotate(docs)
    assert out.columns == ["doc_id", "text", "p_row", *(f"n_{k}" for k in pii.BASE_KINDS), "base_spans", "pii_spans"]
    texts = [r[0] for r in out.select(pii.redacted(F.col("text"), F.col("pii_spans"))).collect()]
    assert sorted(texts, key=str) == [None, "mail [EMAIL] or [IP] now", "mail [EMAIL] or [IP] now"]
    assert pii.annotate(docs.limit(0)).count() == 0


def test_em_finds_the_bad_labeler():
    # labeler 3 votes at random; the others agree with the truth
    counts = [("+++" + v + "10", 50) for v in "+-"] + [("---" + v + "00", 50) for v in "+-"]
    _, rates, posterior = pii.reliabilities(counts)
    assert rates[0][0] > 0.9 and rates[3][0] < 0.65
    assert posterior["++++10"] > 0.9 and posterior["---+00"] < 0.1
    weights = pii.classifier(counts, posterior)
    assert weights[(0, "+")] > weights[(0, "-")]


@pytest.mark.parametrize("word,fine", [("4111 1111 1111 1111", True), ("4111111111111112", False)])
def test_luhn(spark, word, fine):
    assert spark.range(1).select(pii.luhn(F.lit(word))).first()[0] is fine


def test_digest_of_no_spans(spark):
    assert spark.range(1).select(F.sha2(pii.joined(F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)")), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_secrets_of_any_length_and_without_digits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    key = hashlib.sha512(b"key").hexdigest()
    secrets = {
        -1: ('token = "{}"', key), -2: ('secret: "{}"', key * 4), -3: ('token = "{}" # rotate', "".join(c for c in key if c.isalpha())[:40] + key * 2), -4: ("api_key = '{}'", "a" * 90 + key),
        -5: ('password = "{}"', "correcthorsebatterystaple"), -6: ("token: {} and so on", "QwErTyUiOpAsDfGhJkLzXcVbNm"), -7: ("bearer = {}", "abcdefghij" * 30),
    }
    prose = ["internationalization of counterrevolutionaries", "a state-of-the-art-and-then-some idea", "-" * 300 + "\n" + "_" * 40, "see https://a.test/how-to-bake-bread-at-home-in-2024-and-what-to-do-with-all-of-the-leftover-crumbs", "1" * 300]
    extra = [(i, t.format(s)) for i, (t, s) in secrets.items()] + [(-100 - i, t) for i, t in enumerate(prose)]
    got = {r["doc_id"]: r for r in pii.annotate(docs.union(spark.createDataFrame(extra, docs.schema))).where("doc_id < 0").select("doc_id", "text", "pii_spans").collect()}
    for i, (_, s) in secrets.items():
        assert [r["text"][x["start"] : x["end"]] for r in [got[i]] for x in r["pii_spans"] if x["kind"] == "secret"] == [s], i
    assert not [x for i, r in got.items() if i <= -100 for x in r["pii_spans"]]


def corpus(seed, n):
    """(documents, planted spans by kind): prose with personal data in usual surroundings, and with what only looks like it."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = "the report of last week was read and nobody had any more to say about it".split()
    given, last, places = (x.split() for x in (pii.GIVEN_NAMES, pii.SURNAMES, pii.PLACES))
    unknown = ["Quibbly", "Zorvath", "Plimton", "Wexlor", "Brandtner"]

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        number = int("".join(str(int(c, 36)) for c in body + "DE00"))
        text = f"DE{98 - number % 97:02d}{body}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4))

    planted = {
        "person": lambda: rng.choice([f"{rng.choice(['name:', 'contact', 'signed by', 'met with', 'dear'])} @{rng.choice(given)} {rng.choice(last + unknown)}@", f"saw Dr. @{rng.choice(given + unknown)} {rng.choice(last)}@ there"]),
        "street": lambda: f"{rng.choice(['lives at', 'address:', 'moved to'])} @{rng.randint(1, 9999)} {rng.choice(last)} {rng.choice(['Street', 'Avenue', 'Rd', 'Lane'])}@, {rng.choice(places)}",
        "iban": lambda: f"{rng.choice(['iban:', 'account no', 'transfer to'])} @{iban()}@",
        "national_id": lambda: f"{rng.choice(['ssn:', 'social security number', 'ssn is'])} @{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}@",
        "local_phone": lambda: f"{rng.choice(['call', 'tel:', 'phone'])} @({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}@",
        "secret": lambda: f'{rng.choice(["token =", "api_key:", "password ="])} "@{"".join(rng.choice("0123456789abcdef") for _ in range(40))}@"',
    }
    other = [
        lambda: f"went to {rng.choice(['New', 'South', 'West'])} {rng.choice(places)} once", lambda: f"done. {rng.choice(['Great', 'Other', 'Many'])} {rng.choice(['Thanks', 'Things', 'Rivers'])} were seen", lambda: f"part AB{digits(2)} {digits(4)} {digits(4)} in stock",
        lambda: f"isbn {digits(3)}-{digits(2)}-{digits(4)} was sold out", lambda: f"order 000-00-{digits(4)} shipped", lambda: "see /img/" + "-".join(rng.choice(filler) for _ in range(8)) + ".png", lambda: f"in {rng.choice(['January', 'March', 'July'])} {rng.choice(places)} was cold",
    ]
    docs, truth = [], {}
    for i in range(n):
        pieces, text, spans = [rng.choice([planted[rng.choice(list(planted))], rng.choice(other)])() for _ in range(4)], "", set()
        for piece in pieces:
            text += " ".join(rng.choice(filler) for _ in range(rng.randint(3, 9))) + " "
            if "@" in piece:
                head, word, tail = piece.split("@")
                spans.add((len(text) + len(head), len(text) + len(head) + len(word)))
                piece = head + word + tail
            text += piece + ". "
        docs.append((i, text))
        truth[i] = spans
    return docs, truth


def test_held_out_precision_and_recall(spark):
    """The labelers' reliabilities and the classifier come from one corpus, the judged spans from another."""
    schema = "doc_id long, text string"
    models = pii.train(pii.find(spark.createDataFrame(corpus(1, 400)[0], schema)))
    assert set(models) == set(pii.MORE_KINDS)
    docs, truth = corpus(2, 400)
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["pii_spans"]} for r in pii.annotate(spark.createDataFrame(docs, schema), models=models).collect()}
    right = sum(len(got[i] & truth[i]) for i in truth)
    precision, recall = right / sum(map(len, got.values())), right / sum(map(len, truth.values()))
    assert precision > 0.95 and recall > 0.9, (precision, recall)
