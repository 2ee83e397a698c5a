"""PII: weak-supervision aggregation over regex, gazetteer and context labelers.

Base kinds (email, ip, card, phone) are exact patterns with checks; their spans always
stay. Further kinds (national_id, local_phone, secret, iban, person, street) start from broad
candidates, on which labelers vote `+`, `-` or abstain with `0`:

* regex - does the match have the exact shape of the kind (an iban's remainder by 97 is 1; a
  person's name has a title before it or a middle initial);
* gazetteer - is a word listed for the kind, or one listed against it, just before it; a
  person's words are looked up among given names and surnames, and among places, months and
  words that begin sentences; a street's last word among kinds of streets, what follows it
  among places;
* context - does an assignment or a colon lead to it, or is it part of a path, or a secret
  without digits and without such a lead; does a word for people or for living somewhere lead
  to a name or a street, or does a sentence begin with it;
* shape - is the mix of digits and letters that of the kind; for secrets, few digits will do
  in an unbroken token of 64 characters or more.

A secret's candidate is any whole run of at least 20 letters, digits, `_` and `-` that is not
all separators, of any length and with or without digits. Shorter passwords are not looked for.
Names are two capitalised words, with or without a middle initial, in ASCII.

The corpus is reduced to counts of vote patterns (a bounded table: votes to the power of
labelers, times kinds), from which expectation-maximisation (a two-class Dawid-Skene
model) estimates every labeler's reliability. Its posteriors train the final span
classifier, a logistic model over the votes and two shape features, which is applied as a
column expression. Candidates with probability of at least 0.5 become spans, unless they
overlap a base span. Only pattern counts reach the driver.

All of the row work is column expressions. A pattern's positions come from marking its
matches with a control character (U+0001; those in the text are first mapped to U+0002,
which no pattern can match either), splitting there, and adding up lengths. The patterns
are anchored to the start of their runs and possessive, so that long runs cost linear time.

Defined results: null or empty texts have no spans; repeated rows are judged row by row;
an empty table gives an empty one; positions count code points, ends are exclusive; other
columns are kept, those with the names of the result's are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirloom.llm.common import durable

MARK, OTHER = "\x01", "\x02"
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("national_id", "local_phone", "secret", "iban", "person", "street")

#: Each finds what the plain pattern of its kind finds, leftmost and not overlapping (see the tests for the plain forms).
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE_PATTERNS = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[_-]*+[A-Za-z0-9])[A-Za-z0-9_-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z0-9_@.-])[A-Z][a-z]{1,19}(?: [A-Z]\.)? [A-Z][a-z]{1,19}(?![A-Za-z0-9_@-])",
    "street": r"(?<![A-Za-z0-9.,-])[0-9]{1,5} (?:[A-Z][a-z]{1,19} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Square|Way|Terrace|Close|Crescent|Hill|Park|Row|Walk)(?![A-Za-z0-9])",
}
#: Exact shapes, for the regex labeler.
EXACT = {
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$",
    "secret": r"^(?:[0-9a-f]{32,}|(?:sk|pk|ghp|xox[a-z]|AKIA)[_-]?[A-Za-z0-9_-]{16,})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$",
    "person": r" [A-Z]\. ",
    "street": r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|Crescent)$",
}
#: Gazetteers: words before a candidate that speak for it, and against it.
FOR = {"national_id": "ssn|social|insurance|passport|identity|id", "local_phone": "phone|tel|call|fax|mobile|cell|contact", "secret": "token|secret|key|apikey|api_key|password|passwd|bearer|auth|credential"}
AGAINST = {"national_id": "isbn|part|order|ref|version", "local_phone": "isbn|order|ref|invoice", "secret": "sha|commit|checksum|digest|isbn|file|image"}
FOR |= {"iban": "iban|account|bank|payee|beneficiary|transfer"}
AGAINST |= {"iban": "part|order|ref|serial|model"}
#: Gazetteers of names and places, and of capitalised words that are neither.
GIVEN_NAMES = (
    "Aaron Adam Alan Albert Alex Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Antonio Arthur Barbara Benjamin Betty Brian Bruce Carl Carlos Carol Caroline Catherine Charles Charlotte Christine Christopher Claire Claudia "
    "Daniel David Deborah Dennis Diana Donald Dorothy Douglas Edward Elena Elizabeth Emily Emma Eric Eva Fatima Frank Gary George Grace Hannah Hans Harold Helen Henry Ivan Jack Jacob James Jane Janet Jason Jean Jennifer Jessica Joan John Jonathan Jose "
    "Joseph Joshua Juan Judith Julia Karen Katherine Keith Kenneth Kevin Kim Larry Laura Lauren Linda Lisa Louis Lucas Lucy Luis Maria Margaret Marie Mark Martha Martin Mary Matthew Megan Melissa Michael Michelle Mohammed Monica Nancy Natalie Nathan Nicholas "
    "Nicole Olivia Oscar Pamela Patricia Patrick Paul Paula Peter Philip Rachel Ralph Raymond Rebecca Richard Robert Roger Ronald Rose Roy Russell Ruth Ryan Samantha Samuel Sandra Sara Sarah Scott Sharon Simon Sofia Stephanie Stephen Steven Susan "
    "Teresa Theresa Thomas Timothy Tony Victor Victoria Vincent Walter Wayne William Yusuf Zoe"
)
SURNAMES = (
    "Adams Allen Anderson Bailey Baker Bell Bennett Brooks Brown Campbell Carter Clark Collins Cook Cooper Cox Cruz Davis Diaz Edwards Evans Fischer Flores Foster Garcia Gomez Gonzalez Green Gutierrez Hall Harris Hernandez Hill Howard Hughes Jackson Johnson "
    "Jones Kelly Khan King Lee Lewis Long Lopez Martinez Meyer Miller Mitchell Moore Morales Morgan Morris Murphy Myers Nelson Nguyen Ortiz Parker Patel Perez Peterson Phillips Powell Price Ramirez Reed Reyes Richardson Rivera Roberts Robinson Rodriguez "
    "Rogers Ross Sanchez Sanders Schmidt Schneider Singh Smith Stewart Sullivan Taylor Thompson Torres Turner Walker Wang Ward Watson White Williams Wilson Wood Wright Young"
)
PLACES = (
    "America Amsterdam Athens Atlanta Australia Austria Barcelona Beijing Belgium Berlin Boston Brazil Brussels Cairo California Canada Chicago China Dallas Delhi Denmark Denver Dublin Egypt England Europe Florida France Geneva Germany Hamburg Houston India "
    "Ireland Istanbul Italy Japan Kenya Lima Lisbon London Madrid Manchester Melbourne Mexico Miami Milan Moscow Mumbai Munich Netherlands Nigeria Norway Oslo Paris Poland Portugal Prague Rome Russia Scotland Seattle Seoul Shanghai Singapore Spain Sweden "
    "Switzerland Sydney Texas Tokyo Toronto Vienna Wales Warsaw Washington Zurich"
)
NO_NAMES = (
    "The This That These Those There Here When Where What Which While With Without From For And But Not After Before Then Thus Their Your Our His Her Its All Any Each Every Some Many Most Only Also Just Very New Old North South East West Great United "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday University College School Street Avenue Road River Lake Mount Island County State City Party Church Company Bank Inc Ltd"
)
TITLES = "mr|mrs|ms|miss|dr|prof|sir|herr|frau|madame|se\u00f1or"
PEOPLE = "name|called|contact|dear|regards|sincerely|signed|signature|patient|customer|employee|client|author|manager|tenant|attn|attention|born|by|from|met|with"
LIVING = "address|lives|living|live|resides|residing|at|home|located|ship|deliver|delivered|mail|moved|to"
LABELERS = ("regex", "gazetteer", "context", "shape")
MAX_PROBABILITY_STEPS = 200


def _parts(text: Column, pattern: str) -> Column:
    """Texts between matches (even places) and matches (odd places)."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, MARK + "$0" + MARK), MARK)


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start,end,word,before,after>> of the matches, by position."""
    parts = _parts(text, pattern)
    empty = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,word:string,before:string,after:string>>)")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"]
        size = F.length(x["part"]).cast("bigint")
        span = F.struct(at.alias("start"), (at + size).alias("end"), x["part"].alias("word"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((at + size).alias("at"), F.when(x["hit"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def rows(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                F.element_at(parts, i + 1).alias("part"),
                (i % 2 == 1).alias("hit"),
                F.when(i % 2 == 1, F.right(F.element_at(parts, i), F.lit(32))).otherwise("").alias("before"),
                F.when((i % 2 == 1) & (i < last), F.left(F.element_at(parts, i + 2), F.lit(32))).otherwise("").alias("after"),
            ),
        )

    # one-element array: the split is then computed once, not in each lambda
    return F.aggregate(F.flatten(F.transform(F.array(parts), rows)), F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")), step, lambda acc: acc["found"])


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(word: Column) -> Column:
    """Whether the digits in word pass the Luhn check."""
    digits = _digits(word)

    def add(acc: Column, x: Column) -> Column:
        twice = x["digit"] * 2
        return acc + F.when(x["even"], twice - F.when(twice > 9, 9).otherwise(0)).otherwise(x["digit"])

    places = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("digit"), (i % 2 == 1).alias("even")))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


CHECKS = {
    "email": lambda w: F.lit(True),
    "ip": lambda w: w.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?<=[0-9])(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?<=[0-9])){3}$"),
    "card": luhn,
    "phone": lambda w: F.length(_digits(w)).between(8, 15),
}
#: Cheap tests that hold for every text with a match.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "local_phone": lambda t: t.rlike(r"[0-9][.-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_-]{20}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "person": lambda t: t.rlike(r"[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]"),
    "street": lambda t: t.rlike(r"[0-9] [A-Z][a-z]+ [A-Z]"),
}
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes & ~no, "+").when(no & ~yes, "-").otherwise("0")


def _listed(word: Column, names: str) -> Column:
    return word.isin(*names.split())


def _remainder(word: Column) -> Column:
    """An iban by 97: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(word, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _votes(kind: str, span: Column) -> tuple[Column, Column, Column, Column]:
    word, before = span["word"], F.lower(span["before"])
    words = F.split(word, " ")
    after = lambda names: before.rlike(rf"(?:^|[^a-z])(?:{names})[^a-z0-9]*(?:is|was|no|number)?[^a-z0-9]*$")
    starts = before.rlike(r"(?:^|[.!?\n:][\s\"')]*)$")
    if kind == "person":
        first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
        known = _listed(first, GIVEN_NAMES) | _listed(last, SURNAMES)
        odd = _listed(first, PLACES) | _listed(last, PLACES) | _listed(first, NO_NAMES) | _listed(last, NO_NAMES) | (first == last)
        titled = before.rlike(rf"(?:^|[^a-z])(?:{TITLES})\.? $")
        led = after(PEOPLE)
        return _vote(titled | word.rlike(EXACT[kind]), odd), _vote(known, ~known), _vote(led | titled, starts), _vote(known & ~odd & (F.length(last) > 2), ~known & (starts | odd))
    if kind == "street":
        placed = _listed(F.regexp_extract(span["after"], r"^[,\s]+(?:[A-Z0-9]+ )?([A-Z][a-z]+)", 1), PLACES) | span["after"].rlike(r"^[,\s]+[A-Za-z ]*[0-9]{5}")
        return _vote(word.rlike(EXACT[kind]), F.lit(False)), _vote(placed, after("chapter|page|section|figure|table|number")), _vote(after(LIVING), F.lit(False)), _vote(F.size(words) <= 4, word.rlike("^0"))
    exact = _remainder(word) == 1 if kind == "iban" else word.rlike(EXACT[kind])
    digits = F.length(_digits(word)) / F.length(word)
    led = before.rlike(r"[=:#]\s*[\"']?$")
    # nothing but what leads to it tells a token without digits from a word
    wordy = ~word.rlike("[0-9]") if kind == "secret" else F.lit(False)
    # a slug is long too, but its separators break it up
    long = (F.length(word) >= 64) & (digits > 0) & (digits <= 0.95) & word.rlike("[A-Za-z0-9]{32}") if kind == "secret" else F.lit(False)
    # the pattern of these kinds leaves no other shape, so a vote would only repeat the regex's
    fixed = F.lit(kind in ("national_id", "local_phone"))
    shaped = word.rlike(EXACT[kind]) | (digits >= 0.5) if kind == "iban" else ~fixed & (digits >= 0.2) & (digits <= 0.95) | long
    return (
        _vote(exact, word.rlike("^[0-9]+$") | ~exact & F.lit(kind != "secret")),
        _vote(after(FOR[kind]), after(AGAINST[kind])),
        _vote(led, before.rlike(r"[/&?]$") | wordy & ~led),
        _vote(shaped, (digits < 0.1) & ~long | word.rlike("^[0-9]+$") | F.lit(kind == "iban") & ~exact),
    )


def votes(kind: str, span: Column) -> Column:
    """The pattern of a candidate: a vote for each of LABELERS, then two shape features as 1 or 0."""
    return F.concat(*_votes(kind, span), F.when(F.length(span["word"]) >= 32, "1").otherwise("0"), F.when(span["after"].rlike("^[\"']"), "1").otherwise("0"))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (p_row, p_base: map-like struct of base spans, p_more: candidates with patterns)."""
    keep = [c for c in keep or docs.columns if c.lower() not in OWN]
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("p_row"), F.coalesce(docs[text], F.lit("")).alias("p_text"))
    t = F.col("p_text")
    none = F.expr(f"CAST(array() AS {_SPAN})")

    def fine(kind: str) -> Column:
        good = F.filter(spans_of(t, BASE_PATTERNS[kind]), lambda s: CHECKS[kind](s["word"]))
        return F.when(NEEDS[kind](t), F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(none)

    base = {kind: fine(kind) for kind in BASE_KINDS}
    rows = rows.select("p_row", "p_text", *(c.alias(f"p_{k}") for k, c in base.items()))
    held = F.concat(*(F.col(f"p_{k}") for k in BASE_KINDS))
    more_type = "array<struct<kind:string,start:bigint,end:bigint,votes:string>>"

    def candidates(kind: str) -> Column:
        free = F.filter(spans_of(t, MORE_PATTERNS[kind]), lambda s: ~F.exists(held, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        shown = F.transform(free, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes(kind, s).alias("votes")))
        return F.when(NEEDS[kind](t), shown).otherwise(F.expr(f"CAST(array() AS {more_type})"))

    return rows.select("p_row", *(f"p_{k}" for k in BASE_KINDS), F.concat(*(candidates(k) for k in MORE_KINDS)).alias("p_more"))


# --- on the driver: a bounded table of patterns ------------------------------------------------


def reliabilities(counts: list[tuple[str, int]], steps: int = 50) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """(prior, per labeler (P(+|true), P(-|false)) among its votes, posterior of each pattern), by EM.

    Pseudo-counts of 8 votes at 0.85 start every labeler as better than chance and keep the classes from swapping.
    """
    n, prior, rates = len(LABELERS), 0.5, [(0.85, 0.85)] * len(LABELERS)
    posterior: dict[str, float] = {}
    for _ in range(steps):
        for pattern, _count in counts:
            odds = math.log(prior / (1 - prior))
            for vote, (hit, miss) in zip(pattern[:n], rates, strict=True):
                odds += math.log(hit / (1 - miss)) if vote == "+" else math.log((1 - hit) / miss) if vote == "-" else 0
            posterior[pattern] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        total = sum(c for _, c in counts)
        prior = min(0.98, max(0.02, (2 + sum(posterior[p] * c for p, c in counts)) / (4 + total)))
        for i in range(n):
            sums = {"+": [0.0, 0.0], "-": [0.0, 0.0], "0": [0.0, 0.0]}
            for pattern, count in counts:
                sums[pattern[i]][0] += posterior[pattern] * count
                sums[pattern[i]][1] += (1 - posterior[pattern]) * count
            hit = (8 * 0.85 + sums["+"][0]) / (8 + sums["+"][0] + sums["-"][0])
            miss = (8 * 0.85 + sums["-"][1]) / (8 + sums["+"][1] + sums["-"][1])
            rates[i] = (min(0.99, max(0.55, hit)), min(0.99, max(0.55, miss)))
    return prior, rates, posterior


def classifier(counts: list[tuple[str, int]], posterior: dict[str, float]) -> dict[tuple[int, str], float]:
    """Weights by (place, character) and (-1, '') for the bias, of a logistic model trained on the posteriors."""
    keys = [(-1, "")] + sorted({(i, c) for p, _ in counts for i, c in enumerate(p)})
    weights, total = dict.fromkeys(keys, 0.0), max(1, sum(math.sqrt(c) for _, c in counts))
    for _ in range(MAX_PROBABILITY_STEPS):
        grad = {k: 1e-3 * w for k, w in weights.items()}
        for pattern, count in counts:
            on = [(-1, ""), *enumerate(pattern)]
            error = 1 / (1 + math.exp(-sum(weights[k] for k in on))) - posterior[pattern]
            for k in on:
                grad[k] += error * math.sqrt(count) / total
        for k in weights:
            weights[k] -= 2.0 * grad[k]
    return weights


def train(found: DataFrame) -> dict[str, dict[tuple[int, str], float]]:
    """A classifier for each kind that has candidates; found comes from find()."""
    rows = found.where(F.size("p_more") > 0).select(F.explode("p_more").alias("m")).groupBy("m.kind", "m.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()  # bounded: vote patterns
    out = {}
    for kind in MORE_KINDS:
        counts = [(r["votes"], r["n"]) for r in rows if r["kind"] == kind]
        if counts:
            out[kind] = classifier(counts, reliabilities(counts)[2])
    return out


def probability(span: Column, models: dict[str, dict[tuple[int, str], float]]) -> Column:
    score = F.lit(-9.0)
    for kind, weights in models.items():
        terms = [F.lit(float(weights[(-1, "")]))]
        for place in sorted({i for i, _ in weights if i >= 0}):
            choice = F.lit(0.0)
            for (i, c), w in sorted(weights.items()):
                if i == place:
                    choice = F.when(F.substring(span["votes"], place + 1, 1) == c, F.lit(float(w))).otherwise(choice)
            terms.append(choice)
        score = F.when(span["kind"] == kind, reduce(lambda a, b: a + b, terms)).otherwise(score)
    return 1 / (1 + F.exp(-score))


OWN = (*(f"n_{k}" for k in BASE_KINDS), "base_spans", "pii_spans")


def annotate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, models: dict[str, dict[tuple[int, str], float]] | None = None) -> DataFrame:
    """The columns `keep` of docs (all of them unless given) with n_email, n_ip, n_card, n_phone, base_spans and pii_spans (array<struct<kind,start,end>>) put in.

    Spans are found once and kept as a table in the shared folder, from which the labelers' votes are
    counted and to which the classifier is applied. models are those of train() on another corpus, if given.
    """
    found = durable(find(docs, text, keep), "pii")
    models = train(found) if models is None else models
    named = lambda kind: F.transform(F.col(f"p_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*(named(k) for k in BASE_KINDS))

    def more(kind: str) -> Column:
        sure = F.filter("p_more", lambda s: (s["kind"] == kind) & (probability(s, {kind: models[kind]}) >= 0.5))
        return F.transform(sure, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return found.select("p_row.*", *(F.size(f"p_{k}").cast("bigint").alias(f"n_{k}") for k in BASE_KINDS), base.alias("base_spans"), F.concat(base, *(more(k) for k in MORE_KINDS if k in models)).alias("pii_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (or run of overlapping ones) as [KIND]."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    folded = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, folded).otherwise(text)
