"""Source divergence audit: how far the sources of a language lie apart in the terms they use.

Each language keeps the terms of at least MIN_DOCS of its documents. A group (language, source),
and the language as a whole, gives every kept term the smoothed share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)); two groups differ by the sum of
abs(p - q) over all V terms, most of which neither of the two may have.

1. Tasks count terms and documents of each (language, source) in memory and send the counts
   whenever they have gathered COUNTED of them; a shuffle adds them up to postings
   (language, term) -> (source, count). All counts and sums are integers.
2. Baseline: a group gives the terms it lacks one and the same share z, so a pair of groups
   starts at V * abs(z - z'), as if neither had any term.
3. Corrections of terms that one side has: they depend on the other side's z alone. A term adds
   p - z, less 2 * min(p - z, z' - z) where z' > z. The former is a number of the group; for
   the latter a window runs over the group's distinct shares with the others' z among them,
   so a group takes as many rows as it has distinct shares and peers, not their product.
4. Corrections of terms that both have: an equi-join of the postings on (language, term), which
   leaves out zeros and is summed by pair before the shuffle. Spark splits the posting lists of
   common terms when it finds them large.
5. Terms that a source uses above its language's share, and the pairs, are ranked by windows;
   of terms only the first TOP of each task reach the shuffle.

Defined results: null text, language and source are empty strings, and an empty string is a
language or source like any other; texts without terms still make their group; where no term
is kept (V = 0) all pairs have value 0; ties are ordered by the item's UTF-8 bytes; repeated
rows count as documents of their own; a long text is read in pieces, so only its distinct terms
are held at once; an empty table gives an empty one; only the three named columns are read, so
extra columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.llm.common import durable

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it sends them.
COUNTED = 200_000
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: A-Z lower-cased, a-z and all bytes of other scripts as they are, everything else a separator.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text with separators as spaces, in pieces that end between terms."""
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and TERM_BYTES[text[to]] != 32:
            to += 1
        yield text[at:to].translate(TERM_BYTES)
        at = to


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), summed over the corpus; a row without term for each group."""
    given = docs.select(docs[text].cast("binary").alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"))

    def rows(held: dict) -> pa.RecordBatch:
        every = [(*group, term, n, within.get(term, 0)) for group, (times, within) in held.items() for term, n in (*times.items(), (None, 0))]
        columns = list(zip(*every, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for body, *group in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                group = tuple(group)
                times, within = held.setdefault(group, (Counter(), Counter()))
                was, seen = len(times), set()
                for piece in _pieces(body.as_py() or b""):
                    terms = piece.split()
                    times.update(terms)
                    seen.update(terms)
                within.update(seen)
                size += len(times) - was
                if size > COUNTED:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)

    sent = given.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(PRIOR).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", over, wide(total + F.lit(PRIOR) * kept))


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, posts): groups (lang, source, kept, zero) with the number V of the language's kept terms and the share of a term that the group lacks; posts (lang, source, term, zero, p, q) of the kept terms that a group has, with the group's and the language's shares."""
    found = durable(counted(docs, text, lang, source), "terms")
    terms = found.where("term IS NOT NULL")
    kept = durable(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    own = durable(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = found.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", zero(F.col("kept")).alias("kept"), zero(F.col("total")).alias("total"), zero(F.col("lang_total")).alias("lang_total"))
    groups = durable(groups.withColumn("zero", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)), "groups")
    posts = own.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"))
    return groups.select("lang", "source", "kept", "zero"), durable(posts, "posts")


def pairs(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all a < b of a language: the summed difference over all its kept terms."""
    shares = durable(posts.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n")), "shares")
    gains = shares.groupBy("lang", "source").agg(F.sum("n").alias("has"), F.sum(F.col("n") * (F.col("p") - F.col("zero"))).alias("gain"))
    no = F.lit(0).cast("long")
    side = groups.join(gains, ["lang", "source"], "left").select("lang", "source", "kept", "zero", F.coalesce("has", no).alias("has"), F.coalesce("gain", no).alias("gain"))
    other = side.select("lang", F.col("source").alias("peer"), F.col("zero").alias("peer_zero"), F.col("gain").alias("peer_gain"))
    start = side.join(other, "lang").where("source < peer").select("lang", F.col("source").alias("a"), F.col("peer").alias("b"), (F.col("kept") * F.abs(F.col("zero") - F.col("peer_zero")) + F.col("gain") + F.col("peer_gain")).alias("value"))
    # what the group's terms below a peer's larger z, and the rest up to it, take back
    probes = side.where("has > 0").join(other, "lang").where("peer_zero > zero").select("lang", "source", "zero", "has", "peer", F.col("peer_zero").alias("at"), no.alias("n"))
    steps = shares.select("lang", "source", "zero", no.alias("has"), F.lit(None).cast("string").alias("peer"), F.col("p").alias("at"), "n")
    below = Window.partitionBy("lang", "source").orderBy("at", F.col("peer").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = probes.unionByName(steps).withColumns({"low": F.sum("n").over(below), "sum": F.sum(F.col("n") * (F.col("at") - F.col("zero"))).over(below)}).where("peer IS NOT NULL")
    back = run.select("lang", F.least("source", "peer").alias("a"), F.greatest("source", "peer").alias("b"), (-2 * (F.col("sum") + (F.col("at") - F.col("zero")) * (F.col("has") - F.col("low")))).alias("value"))
    x, y = posts.drop("q"), posts.select("lang", "term", F.col("source").alias("b"), F.col("zero").alias("b_zero"), F.col("p").alias("b_p"))
    both = x.join(y, ["lang", "term"]).where("source < b")
    gap = lambda s, t: F.abs(F.col(s) - F.col(t))
    met = both.select("lang", F.col("source").alias("a"), "b", (gap("p", "b_p") - gap("p", "b_zero") - gap("b_p", "zero") + gap("zero", "b_zero")).alias("value")).where("value <> 0")
    corrections = back.unionByName(met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    return start.unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to every other of its language (part pair) and the `top` terms it uses most above the language's share (part term)."""
    groups, posts = postings(docs, text, lang, source, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    half = pairs(groups, posts)
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = half.select("lang", ends.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(both).unionByName(ranked(above).where(F.col("rank") <= top))


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({SCALE}::HUGEINT * ({{n}} + {PRIOR})) // ({{total}} + {PRIOR} * kept)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS every FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {min_docs}),
l AS (SELECT lang, count(*) AS kept, sum(every)::BIGINT AS lang_total FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, l.kept, l.lang_total, coalesce(sum(n.n), 0)::BIGINT AS total FROM g JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(n.n, 0) AS n, {share.format(n="coalesce(n.n, 0)", total="total")} AS p, {share.format(n="every", total="lang_total")} AS q FROM s JOIN k USING (lang) LEFT JOIN n ON n.lang = s.lang AND n.source = s.source AND n.term = k.term),
v AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u) WHERE part = 'pair' OR rank <= {top}"""
