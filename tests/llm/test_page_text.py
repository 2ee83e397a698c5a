import html as entities
import random
import re

from weirloom.llm import page_text as pt


def plain(html):
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    article = re.sub(r"</?(?:p|br|h1|li|ul|div|blockquote|td|tr|table)\b[^>]*>", " ", article)
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", article)).split())


def test_articles_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = pt.extract(pages).collect()
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert len(got) == len(want) == 250
    for r in got:
        assert r["text"] == want[r["page_id"]]
        assert r["n_chars"] == len(r["text"])


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        shared = pt.common(a, b)
        picked = [x for x, s in zip(a, shared) if s]
        assert len(picked) == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in picked)


CASES = [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b &amp; c&nbsp;d<br>e", "a b & c d e"), ("<p>in<b>si</b>de <i>x</i></p>", "inside x"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><!-- no --><!-- open", "x"), ("<script><!-- </script><p>after</p>", "after"),
    ("<body><header>Site</header><nav>m</nav><main><h1>T</h1><div class='cookie-notice'>c</div><p>body</p><section id=comments><p>first!</p></section></main><aside>s</aside><footer>f</footer>", "T body"),
    ("<article class='post with-sidebar'><header><h1>T</h1></header><p>x</p><form><input><p>mail</p></form><footer>by</footer></article><article class=comment>nice</article>", "T x"),
    ("<div><div class=ad><div>buy</div>now</div>kept</div>", "kept"), ("5 < 6 > 2 <3", "5 < 6 > 2 <3"), ("<p title='a>b'>t</p><p hidden>h</p><p style='display:none'>n</p>", "t"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<p>&#x41;&#66;&unknown; &lt;b&gt;</p>", "AB&unknown; <b>"), ("<article><p>unclosed", "unclosed"),
]


def test_markup(spark):
    rows = [(i, f"http://h{i}.test/", h) for i, (h, _) in enumerate(CASES)]
    got = {r["page_id"]: r["text"] for r in pt.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (h, want) in enumerate(CASES):
        assert got[i] == want, h


def test_lines_shared_with_the_nearest_page_go(spark):
    page = "<div>Menu of the site</div><div>{}</div><div>All rights reserved</div>"
    rows = [(i, f"https://a.test/x/{i}", page.format(f"story {i}")) for i in range(40)] + [(99, "https://b.test/x/1", page.format("alone")), (99, None, page.format("no url"))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "rid")
    got = sorted((r["rid"], r["text"]) for r in pt.extract(docs).collect())
    assert got[:40] == [(i, f"story {i}") for i in range(40)]
    assert got[40:] == [(99, "Menu of the site alone All rights reserved"), (99, "Menu of the site no url All rights reserved")]
    assert pt.extract(docs.limit(0)).count() == 0


def served(i, query=""):
    """A page whose container holds lines that only differencing can tell from the article, and a passage that neighbours quote."""
    return (
        "<div>The strapline of the site</div><main><div>Share this story</div><h1>Title %d</h1><p>Body of story %d%s.</p><p>A passage that all of them quote.</p>"
        "<p><a href='/a'>More from our desk</a></p><ul><li>point %d</ul><div>Rate this page</div></main><div>Last words of %d</div>" % (i, i, query, i, i)
    )


def expected(i, query=""):
    return f"Title {i} Body of story {i}{query}. A passage that all of them quote. point {i} Last words of {i}"


def test_differencing_decides_in_and_around_containers(spark, monkeypatch):
    rows = [(i, f"https://a.test/x/{i}", served(i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in pt.extract(docs).collect()}
    assert texts() == {i: expected(i) for i in range(30)}
    for constant in (False, True):
        monkeypatch.setattr(pt, "common", lambda a, b, constant=constant: [constant] * len(a))
        got = texts()
        assert all(got[i] != expected(i) for i in range(30))
        assert all("Share this story" in got[i] for i in range(30))  # all shared: every neighbour passes for a copy


def test_near_copies_are_no_pairs(spark):
    body = "".join(f"<p>Paragraph {k} of the one story.</p>" for k in range(12))
    page = "<div>Strapline</div><div>{}</div><div>All rights reserved</div>"
    rows = [(1, "https://a.test/s/10", page.format(body)), (2, "https://a.test/s/10?print=1", page.format(body + "<p>Printed</p>")), (3, "https://a.test/s/2", page.format("<p>Another story</p>"))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pt.extract(docs).collect()}
    story = " ".join(f"Paragraph {k} of the one story." for k in range(12))
    assert got == {1: story, 2: story + " Printed", 3: "Another story"}
    two = pt.extract(docs.where("page_id < 3")).collect()
    assert all(story in r["text"] for r in two)  # no pair but the copy: nothing is deleted


def test_pages_that_repeat_often(spark):
    rows = [(i, "https://a.test/hot", served(7)) for i in range(3000)] + [(9000 + i, f"https://a.test/x/{i}", served(i)) for i in range(20)] + [(9999, None, None)]
    got = pt.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert len(got) == 3021
    assert all(r["text"] == (expected(7) if r["page_id"] < 3000 else "" if r["page_id"] == 9999 else expected(r["page_id"] - 9000)) for r in got)


def test_pairs_across_tasks(spark):
    from weirloom.llm.common import durable
    from pyspark.sql import functions as F

    n = 23
    light = spark.createDataFrame([(f"h{i // 10}", f"/{i:03d}", i, [i], [1]) for i in range(n)], "host string, path string, rid long, prints array<long>, sizes array<int>")
    for cuts in ([], [1, 2, 3], [5, 10, 11], list(range(1, n))):
        part = sum((F.when(F.col("rid") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        got = {r["rid"]: r for r in pt.neighbours(durable(light.withColumn("part", part), "t")).collect()}
        for i in range(n):
            same = lambda ids: [x for x in ids if 0 <= x < n and x // 10 == i // 10]
            assert [x["prints"][0] for x in got[i]["before"]] == same([i - 2, i - 1]), (cuts, i)
            assert [x["prints"][0] for x in got[i]["after"]] == same([i + 1, i + 2]), (cuts, i)
