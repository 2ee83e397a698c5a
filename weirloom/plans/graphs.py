"""Graph and wiki queries: entity graphs over orders and parts, call chains, code items, page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirloom.functions import text as T
from weirloom.operators import graph as G
from weirloom.operators import postings
from weirloom.operators import retrieve as R
from weirloom.plans.registry import query, table
from weirloom.sources.sinks import durable

# customers are nodes; a customer's neighbours are the next by key, and the fifth one after it if it is of the same segment
_NODES = "nodes AS (SELECT c_name AS name, c_mktsegment AS type, c_custkey AS ord FROM customer)"
_EDGES = "edges AS (SELECT a.c_name AS src, b.c_name AS dst, 'NEXT' AS type FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 UNION ALL SELECT a.c_name, b.c_name, 'PEER' FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 5 AND a.c_mktsegment = b.c_mktsegment)"
_ASKED = "q AS (SELECT n_nationkey AS query_id, 'Customer#' || lpad((n_nationkey * 7 + 3)::varchar, 9, '0') || CASE WHEN n_nationkey % 2 = 0 THEN ' and more' ELSE '' END AS entity FROM nation), found AS (SELECT q.query_id, q.entity, n.name FROM q JOIN nodes n ON (contains(lower(q.entity), lower(n.name)) OR contains(lower(n.name), lower(q.entity))) AND length(q.entity) >= 2 AND length(n.name) >= 2)"
_BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("ord"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    a, b = n.alias("a"), n.alias("b")
    next_ = a.join(b, F.col("b.ord") == F.col("a.ord") + 1).select(F.col("a.name").alias("src"), F.col("b.name").alias("dst"), F.lit("NEXT").alias("type"))
    peers = a.join(b, (F.col("b.ord") == F.col("a.ord") + 5) & (F.col("a.type") == F.col("b.type"))).select(F.col("a.name").alias("src"), F.col("b.name").alias("dst"), F.lit("PEER").alias("type"))
    return next_.union(peers)


_DEGREE = "ends AS (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT n.name, count(e.name) AS degree FROM nodes n LEFT JOIN ends e ON e.name = n.name GROUP BY n.name)"


@query("a3_degree", f"WITH {_NODES}, {_EDGES}, {_DEGREE} SELECT name, degree FROM deg")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(nodes(spark, sf), edges(spark, sf))


@query("t10_degree_subgraph", f"WITH {_NODES}, {_EDGES}, {_DEGREE}, top AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 40) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, type FROM edges WHERE src IN (SELECT name FROM top) AND dst IN (SELECT name FROM top) AND src <> dst ORDER BY 1, 2, 3 LIMIT 80")
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_subgraph(nodes(spark, sf), edges(spark, sf), 40)[1]


@query("a17_node_merge", "SELECT p_brand AS name, min_by(p_type, p_partkey) AS type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS chunks, count(DISTINCT p_name) AS n_attributes FROM part GROUP BY p_brand")
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("chunk"), F.col("p_name").alias("attribute"), F.col("p_partkey").alias("ord"))
    return G.merge_nodes(raw).select("name", "type", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"), F.size("attributes").cast("long").alias("n_attributes"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, entity, name): the nodes that queries name, one query for each nation."""
    entity = F.concat(F.lit("Customer#"), F.lpad((F.col("n_nationkey") * 7 + 3).cast("string"), 9, "0"), F.when(F.col("n_nationkey") % 2 == 0, " and more").otherwise(""))
    return G.entity_matches(table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), entity.alias("entity")), nodes(spark, sf))


@query("j8_entity_search", f"WITH {_NODES}, {_ASKED} SELECT query_id, entity, name FROM found")
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf)


@query("j9_undirected_edges", f"WITH {_NODES}, {_EDGES} SELECT name, type, count(*) AS n FROM (SELECT src AS name, type FROM edges UNION ALL SELECT dst, type FROM edges) GROUP BY ALL")
def undirected(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(edges(spark, sf)).groupBy(F.col("src").alias("name"), "type").agg(F.count("*").alias("n"))


_HOPS = "h1 AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'NEXT'), h2 AS (SELECT DISTINCT a.src, b.dst FROM h1 a JOIN h1 b ON a.dst = b.src), h3 AS (SELECT DISTINCT a.src, b.dst FROM h2 a JOIN h1 b ON a.dst = b.src)"


@query("j10_call_chain", f"WITH {_NODES}, {_EDGES}, {_HOPS} SELECT src, dst FROM (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3) WHERE contains(src, '00010')")
def call_chain(spark: SparkSession, sf: str) -> DataFrame:
    start = nodes(spark, sf).where(F.contains("name", F.lit("00010"))).select("name")
    return G.within_hops(edges(spark, sf).where("type = 'NEXT'"), start, 3)


@query("j11_edge_materialisation", f"WITH {_NODES}, {_EDGES} SELECT e.src, e.dst, e.type FROM edges e JOIN nodes a ON a.name = e.src JOIN nodes b ON b.name = e.dst WHERE a.type = 'BUILDING'")
def materialised(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    left = n.where("type = 'BUILDING'").select(F.col("name").alias("src"))
    return edges(spark, sf).join(left, "src").join(n.select(F.col("name").alias("dst")), "dst").select("src", "dst", "type")


@query("q7_type_filter", f"WITH {_NODES}, {_EDGES}, {_ASKED}, {_BOTH} SELECT n.name, n.type FROM nodes n WHERE (n.name IN (SELECT name FROM found) AND n.type IN ('BUILDING', 'MACHINERY')) OR n.name IN (SELECT b.dst FROM both_ways b JOIN found f ON f.name = b.src)")
def type_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Only nodes that were asked for are filtered by type; neighbours of any type stay."""
    n, names = nodes(spark, sf).select("name", "type"), asked(spark, sf).select("name").distinct()
    own = n.join(names, "name", "left_semi").where(F.col("type").isin("BUILDING", "MACHINERY"))
    near = G.neighbours(edges(spark, sf)).join(names.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name")).distinct()
    return own.union(n.join(near, "name", "left_semi")).distinct()


@query("q6_graph_retrieve", f"WITH {_NODES}, {_EDGES}, {_ASKED}, {_BOTH}, x AS (SELECT DISTINCT f.query_id, b.dst AS name FROM found f JOIN both_ways b ON b.src = f.name), y AS (SELECT x.query_id, x.name, n.ord, row_number() OVER (PARTITION BY x.query_id ORDER BY x.name) AS rank FROM x JOIN nodes n ON n.name = x.name) SELECT query_id, string_agg(name, '; ' ORDER BY name) AS context, string_agg(ord::varchar, ',' ORDER BY name) AS chunks FROM y WHERE rank <= 3 GROUP BY query_id")
def graph_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """From the entities of a query to their neighbours: the first three by name as context, and the chunks that mention them."""
    from weirloom.operators.retrieve import top

    start = asked(spark, sf).select("query_id", F.col("name").alias("src"))
    near = G.neighbours(edges(spark, sf)).join(start, "src").select("query_id", F.col("dst").alias("name")).distinct()
    first = top(near.join(nodes(spark, sf).select("name", "ord"), "name"), 3, ["query_id"], F.asc("name"))
    rows = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("name", "ord"))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["name"]), "; ").alias("context"), F.array_join(F.transform("x", lambda x: x["ord"].cast("string")), ",").alias("chunks"))


@query("a6_overview", f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes WHERE type IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY type")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where(F.col("type").isin("BUILDING", "FURNITURE", "MACHINERY")).groupBy("type").agg(F.count("*").alias("n"))


@query("t12_symbol_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('A')) ORDER BY p_size, p_partkey LIMIT 20")
def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("A")))).orderBy("p_size", "p_partkey").limit(20).select("p_partkey", "p_name")


CODE = [
    ("a.py", "import os\nfrom b import helper\n\nclass Base:\n    def run(self):\n        return helper(os.getcwd())\n\nclass Child(Base):\n    def go(self):\n        self.run()\n\ndef main():\n    Child().go()\n"),
    ("b.go", "package b\n\nimport (\n\t\"fmt\"\n)\n\ntype Server struct{}\n\nfunc (s *Server) Listen(p int) {\n\tfmt.Println(p)\n\ts.accept()\n}\n\nfunc New() *Server {\n\treturn &Server{}\n}\n"),
    ("c.ts", "import { x } from './x'\nexport class View extends Base {\n}\nexport function show(a) {\n  render(a)\n}\nconst fast = (b) => draw(b)\n"),
]


@query("g1_code_entities")
def code_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.code_graph(spark.createDataFrame(CODE, "source string, content string"))


@query("t13_grep", r"""WITH f AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents), l AS (SELECT path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM f WHERE regexp_matches(path, '^en/src1[^/]*/.*\.txt$') AND octet_length(encode(text)) <= 6000),
m AS (SELECT path, line_no, left(line, 200) AS line FROM l WHERE regexp_matches(line, '(?i)thnt') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 5), t AS (SELECT * FROM m ORDER BY path, line_no LIMIT 50)
SELECT path, line_no, line FROM (SELECT *, sum(octet_length(encode(line))) OVER (ORDER BY path, line_no) AS spent FROM t) WHERE spent <= 3000""")
def grep(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the files of a glob, small files only, a few of each, within a budget."""
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return G.grep(table(spark, sf, "documents").select(path.alias("path"), "text"), "(?i)thnt", "en/src1*/**.txt", 6000, 5, 50, 3000)


@query("t14_find", "SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^/(en|fr)/8[^/]*$') OR contains(lower(path), '99') ORDER BY page_id LIMIT 30")
def find(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"))
    return rows.where(F.col("path").rlike("^/(en|fr)/8[^/]*$") | F.contains(F.lower("path"), F.lit("99"))).orderBy("page_id").limit(30)


@query("t15_read", "WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'docs/../' ELSE 'docs/' END || page_id || '.txt' AS path FROM pages) SELECT r.page_id, r.path, CASE WHEN contains(r.path, '..') THEN 'denied' WHEN d.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status, left(d.text, 2000) AS content FROM r LEFT JOIN documents d ON NOT contains(r.path, '..') AND 'docs/' || d.doc_id || '.txt' = r.path")
def read(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each request, its first 2,000 characters; paths that climb are denied. Requests come from the pages table."""
    path = F.concat(F.when(F.col("page_id") % 7 == 0, "docs/../").otherwise("docs/"), F.col("page_id").cast("string"), F.lit(".txt"))
    return G.read_files(table(spark, sf, "pages").select("page_id", path.alias("path")), table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"), 2000)


# --- wiki: a page for each document, with links to the next one and the third after it ---------

_PAGES = "wp AS (SELECT doc_id AS id, lang AS kb, lang || '/' || doc_id || '.md' AS path, text AS content, 'see [[' || lang || '/' || (doc_id + 1) || ']] and [[' || lang || '/' || (doc_id + 3) || '|next]]' AS links FROM documents)"
_LINKS = "wl AS (SELECT id, kb, kb || '/' || (id + 1) || '.md' AS target_path FROM wp UNION SELECT id, kb, kb || '/' || (id + 3) || '.md' FROM wp)"


def wiki(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = lambda k: (F.col("doc_id") + k).cast("string")
    body = F.concat(F.lit("see [["), "lang", F.lit("/"), n(1), F.lit("]] and [["), "lang", F.lit("/"), n(3), F.lit("|next]]"))
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kb"), F.concat("lang", F.lit("/"), n(0), F.lit(".md")).alias("path"), F.col("text").alias("content"), body.alias("links"))
    return pages, pages.select("id", "kb", F.explode(T.wiki_links(F.col("links"))).alias("target_path"))


@query("j4_link_resolution", f"WITH {_PAGES}, {_LINKS} SELECT l.id, l.target_path, p.id AS target_id FROM wl l LEFT JOIN wp p ON p.kb = l.kb AND p.path = l.target_path")
def link_resolution(spark: SparkSession, sf: str) -> DataFrame:
    pages, links = wiki(spark, sf)
    target = pages.select("kb", F.col("path").alias("target_path"), F.col("id").alias("target_id"))
    return links.join(target, ["kb", "target_path"], "left").select("id", "target_path", "target_id")


@query("j1_one_hop", f"WITH {_PAGES}, {_LINKS} SELECT l.id, p.id AS linked, p.path FROM wl l JOIN wp p ON p.kb = l.kb AND p.path = l.target_path")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    found = link_resolution(spark, sf).where("target_id IS NOT NULL")
    return found.select("id", F.col("target_id").alias("linked"), F.col("target_path").alias("path"))


_CUT = "regexp_replace(regexp_replace(lower(w), '^[{m}]+', ''), '[{m}]+$', '')".format(m="".join(("''" if m == "'" else "\\" + m) if ord(m) < 128 else m for m in T.SEARCH_PUNCTUATION))
_HITS = f"""kw AS (SELECT item_id AS query_id, list_distinct(list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: {_CUT}), lambda w: octet_length(encode(w)) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in T.SEARCH_STOP_WORDS)}))) AS kw FROM benchmark),
kk AS (SELECT query_id, unnest(kw) AS k FROM kw), wt AS (SELECT id, k, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{Nd}}]+')) AS k FROM wp) WHERE k <> '' GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM kk), kv AS MATERIALIZED (SELECT wp.kb, wp.id, ks.k, 0.1 * contains(lower(content), ks.k)::INT + 0.3 * contains(lower(path), ks.k)::INT + coalesce(wt.n / (1.0 + wt.n), 0)::DOUBLE AS worth FROM wp CROSS JOIN ks LEFT JOIN wt ON wt.id = wp.id AND wt.k = ks.k),
hits AS MATERIALIZED (SELECT * FROM (SELECT query_id, kb, id, score, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) AS rank FROM (SELECT query_id, kb, id, round(sum(worth), 9) AS score FROM kk JOIN kv USING (k) GROUP BY ALL HAVING sum(worth) > 0)) WHERE rank <= 5)"""


def wiki_hits(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, kb, doc_id, score, rank): what each benchmark row finds in each base."""
    pages, _ = wiki(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.search_keywords(F.col("text")).alias("keywords"))
    bases = pages.select("kb").distinct()
    given = R.spread(pages.select(F.col("id").alias("doc_id"), "kb", F.col("path").alias("title"), "content"))
    return postings.rank_any(asked.join(R.bounded(bases)), given, 5)


@query("q5_wiki_search", f"WITH {_PAGES}, {_HITS} SELECT query_id, kb, id, round(score, 6) AS score, rank FROM hits")
def wiki_search(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with any keyword of the query, by places as a term, with a bonus for keywords in the content and a larger one in the path."""
    return wiki_hits(spark, sf).select("query_id", "kb", F.col("doc_id").alias("id"), F.round("score", 6).alias("score"), "rank")


@query("u2_hits_then_links", f"WITH {_PAGES}, {_LINKS}, {_HITS}, x AS (SELECT h.query_id, h.kb, p.id, 1 AS o FROM wl l JOIN hits h ON h.id = l.id JOIN wp p ON p.kb = l.kb AND p.path = l.target_path), u AS (SELECT query_id, kb, id, min(o) AS o FROM (SELECT query_id, kb, id, 0 AS o FROM hits UNION ALL SELECT * FROM x) GROUP BY ALL) SELECT query_id, kb, id, o FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kb ORDER BY o, id) AS n FROM u) WHERE n <= 14")
def hits_then_links(spark: SparkSession, sf: str) -> DataFrame:
    """What the wiki search finds, then the pages that these link to."""
    hits = durable(wiki_hits(spark, sf).select("query_id", "kb", F.col("doc_id").alias("id"), F.lit(0).alias("o")))
    linked = link_resolution(spark, sf).where("target_id IS NOT NULL").join(hits.select("query_id", "kb", "id"), "id").select("query_id", "kb", F.col("target_id").alias("id"), F.lit(1))
    firsts = hits.union(linked).groupBy("query_id", "kb", "id").agg(F.min("o").alias("o"))
    return R.top(firsts, 14, ["query_id", "kb"], F.asc("o"), F.asc("id")).select("query_id", "kb", "id", "o")


#: Lines of an index that one row joins before the rows of a base are joined.
INDEX_LINES = 10_000


def index_blocks(pages: DataFrame) -> DataFrame:
    """(kb, block, lines): the paths of each base once and in order, INDEX_LINES to a row."""
    paths = pages.where("path IS NOT NULL").select("kb", "path").distinct()
    block = F.floor((F.col("n") - 1) / INDEX_LINES).alias("block")
    return R.numbered(paths, ["kb"], "path").groupBy("kb", block).agg(F.expr(r"listagg(path, '\n') WITHIN GROUP (ORDER BY n)").alias("lines"))


@query("q23_wiki_compile", f"WITH {_PAGES}, {_LINKS} SELECT w.kb, count(DISTINCT w.id) AS n_pages, count(l.target_path) AS n_links, count(p.id) AS n_resolved, string_agg(DISTINCT w.path, chr(10) ORDER BY w.path) AS index FROM wp w JOIN wl l ON l.id = w.id LEFT JOIN wp p ON p.kb = l.kb AND p.path = l.target_path GROUP BY w.kb")
def wiki_compile(spark: SparkSession, sf: str) -> DataFrame:
    """Each base's pages, links and resolved links, and its index page: one text, joined from blocks of lines. Pages without links count, repeated ones once."""
    pages, _ = wiki(spark, sf)
    links = pages.select("id", "kb", F.explode_outer(T.wiki_links(F.col("links"))).alias("target_path")).distinct()
    target = pages.select("kb", F.col("path").alias("target_path"), F.col("id").alias("target_id"))
    found = links.join(target, ["kb", "target_path"], "left").groupBy("id").agg(F.count("target_path").alias("n"), F.count("target_id").alias("r"))
    counts = pages.join(found, "id").groupBy("kb").agg(F.count_distinct("id").alias("n_pages"), F.sum("n").alias("n_links"), F.sum("r").alias("n_resolved"))
    # a union, since a join could broadcast the texts
    rows = counts.unionByName(index_blocks(pages), allowMissingColumns=True).groupBy("kb")
    return rows.agg(*(F.max(c).alias(c) for c in ("n_pages", "n_links", "n_resolved")), F.expr(r"listagg(lines, '\n') WITHIN GROUP (ORDER BY block)").alias("index"))


@query("q23_wiki_index", f"WITH {_PAGES} SELECT kb, row_number() OVER (PARTITION BY kb ORDER BY path) AS place, '- [[' || path || ']]' AS line FROM wp")
def wiki_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index page of each base, a row a line in order of paths: a base may have any number of pages."""
    pages, _ = wiki(spark, sf)
    lines = R.numbered(pages.select("kb", "path"), ["kb"], "path")
    return lines.select("kb", F.col("n").alias("place"), F.concat(F.lit("- [["), "path", F.lit("]]")).alias("line"))
