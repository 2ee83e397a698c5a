"""HTML extraction: nearest-URL page differencing.

1. Each page becomes text lines, one for each block, with what the markup says about them:
   BOILERPLATE (menus, site headers and footers, sidebars, notices, adverts, forms, reader
   comments), PROSE (a heading, paragraph, list item, quotation or table cell of an article
   container, not mostly links), CONTAINED (else in such a container), or OUTSIDE.
2. Pages sort by host, path and content, equal pages (url and html) once. A page's candidates
   are the REACH pages before and after it on the same host; its pair is the one with the
   longest common prefix of paths, the nearer and then the earlier one if equal, that is not
   a near copy: one whose shared lines make NEAR_COPY of the lines and of the characters of
   the larger page. Copies would share the article. The sort is by range, so a host of any
   size spreads over tasks; what lies across a border is looked up in a table with a row per
   task.
3. The lines of a pair are aligned by longest common subsequence (bit-parallel, after common
   heads and tails). Lines in it are shared, and are deleted: this decides every line, but for
   two vetoes. Shared PROSE stays, since neighbours quote the same passages. Unshared
   BOILERPLATE goes, since menus, adverts, forms and comments also differ between neighbours.
   Without a pair nothing is shared.

White space is what Unicode calls so. Only 64-bit line fingerprints and lengths travel to the
sort, and a bit for each line comes back; the lines themselves travel once, compressed. A page
with a thousandth of all rows or more is dealt over SALTS keys.

Defined results: null or empty html gives an empty text; a null url has an empty host and
path; repeated rows get equal texts; markup that is cut off or badly nested is read as far
as it goes; an empty table gives an empty one; other columns than the html are kept, those
with the names of the result's (text, n_chars) are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirloom.llm.common import durable, slices
from weirloom.llm.url_rules import parts

#: Elements whose content is never text of the page.
SILENT = frozenset("head title script style noscript template svg math iframe object embed canvas audio video select option datalist button textarea map dialog".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that end an open paragraph, and what else ends by a sibling's start.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id or role that name boilerplate.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice alert popup modal overlay footer masthead topbar "
    "comment comments disqus respond reply replies newsletter subscribe signup login search form widget related recommended share sharing social toolbar pagination pager skip complementary contentinfo".split()
)
#: Of these, what names an article element that is not the article; and what turns a name around (no-sidebar).
NAMED_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())
NEGATED = ("no", "not", "with", "without", "has", "non", "is")
CONTAINERS = ("article", "main")
#: Elements whose text is prose where a container holds them.
PROSE_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
OUTSIDE, BOILER, CONTAINED, PROSE = range(4)
REACH = 2
NEAR_COPY = 0.8
#: Pages with this share of all rows, one over MOST_OFTEN, or more are dealt over SALTS keys.
MOST_OFTEN, SALTS = 1000, 64
CONTAINER_NAMES = frozenset("articlebody".split())

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?))", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s>=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def lines(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order; kind: OUTSIDE, BOILER, CONTAINED or PROSE."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # element, its kind
    kind, silent, at = OUTSIDE, 0, 0  # silent: depth of the stack at which silence began, or 0
    linked = 0  # characters held from within links

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join(entities.unescape(raw).split())
            if text:
                block = next((s[0] for s in reversed(stack) if s[0] in BLOCKS), "") if kind == CONTAINED else ""
                out.append((text, PROSE if block in PROSE_ELEMENTS and 2 * linked < len(raw) else kind))
            held.clear()
        linked = 0

    def hold(piece: str) -> None:
        nonlocal linked
        held.append(piece)
        if any(s[0] == "a" for s in stack[-3:]):
            linked += len(piece)

    def pop(to: int) -> None:
        nonlocal kind, silent
        del stack[to:]
        kind = stack[-1][1] if stack else OUTSIDE
        if silent and len(stack) < silent:
            silent = 0

    while m := _TAG.search(html, at):
        if m.start() > at and not silent:
            hold(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        rest = m[3]
        if name in BLOCKS:
            flush()
            if stack and name != "br" and any(s[0] == "p" for s in stack[-4:]):
                i = max(i for i in range(len(stack)) if stack[i][0] == "p")
                if not any(s[0] in BLOCKS for s in stack[i + 1 :]):
                    pop(i)
            for other in CLOSES.get(name, ()):
                for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[i][0] in ("ul", "ol", "dl", "table"):
                        break
                    if stack[i][0] == other:
                        pop(i)
                        break
        if name in VOID or rest.endswith("/>") and name in ("svg", "iframe", "script"):
            continue
        own = kind
        if name in CONTAINERS and kind != BOILER:
            own = CONTAINED
        if name in BOILERPLATE or name == "header" and kind != CONTAINED:
            own = BOILER
        elif rest != ">" and own != BOILER:
            words: set[str] = set()
            for a in _NAMES.finditer(rest[:-1]):
                for one in (a[2] or a[3] or a[4] or "").lower().split():
                    found = _WORD.findall(one)
                    words.update(found if found and found[0] not in NEGATED else ())
            if words & (NAMED_ARTICLES if name in CONTAINERS else NAMED) and name not in ("html", "body"):
                own = BOILER
            elif words & CONTAINER_NAMES:
                own = CONTAINED
        stack.append((name, own))
        if not silent and (name in SILENT or rest != ">" and _HIDDEN.search(rest[:-1])):
            silent = len(stack)
        kind = own
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
    if at < len(html) and not silent:
        hold(html[at:])
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[bool]:
    """Whether each element of a is in a longest common subsequence with b."""
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    shared = [True] * head + [False] * (n - head - tail) + [True] * tail
    there = set(b[head : m - tail])
    left = [i for i in range(head, n - tail) if a[i] in there]
    if not left:
        return shared
    mine = {a[i] for i in left}
    right = [x for x in b[head : m - tail] if x in mine]
    places: dict[int, int] = {}
    for j, x in enumerate(right):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, [full]
    for i in left:
        u = row & places[a[i]]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(left), len(right)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            shared[left[i - 1]] = True
            i, j = i - 1, j - 1
    return shared


Side = dict  # path, prints and sizes of a page


def shared_lines(own: Side, before: list[Side], after: list[Side]) -> list[bool]:
    """Step 2's choice among the pages before (nearest last) and after (nearest first) on the host, and step 3's alignment with it."""
    candidates = [(side, distance, late) for late, sides in enumerate((before[::-1], after)) for distance, side in enumerate(sides)]
    candidates.sort(key=lambda c: (-len(os.path.commonprefix([own["path"], c[0]["path"]])), c[1], c[2]))
    for side, _, _ in candidates:
        shared = common(own["prints"], side["prints"])
        n, size = sum(shared), sum(x for x, s in zip(own["sizes"], shared, strict=True) if s)
        if n < NEAR_COPY * max(len(shared), len(side["prints"])) or size < NEAR_COPY * max(sum(own["sizes"]), sum(side["sizes"])):
            return shared
    return [False] * len(own["prints"])


def text_of(own: list[tuple[str, int]], shared: list[bool]) -> str:
    """The lines that differencing leaves, after the markup's two vetoes, joined."""
    return " ".join(text for (text, kind), s in zip(own, shared, strict=True) if kind != BOILER and (kind == PROSE or not s))


def _print(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(rows: DataFrame, payload: bool) -> DataFrame:
    """Of each page its keys with the fingerprints and lengths of its lines, or (payload) its row with the lines that may stay."""
    fields = [rows.schema[c] for c in (("h_row", "rid") if payload else ("host", "path", "rid"))]
    more = [T.StructField("packed", T.BinaryType())] if payload else [T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
    out = T.StructType(fields + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "h_html"):
                found = [lines(h or "") for h in part.column("h_html").to_pylist()]
                columns = [part.column(f.name) for f in fields]
                if payload:
                    kept = [[["" if k == BOILER else t, k] for t, k in f] for f in found]
                    columns.append(pa.array([zlib.compress(json.dumps(f, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 6) for f in kept], pa.binary()))
                else:
                    columns.append(pa.array([[_print(t) for t, _ in f] for f in found], pa.list_(pa.int64())))
                    columns.append(pa.array([[len(t) for t, _ in f] for f in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.select(*(f.name for f in fields), "h_html").mapInArrow(run, out)


def neighbours(ranged: DataFrame) -> DataFrame:
    """Rows (rid, path, prints, sizes, before, after) of distinct pages (host, path, rid, prints, sizes, part), part being their range: before and after hold up to REACH pages of the same host."""
    order = ["host", "path", "rid"]
    side = F.struct("host", "path", "prints", "sizes")
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumns({"before": F.collect_list(side).over(within.rowsBetween(-REACH, -1)), "after": F.collect_list(side).over(within.rowsBetween(1, REACH))})
    # the first and last REACH pages of each task, and of the REACH tasks around it: each has a page or more
    up, down = F.row_number().over(within), F.row_number().over(Window.partitionBy("part").orderBy(*(F.desc(c) for c in order)))
    edges = ranged.withColumns({"up": up, "down": down}).where(f"up <= {REACH} OR down <= {REACH}")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= REACH, F.struct("up", side.alias("side"))))), lambda x: x["side"])
    ends = edges.groupBy("part").agg(listed("up").alias("first"), listed("down").alias("last"))
    across = Window.orderBy("part")  # a row for each task of the sort
    ends = ends.select("part", F.flatten(F.collect_list("last").over(across.rowsBetween(-REACH, -1))).alias("above"), F.flatten(F.collect_list("first").over(across.rowsBetween(1, REACH))).alias("below"))
    placed = placed.join(ends, "part")
    own = lambda sides: F.transform(F.filter(sides, lambda x: x["host"] == F.col("host")), lambda x: F.struct(x["path"].alias("path"), x["prints"].alias("prints"), x["sizes"].alias("sizes")))
    before, after = F.concat("above", "before"), F.concat("after", "below")
    start = F.greatest(F.lit(1), F.size(before) - REACH + 1)
    return placed.select("rid", "path", "prints", "sizes", own(F.slice(before, start, F.lit(REACH))).alias("before"), own(F.slice(after, F.lit(1), F.lit(REACH))).alias("after"))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for r in batch.select(["path", "prints", "sizes", "before", "after"]).to_pylist():
            masks.append(np.packbits(np.array(shared_lines(r, r["before"], r["after"]), bool)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(masks, pa.binary())], ["rid", "mask"])


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The columns of pages but the html, with text and n_chars."""
    keep = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    host, path = parts(pages[url])
    rows = pages.select(F.struct(*(pages[c] for c in keep)).alias("h_row"), host.alias("host"), path.alias("path"), F.xxhash64(pages[url], pages[html]).alias("rid"), pages[html].alias("h_html"))
    light = _parsed(rows, False).groupBy("host", "path", "rid").agg(F.first("prints").alias("prints"), F.first("sizes").alias("sizes"), F.count("*").alias("n"))
    count = max(2, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(light.repartitionByRange(count, "host", "path", "rid").withColumn("part", F.spark_partition_id()), "pages")
    masks = neighbours(ranged).mapInArrow(_masks, "rid long, mask binary").groupBy("rid").agg(F.first("mask").alias("mask"))
    total = ranged.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(ranged.where(F.col("n") * MOST_OFTEN >= total).select("rid", F.lit(True).alias("often")))  # MOST_OFTEN rows at most
    salt = lambda which: F.when(F.col("often"), which).otherwise(F.lit(0))
    dealt = masks.join(often, "rid", "left").select("rid", "mask", F.explode(F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))).alias("salt"))
    texts = _parsed(rows, True).join(often, "rid", "left").withColumn("salt", salt(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    whole = T.StructType([rows.schema["h_row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, mask in zip(batch.column("packed").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                own = [(t, k) for t, k in json.loads(zlib.decompress(packed))]
                texts.append(text_of(own, np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("h_row"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], whole.names)

    return texts.join(dealt, ["rid", "salt"]).select("h_row", "packed", "mask").mapInArrow(finish, whole).select("h_row.*", "text", "n_chars")
