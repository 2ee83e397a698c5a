"""Sources: text and binary files as documents, parsers of HTML, DOCX and PDF, evaluation files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirloom.functions.text import trimmed

TEXT_SUFFIXES = "txt,md,markdown,rst,log"
CODE_SUFFIXES = "py,ts,tsx,js,jsx,go"
#: Fixed value: folders that a code walk passes over, beside hidden ones.
SKIPPED_FOLDERS = ["node_modules", "vendor", "dist", "build", "__pycache__", "target"]


def document_id(path: Column) -> Column:
    """The first eight bytes of the path's MD5, in hexadecimal."""
    return F.substring(F.md5(path), 1, 16)


def text_files(spark: SparkSession, folder: str, suffixes: str = TEXT_SUFFIXES) -> DataFrame:
    """id, source and content of every text file below a folder; others and unreadable ones are passed over."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").option("ignoreCorruptFiles", "true").text(folder, wholetext=True)
    return rows.select(document_id(F.input_file_name()).alias("id"), F.input_file_name().alias("source"), trimmed(F.col("value")).alias("content"))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """id (the base name) and content of every .txt below a folder, by id."""
    rows = text_files(spark, folder, "txt")
    return rows.select(F.regexp_extract("source", r"([^/]+)\.txt$", 1).alias("id"), "content").orderBy("id")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_files(spark, folder, CODE_SUFFIXES)
    skipped = "|".join(SKIPPED_FOLDERS)
    return rows.where(~F.col("source").rlike(rf"/(?:\.[^/]+|{skipped})/"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.in_title = 0, False
        self.title: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "noscript", "svg")
        self.in_title = self.in_title or tag == "title"
        self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= self.skip > 0 and tag in ("script", "style", "noscript", "svg")
        self.in_title = self.in_title and tag != "title"
        self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


def parse_html(html: str) -> tuple[str, str]:
    """(title, text) with white space normalised; scripts, styles and drawings are left out."""
    reader = _Text()
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.title).split()), " ".join("".join(reader.parts).split())


def parse_docx(data: bytes) -> str:
    """Paragraphs and rows as lines, cells and tabs as tabs."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            name = node.tag.rpartition("}")[2]
            if event == "end" and name == "t":
                out.append(node.text or "")
            elif event == "start" and name == "tab":
                out.append("\t")
            elif event == "end" and name == "tc":
                out.append("\t")
            elif event == "end" and name in ("p", "tr"):
                out.append("\n")
    return "".join(out).strip()


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)\s*Tj|\[(?:[^\]\\]|\\.)*\]\s*TJ", re.S)
_LITERAL = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)


def parse_pdf(data: bytes) -> str:
    """Literal strings of each content stream under a page marker: for simple files; others need a parser of the caller's."""
    pages: list[str] = []
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        words = [re.sub(rb"\\([()\\])", rb"\1", s[1]).decode("latin-1") for shown in _SHOWN.finditer(body) for s in _LITERAL.finditer(shown[0])]
        if words:
            pages.append(f"[Page {len(pages) + 1}]\n{' '.join(words)}")
    return "\n".join(pages)


PARSERS = {"html": lambda d: "\n".join(filter(None, parse_html(d.decode("utf-8", "replace")))), "htm": lambda d: parse_html(d.decode("utf-8", "replace"))[1], "docx": parse_docx, "pdf": parse_pdf}


def html_text(pages: DataFrame, column: str) -> DataFrame:
    """pages with title and text of the HTML in a column."""
    schema = T.StructType([*pages.drop("title", "text").schema.fields, T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [parse_html(h) for h in p[column]]
            yield p.assign(title=[f[0] for f in found], text=[f[1] for f in found])[schema.names]

    return pages.drop("title", "text").mapInPandas(run, schema)


def parsed_files(spark: SparkSession, folder: str, fallback: Column | None = None) -> DataFrame:
    """id, source and content of HTML, DOCX and PDF files; what a parser fails on gets the fallback, or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,docx,pdf}").load(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, data in zip(p["path"], p["content"]):
                try:
                    out.append(PARSERS[path.rpartition(".")[2].lower()](bytes(data)))
                except Exception:  # a broken file is a null row, not a failed job
                    out.append(None)
            yield pd.DataFrame({"source": p["path"], "content": out})

    rows = files.select("path", "content").mapInPandas(run, "source string, content string")
    content = F.coalesce("content", fallback) if fallback is not None else F.col("content")
    return rows.select(document_id(F.col("source")).alias("id"), "source", content.alias("content"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (part, at, ..) with n, their place from 1 by (part, at): places within parts and the sizes of the parts before, so no single task."""
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("at")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # a row for each block of a file
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return own.join(before, "part").withColumn("n", F.col("before") + F.col("own")).drop("part", "at", "own", "before")


def evaluation_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (id, question, gold_docs, category): malformed and blank lines are dropped, missing ids and categories filled in, a byte order mark is skipped."""
    schema = "id string, question string, gold_docs array<string>, category string"
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = numbered(lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("s"), "part", "at").where("s.question IS NOT NULL"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(F.coalesce(blank("s.id"), F.concat(F.lit("sample_"), F.col("n").cast("string"))).alias("id"), "s.question", "s.gold_docs", F.coalesce(blank("s.category"), F.lit("default")).alias("category"))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, gold_orig_doc_ids array<string>, category string").json(path, multiLine=True)


def _tabs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated lines as they are: quotes are characters like any other."""
    return spark.read.csv(path, sep="\t", quote="", schema=schema)


def tab_queries(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (qid, text); a header and lines without a text are skipped."""
    return _tabs(spark, path, "qid string, text string").where("text IS NOT NULL AND NOT lower(trim(qid)) IN ('qid', 'query_id')")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (qid, 0, pid, rel); a header and rows without a number are skipped."""
    rows = _tabs(spark, path, "qid string, zero string, pid string, rel string")
    return rows.select("qid", "pid", F.col("rel").try_cast("int").alias("rel")).where("rel IS NOT NULL")


def wanted_passages(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows (pid, text) of a large tab-separated file whose id is wanted."""
    return _tabs(spark, path, "pid string, text string").join(wanted.select("pid").distinct(), "pid", "left_semi")
