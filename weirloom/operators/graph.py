"""Entity and code graphs: merging, search, degree-ranked views, bounded paths, code entities."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirloom.operators import patterns
from weirloom.operators.retrieve import top


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (name, type, chunk, attribute, ord) -> one row a name: the first type, all chunks and attributes once."""
    return nodes.groupBy("name").agg(
        F.min_by("type", "ord").alias("type"),
        F.array_sort(F.collect_set("chunk")).alias("chunks"),
        F.array_sort(F.collect_set("attribute")).alias("attributes"),
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each node in both directions, 0 for none."""
    ends = edges.select(F.col("src").alias("name")).union(edges.select(F.col("dst").alias("name")))
    return nodes.join(ends.groupBy("name").agg(F.count("*").alias("d")), "name", "left").select("name", F.coalesce("d", F.lit(0)).alias("degree"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, and the edges among them, each pair once in order of names."""
    kept = degrees(nodes, edges).orderBy(F.desc("degree"), "name").limit(min(limit, 500))
    names = kept.select("name")
    inside = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    pairs = inside.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type").distinct()
    return kept, pairs.orderBy("a", "b", "type").limit(min(2 * limit, 1000))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends."""
    return edges.select("src", "dst", "type").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def entity_matches(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """entities (query_id, entity) x nodes (name): either contains the other, case aside, both of two characters or more.

    An automaton over the entities, the smaller side, reads each name once; names within an entity are met as its substrings.
    """
    e = entities.where(F.char_length("entity") >= 2).select("query_id", "entity", F.lower("entity").alias("text"))
    n = nodes.where(F.char_length("name") >= 2).select("name", F.lower("name").alias("lower"))
    texts = e.select(F.col("text").alias("text_id"), "text").distinct()
    inside = patterns.within(n.select(F.col("name").alias("name_id"), F.col("lower").alias("name")), texts).select(F.col("text_id").alias("text"), F.col("name_id").alias("name"))
    around = patterns.matches(texts.select(F.col("text_id").alias("pattern_id"), F.col("text").alias("pattern")), n.select(F.col("name").alias("text_id"), F.col("lower").alias("text"))).select(F.col("pattern_id").alias("text"), F.col("text_id").alias("name"))
    return e.join(inside.union(around).distinct(), "text").select("query_id", "entity", "name")


def within_hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(src, dst): what start's names reach in 1 to depth steps; a cycle may lead back to the start."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must be from 1 to 5")
    steps = edges.select("src", "dst").distinct()
    front = start.join(steps, start.name == steps.src).select("src", "dst").distinct()
    reached = front
    for _ in range(depth - 1):
        front = front.alias("f").join(steps.alias("s"), F.col("f.dst") == F.col("s.src")).select(F.col("f.src").alias("src"), F.col("s.dst").alias("dst")).distinct()
        reached = reached.union(front).distinct()
    return reached


def glob_pattern(glob: str) -> str:
    """A glob over paths as a regular expression: ** any characters, * and ? none of /."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p) or re.escape(p) for p in re.split(r"(\*\*|\*|\?)", glob) if p) + "$"


def grep(files: DataFrame, pattern: str, glob: str = "**", largest: int = 1 << 20, per_file: int = 5, most: int = 50, budget: int = 20_000, clip: int = 200) -> DataFrame:
    """(path, line_no, line) of files (path, text) by path and line: files of the glob and of at most `largest` bytes, a few lines of each, `most` in all, while the clipped lines take no more than `budget` bytes together."""
    fit = files.where(F.col("path").rlike(glob_pattern(glob)) & (F.octet_length("text") <= largest))
    lines = fit.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(pattern))
    few = top(lines, per_file, ["path"], F.asc("at")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.left("line", F.lit(clip)).alias("line"))
    first = few.orderBy("path", "line_no").limit(most)
    spent = F.sum(F.octet_length("line")).over(Window.orderBy("path", "line_no"))  # of at most `most` rows
    return first.withColumn("spent", spent).where(F.col("spent") <= budget).drop("spent")


def read_files(requests: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """requests (.., path) with status and the first `most` characters of content, from files (path, text) with unique paths; a path with `..` is denied, whatever it leads to."""
    denied = F.contains("path", F.lit(".."))
    found = requests.join(files.select("path", F.left("text", F.lit(most)).alias("content"), F.lit(True).alias("there")), "path", "left")
    status = F.when(denied, "denied").when(F.col("there").isNull(), "missing").otherwise("ok")
    return found.select(*requests.columns, status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*\(", re.M)
_GO_TYPE = re.compile(r"^type\s+(\w+)\s+(struct|interface)\b", re.M)
_JS_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface)\s+(\w+)(?:\s+extends\s+([\w.]+))?", re.M)
_JS_FUNC = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", re.M)
_CALL = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(")
_IMPORT = re.compile(r"^\s*import\s+(?:[\w*{}\s,]+\s+from\s+)?[\"']([^\"']+)[\"']|^\s*(?:\w+\s+)?\"([\w./-]+)\"\s*$", re.M)


def code_items(path: str, source: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, target, line) of a file: Class, Function and Method entities, and CALLS, IMPORTS, INHERITS, CONTAINS relations.

    Python is parsed; Go, JavaScript and TypeScript are read by line patterns. Calls in the arguments of a call are not descended into.
    """
    out: list[tuple[str, str, str, int]] = []
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except SyntaxError:
            return out

        def calls(node: ast.AST, owner: str) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Call):
                    out.append(("CALLS", owner, ast.unparse(child.func), child.lineno))
                else:
                    calls(child, owner)

        def walk(body: list[ast.stmt], owner: str) -> None:
            for n in body:
                if isinstance(n, ast.ClassDef):
                    out.append(("Class", n.name, "", n.lineno))
                    out.extend(("INHERITS", n.name, ast.unparse(b), n.lineno) for b in n.bases)
                    walk(n.body, n.name)
                elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                    name = f"{owner}.{n.name}" if owner else n.name
                    out.append(("Method" if owner else "Function", name, "", n.lineno))
                    if owner:
                        out.append(("CONTAINS", owner, name, n.lineno))
                    for b in n.body:
                        calls(b, name)
                elif isinstance(n, ast.Import):
                    out.extend(("IMPORTS", path, a.name, n.lineno) for a in n.names)
                elif isinstance(n, ast.ImportFrom):
                    out.append(("IMPORTS", path, n.module or ".", n.lineno))

        walk(tree.body, "")
        return out
    line = lambda m: source.count("\n", 0, m.start()) + 1
    found = [(m, "Interface" if m[2] == "interface" else "Class", m[1], "") for m in _GO_TYPE.finditer(source)] if path.endswith(".go") else [(m, "Interface" if m[1] == "interface" else "Class", m[2], m[3] or "") for m in _JS_CLASS.finditer(source)]
    for m, kind, name, base in found:
        out.append((kind, name, "", line(m)))
        if base:
            out.append(("INHERITS", name, base, line(m)))
    functions = [(m, m[2], m[1]) for m in _GO_FUNC.finditer(source)] if path.endswith(".go") else [(m, m[1] or m[2], None) for m in _JS_FUNC.finditer(source)]
    for i, (m, name, owner) in enumerate(functions):
        full = f"{owner}.{name}" if owner else name
        out.append(("Method" if owner else "Function", full, "", line(m)))
        if owner:
            out.append(("CONTAINS", owner, full, line(m)))
        body = source[m.end() : functions[i + 1][0].start() if i + 1 < len(functions) else len(source)]
        out.extend(("CALLS", full, c[1], line(m)) for c in _CALL.finditer(body) if c[1] not in ("if", "for", "switch", "while", "func", "function", "return"))
    out.extend(("IMPORTS", path, m[1] or m[2], line(m)) for m in _IMPORT.finditer(source))
    return out


def code_graph(files: DataFrame) -> DataFrame:
    """files (source, content) -> source, kind, name, target, line."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(s, *item) for s, c in zip(p["source"], p["content"]) for item in code_items(s, c or "")], columns=["source", "kind", "name", "target", "line"])

    return files.select("source", "content").mapInPandas(run, "source string, kind string, name string, target string, line int")
