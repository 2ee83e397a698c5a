"""Text functions as column expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide the results of detectors and tokenisers.
STRICT_TOPICS = ["天气", "股票", "股价", "涨跌", "彩票", "实时", "今天", "明天", "weather", "stock", "price today"]
OVERVIEW_PHRASES = ["这个项目", "项目是什么", "项目介绍", "整体架构", "project overview"]
PROJECT_MARKERS = ["本项目", "这个项目", "项目概述", "项目定位", "整体架构"]
SYSTEM_MARKERS = ["pipeline", "agentic", "mcp", "code_search", "graphrag"]
BAD_SIGNALS = ["example", "provided by this api", "<a href=", "<div", "astro-", "lorem ipsum"]
TERM_STOP_WORDS = ["请", "基于", "知识库", "回答", "说明", "什么", "这个", "项目", "必须", "给出", "引用", "来源", "the", "and", "for", "with", "this", "that", "what", "how", "why", "please", "answer"]
SEARCH_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can what which who whom where when how why that this these those "
    "i me my we our you your he him his she her it its they them their of in on at to for with by from about into through during before after and or but not no if then so as up out just also tell please describe explain"
).split()
SEARCH_PUNCTUATION = ".,!?;:\"'()[]{}、。，！？；：“”‘’（）【】"
FOLLOW_UP_MARKERS = ["这个", "这", "它", "他们", "它们", "上面", "刚才", "继续", "展开", "这个文档", "这份文档", "该文档", "其中", "那"]
CODE_WORDS = ["code", "function", "tool_call", "function_call", "源码", "代码", "函数", "实现", "调用链", "工具调用", "deer-flow", "pydantic-ai", "normalize", "path_not_found"]
CODE_PATTERNS = ["normalizeReadPath", "path_not_found", "isPathInside", "tool_call", "function_call", "ToolNode", "bind_tools"]
CODE_TOOL_WORD, CODE_TOOL_PATTERNS = "工具调用", ["tool_call", "function_call", "ToolNode", "bind_tools"]
INSUFFICIENT = ["未在当前知识库中找到足够依据", "知识库内容不足", "没有找到任何", "无法基于当前上下文"]
PROMPT_RULES = [
    ("ignore_system_instruction", "high", "(ignore|bypass|override).*(system|developer|instruction|prompt)"),
    ("extract_secret_prompt", "high", "(show|reveal|print|dump).*(system prompt|developer message|api key|token|password|secret)"),
    ("chinese_ignore_instruction", "high", "(忽略|绕过|覆盖).*(系统|开发者|安全|指令|提示词)"),
    ("chinese_secret_exfiltration", "high", "(输出|泄露|展示).*(系统提示词|开发者消息|密钥|token|密码|秘钥)"),
    ("force_tool_call", "medium", "(force|must|directly).*(tool|function|mcp|plugin)"),
    ("chinese_privileged_tool_call", "medium", "(调用|使用).*(工具|mcp|插件).*(忽略|绕过|越权|无权限|强制)"),
]
MOJIBAKE = "[�ÃÂÐÑÄÅÆÇÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ¤¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿]"
KNOWN_SYMBOLS = "\\p{L}\\p{N}，。！？；：、“”‘’（）《》【】\\[\\]{}()<>.,!?;:'\"`~\\-_/\\\\|@#$%^&*+=\\s"
SENTENCE_ENDS = r"[。！？；\n]|\.(?:\s|\z)|[!?](?:\s|\z)"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_any(c: Column, words: list[str]) -> Column:
    """Whether the text contains any of the words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def squeezed(c: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncated(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(tail))).otherwise(c)


def sentences(c: Column) -> Column:
    """Sentences with their terminators; blank ones are left out."""
    marked = F.regexp_replace(c, f"({SENTENCE_ENDS})", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), trimmed), lambda s: s != "")


def meaningful_terms(c: Column) -> Column:
    parts = F.split(F.lower(c), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: (F.char_length(t) >= 2) & ~t.isin(TERM_STOP_WORDS))


def search_keywords(c: Column) -> Column:
    marks = "".join("\\" + m if ord(m) < 128 else m for m in SEARCH_PUNCTUATION)
    cut = F.transform(F.split(trimmed(c), r"\s+"), lambda w: F.lower(F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")))
    return F.filter(cut, lambda w: (F.octet_length(w) > 1) & ~w.isin(SEARCH_STOP_WORDS))


def low_quality(c: Column) -> Column:
    """Evidence too short, with two bad signals, with too few letters or mostly markup."""
    text = trimmed(c)
    signals = sum((F.contains(F.lower(text), F.lit(s)).cast("int") for s in BAD_SIGNALS), F.lit(0))
    letters, markup = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit("[<>/=]"))
    return (F.char_length(text) < 40) | (signals >= 2) | (letters < 20) | (markup > F.floor(letters / 2))


def relevant(terms: Column, content: Column) -> Column:
    """Whether any term is in the content, or there is at most one term."""
    lower = F.lower(content)
    return (F.size(terms) <= 1) | F.exists(terms, lambda t: F.contains(lower, t))


def prompt_risk(c: Column, extra: list[tuple[str, str, str]] = ()) -> tuple[Column, Column]:
    """(level, names of the matched rules joined by commas)."""
    text = trimmed(c)
    rules = [*PROMPT_RULES, *extra]
    hit = lambda p: text.rlike(f"(?i){p}")
    names = F.array_join(F.filter(F.array(*(F.when(hit(p), F.lit(n)) for n, _, p in rules)), lambda n: n.isNotNull()), ",")
    of = lambda level: sum((hit(p).cast("int") for _, s, p in rules if s == level), F.lit(0)) > 0
    return F.when(of("high"), "high").when(of("medium"), "medium").otherwise("low"), names


def garbled(c: Column) -> Column:
    """Text whose share of mojibake is over 8 % or of unusual symbols over 18 % of what is not white space."""
    text = trimmed(c)
    chars = F.regexp_count(text, F.lit(r"\S"))
    suspicious = F.regexp_count(text, F.lit(f"{MOJIBAKE}|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    symbols = F.regexp_count(text, F.lit(f"[^{KNOWN_SYMBOLS}]"))
    return F.when((F.char_length(text) < 24) | (chars == 0), False).otherwise((suspicious / chars > 0.08) | (symbols / chars > 0.18))


def wiki_links(c: Column) -> Column:
    """Targets of [[path]] and [[path|shown]]: trimmed, with suffix, without index and blanks, each once."""
    inner = F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))
    paths = F.filter(F.transform(inner, trimmed), lambda p: (p != "") & (p != "index.md") & (p != "index"))
    return F.array_distinct(F.transform(paths, lambda p: F.when(F.endswith(p, F.lit(".md")), p).otherwise(F.concat(p, F.lit(".md")))))


def wiki_rendered(c: Column) -> Column:
    """Links as markdown: [[path|text]] shows the path without .md and with spaces for hyphens, whatever its text."""
    link = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"

    def shown(path: Column) -> Column:
        path = trimmed(path)
        return F.concat(F.lit("["), F.replace(F.regexp_replace(path, r"\.md\z", ""), F.lit("-"), F.lit(" ")), F.lit("]("), path, F.lit(")"))

    links = F.transform(F.regexp_extract_all(c, F.lit(link), F.lit(1)), shown)
    return F.array_join(F.zip_with(F.split(c, link), links, lambda piece, x: F.concat(piece, F.coalesce(x, F.lit("")))), "")


def path_sanitised(c: Column) -> Column:
    out = c
    for suffix in ("md", "txt", "pdf"):
        out = F.regexp_replace(out, rf"\.{suffix}\z", "")
    return F.concat(F.translate(F.lower(out), " _.", "---"), F.lit(".md"))


def without_thinking(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))


def relation_type(c: Column) -> Column:
    """A name for a relation: letters, digits, underscores and Han only, 50 characters at most."""
    kept = F.regexp_replace(F.regexp_replace(trimmed(c), r"[^A-Za-z0-9_\p{IsHan}]", "_"), "_+", "_")
    kept = F.left(F.regexp_replace(kept, "^_|_$", ""), F.lit(50))
    return F.when(kept == "", "RELATED_TO").otherwise(kept)


def file_type(name: Column) -> Column:
    """A parser's name by extension; unknown ones are the extension itself, none is text."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("htm", "html"), "html").when(ext.isin("txt", "log", "rst", ""), "text").otherwise(ext)


def plain_html(c: Column) -> Column:
    """A page's title and text, by removal of scripts and markup: for sorting and heuristics, where a parse would be too slow."""
    cut = F.regexp_replace(c, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    return squeezed(F.regexp_replace(F.regexp_replace(cut, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))
