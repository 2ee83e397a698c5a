"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the syntax of common filter lists: `||` anchors at a host or a
parent domain of it, `^` is a separator (an ASCII character but a letter, a digit or one of
`_-.%`) or the end, `*` is any run, a final `|` anchors at the end; all else is literal. A
leading `@@` makes an exception, which wins over patterns that block; otherwise the longest
pattern decides. Patterns are matched against host and path. Lists are read by read_list.

A rule's usable tokens are literal runs of [a-z0-9] that the pattern itself delimits on both
sides, so every URL that fits the rule has them as whole tokens. Counting those tokens over
all URLs gives the rarest, and the rule is filed under it. A URL's tokens fetch candidate
rules by an equi-join; only those run as regular expressions. Rules without a usable token
are filed under the empty token, which every URL carries only while such rules exist.

All of it is DataFrame operations. URLs are judged once per distinct value; when verdicts go
back to the rows, values with a thousandth of all rows or more are dealt over SALTS keys.

Defined results: a null url, or one without `://`, has an empty host and path and gets
the default verdict; repeated rows (also of the key) each get one row; an empty table
gives an empty one; other columns of the input stay as they are.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Up to this many rules the index is broadcast (about 200 bytes a rule); a larger one is joined by shuffle.
BROADCAST_RULES = 20_000
#: Values with this share of all rows, one over MOST_OFTEN, or more are salted: at most MOST_OFTEN of them.
MOST_OFTEN, SALTS = 1000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    pattern: str
    verdict: str
    name: str | None = None  # of host rules: shown as `rule` and stronger than patterns


#: Host rules: the longest that fits a URL decides.
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Patterns for what no host rule decides: adverts, trackers, spam, scanners' targets, pages without text of their own.
DEFAULT_LIST = """
! spam and malware
cheap-pills.
casino-win.
^casino^
^online-casino^
^free-money^
^payday-loans^
^replica-watches^
^essay-writing-service^
^weight-loss-pills^
^malware^
^phishing^
^keygen^
^cracks^
^warez^
||pills.*^
||casino.*^
||poker.*^
||betting.*^
! adverts
^adserver^
^adservice^
^adsystem^
^banner^ads^
^banners^ads^
^popunder^
^popup^ads^
^doubleclick^
^sponsored-links^
^affiliate^click^
^interstitial^
/ads/*
/adverts/*
/advertising/*
/adframe.*
/ad_frame.*
/showads.*
/adclick.*
/ad-300x250.*
/ad-728x90.*
/ad-160x600.*
||ads.*^
||adserver.*^
||adx.*^
||banner.*^
||banners.*^
||promo.*^
@@||ads.*^privacy^
@@/advertising/policy|
! trackers
||tracker.*^
||tracking.*^
||pixel.*^
||beacon.*^
||telemetry.*^
||analytics.*^collect^
^web-beacon^
^pixel.gif|
^pixel.png|
^1x1.gif|
^collect^event^
^piwik.php|
^matomo.php|
! targets of scanners, and administration
/wp-login.php|
/wp-admin/*
/xmlrpc.php|
/phpmyadmin/*
/cgi-bin/*.exe|
/cgi-bin/*.cgi|
/.git/*
/.env|
/administrator/index.php|
/server-status|
/web.config|
! pages without text of their own
/login|
/signin|
/signup|
/register|
/logout|
/lost-password|
/reset-password|
/cart|
/checkout|
/basket|
/my-account|
/wishlist|
/search|
/search/results|
^unsubscribe^
^captcha^
^print^preview^
^session-expired^
^404.html|
^error^404^
/tag/*/feed|
/comments/feed|
/feed|
/rss.xml|
/sitemap.xml|
/robots.txt|
/favicon.ico|
! files that are no pages
^download^*.exe|
^download^*.zip|
^download^*.apk|
^download^*.iso|
@@||docs.*^search|
@@||wiki.*^tag^
"""


def parse_list(text: str) -> list[Rule]:
    """Rules of a filter list. Comments, rules for parts of pages and regular expressions are left out, and so are rules with options, which need a request's context."""
    out = []
    for line in map(str.strip, text.splitlines()):
        pattern = line.removeprefix("@@")
        if not pattern or line[0] in "![" or "##" in line or "#@#" in line or "#?#" in line or "$" in line or len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
            continue
        out.append(Rule(pattern, "allow" if line != pattern else "block"))
    return out


def read_list(spark: SparkSession, path: str) -> list[Rule]:
    """parse_list of a text file; a list is a driver-side parameter, some bytes a rule."""
    return parse_list("\n".join(r["value"] for r in spark.read.text(path).collect()))


def default_rules() -> list[Rule]:
    return [Rule(f"||{name}", verdict, name) for name, verdict in HOST_RULES] + parse_list(DEFAULT_LIST)


#: An ASCII character that separates, in the common part of the Java and RE2 dialects.
_SEPARATOR = r"[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"


def regex(pattern: str) -> str:
    """A regular expression over host + path; the scheme's separator stands before the host."""
    head = tail = ""
    if pattern.startswith("||"):
        head, pattern = r"^([^/]*\.)?", pattern[2:]
    elif pattern.startswith("^"):
        head, pattern = rf"(^|{_SEPARATOR})", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    parts = {"*": ".*", "^": rf"({_SEPARATOR}|$)"}
    return head + "".join(parts.get(c) or (c if c.isalnum() else "\\" + c) for c in pattern) + tail


def tokens(pattern: str) -> list[str]:
    """The literal tokens that any URL fitting the pattern has whole, lower-cased."""
    body = pattern[2:] if pattern.startswith("||") else "*" + pattern
    body = body[:-1] if body.endswith("|") else body + "*"
    found = re.finditer(r"[A-Za-z0-9]+", body)
    edge = lambda i: i < 0 or i >= len(body) or body[i] != "*"
    return sorted({m[0].lower() for m in found if edge(m.start() - 1) and edge(m.end())})


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): empty for null or without `://`."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(text: F.Column) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (token, rule fields), each rule once, under the rarest of its tokens over `urls` (columns u_text)."""
    spark = urls.sparkSession
    rows = [(i, r.name, r.verdict, regex(r.pattern), len(r.name or r.pattern), tokens(r.pattern) or [""]) for i, r in enumerate(rules)]
    flat = spark.createDataFrame(rows, "r_id int, r_name string, r_verdict string, r_regex string, r_length int, r_tokens array<string>").withColumn("r_token", F.explode("r_tokens"))
    small = len(rules) <= BROADCAST_RULES
    wanted = flat.select("r_token").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("u_text"))).alias("r_token"))
    counts = seen.join(F.broadcast(wanted) if small else wanted, "r_token", "left_semi").groupBy("r_token").agg(F.count("*").alias("r_seen"))
    rarest = Window.partitionBy("r_id").orderBy(F.coalesce("r_seen", F.lit(0)), F.length("r_token").desc(), "r_token")
    out = flat.join(counts, "r_token", "left").withColumn("r_rank", F.row_number().over(rarest)).where("r_rank = 1").drop("r_tokens", "r_seen", "r_rank")
    return F.broadcast(out) if small else out


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", column: str = "url") -> DataFrame:
    """The rows of `pages` with host, path, rule and verdict put in (replacing columns so named).

    The input's columns travel as one struct, so none can clash with the operator's own.
    """
    rules = default_rules() if rules is None else rules
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = parts(pages[column])
    rows = pages.select(F.struct(*(pages[c] for c in keep)).alias("u_row"), host.alias("u_host"), path.alias("u_path"))
    urls = rows.groupBy(F.concat("u_host", "u_path").alias("u_text")).agg(F.count("*").alias("u_n"))
    general = any(not tokens(r.pattern) for r in rules)
    own = url_tokens(F.col("u_text"))
    found = urls.select("u_text", F.explode(F.array_append(own, F.lit("")) if general else own).alias("r_token")).join(index(urls, rules), "r_token")
    fits = found.where(F.rlike("u_text", F.col("r_regex")))
    named = F.col("r_name").isNotNull()
    strength = F.struct(named.cast("int"), (~named & (F.col("r_verdict") == "allow")).cast("int"), F.col("r_length"), -F.col("r_id"))
    best = fits.groupBy("u_text").agg(F.max_by(F.struct("r_name", "r_verdict"), strength).alias("u_best"))
    total = pages.count()
    often = F.broadcast(urls.where(F.col("u_n") * MOST_OFTEN >= total).select("u_text", F.lit(True).alias("u_often")))  # MOST_OFTEN rows at most
    salt = lambda which: F.when(F.col("u_often"), which).otherwise(F.lit(0))
    best = best.join(often, "u_text", "left").select("u_text", "u_best", F.explode(F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))).alias("u_salt"))
    # every salt meets the same verdict, so the result does not depend on how rows are dealt
    salted = rows.withColumn("u_text", F.concat("u_host", "u_path")).join(often, "u_text", "left").withColumn("u_salt", salt(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    out = salted.join(best, ["u_text", "u_salt"], "left")
    return out.select("u_row.*", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_best.r_name").alias("rule"), F.coalesce("u_best.r_verdict", F.lit(default)).alias("verdict"))


def oracle(rules: list[Rule] | None = None, default: str = "allow") -> str:
    """DuckDB SQL: every rule against every URL, the strongest that fits."""
    rules = default_rules() if rules is None else rules
    quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(r.name)}, {quote(r.verdict)}, {quote(regex(r.pattern))}, {len(r.name or r.pattern)})" for i, r in enumerate(rules))
    return f"""
WITH rules(id, name, verdict, pattern, len) AS (VALUES {values}),
p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hits AS (SELECT p.host, p.path, r.name, r.verdict,
  row_number() OVER (PARTITION BY p.host, p.path ORDER BY (r.name IS NOT NULL) DESC, (r.name IS NULL AND r.verdict = 'allow') DESC, r.len DESC, r.id) AS rn
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules r ON regexp_matches(p.host || p.path, r.pattern))
SELECT p.page_id, p.host, p.path, h.name AS rule, coalesce(h.verdict, {quote(default)}) AS verdict
FROM p LEFT JOIN hits h ON h.rn = 1 AND h.host = p.host AND h.path = p.path"""
