"""URL filters: pattern rules indexed by their rarest literal token.

Every rule becomes a regular expression plus the literal tokens (A-Z lower-cased) that any matching URL must contain. The
token that the fewest URLs contain indexes the rule. The tokens of a URL fetch the rules stored under them, and only those
rules run their expression. Rules are a table (``rule_table`` makes one of lists, ``read_rules`` of a stored table); a rule
without a literal token would run on every URL and is refused.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule, so it gets the verdict of
the pattern rules (allow if none matches). Repeated rows stay repeated. A rule that is given twice counts once; of rules
that fit, the one with the longest ``host + path`` wins, then the longest host, then the text order; of patterns the last
in text order. No rules allow everything. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the whole URL. Every match contains each of ``literals`` as a whole run of letters and
    digits, in any case."""

    verdict: str
    regex: str
    literals: tuple[str, ...]


#: Words between delimiters and endings of downloads that the default patterns block.
WORDS, ENDINGS = ("porn", "xxx", "casino"), ("exe", "zip", "iso", "dmg", "apk")
#: The pattern rules that judge a URL that no host rule fits: one a literal.
DEFAULT_PATTERNS = (
    *(PatternRule("block", rf"(?i)[/._-]{w}[/._-]", (w,)) for w in WORDS),
    *(PatternRule("block", rf"(?i)\.{e}([?#]|$)", (e,)) for e in ENDINGS),
    PatternRule("block", r"[?&]sessionid=", ("sessionid",)),
    PatternRule("block", r"/wp-login\.php", ("wp", "login")),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(kind: str, text: Column) -> Column:
    """The runs of letters and digits, each with the part of the URL that it is in."""
    return F.transform(F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))


def _whole_tokens(text: str, open_end: bool) -> list[str]:
    """Tokens of a literal, A-Z in lower case; one that may go on beyond an open end is left out."""
    found = [(m.group(), m.end()) for m in re.finditer(r"[^\W_]+", text.translate(str.maketrans(UPPER, LOWER)))]
    return [t for t, b in found if not (open_end and b == len(text))]


RULE_SCHEMA = "rule string, rule_verdict string, regex string, over string, span int, host_span int, tokens array<string>"


def rule_table(spark: SparkSession, hosts: list[HostRule], patterns: list[PatternRule] | tuple[PatternRule, ...] = DEFAULT_PATTERNS) -> DataFrame:
    """One row a rule: rule, verdict, regex, over (``hp`` host and path, ``url``), span and tokens."""
    rows = []
    for r in dict.fromkeys(hosts):
        regex = r"(?s)^(?:[^/]*\.)?\Q" + r.host + r.path + r"\E.*"
        tokens = ["h:" + t for t in _whole_tokens(r.host, False)] + ["p:" + t for t in _whole_tokens(r.path, True)]
        rows.append((r.host + r.path, r.verdict, regex, "hp", len(r.host + r.path), len(r.host), tokens))
    for p in dict.fromkeys(patterns):
        rows.append((p.regex, p.verdict, p.regex, "url", 0, 0, ["u:" + t for x in p.literals for t in _whole_tokens(x, False)]))
    bare = [r[0] for r in rows if not r[-1]]
    if bare:
        raise ValueError(f"rules without a literal token: {bare}")
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(table: DataFrame) -> DataFrame:
    """The same from a table of any size with verdict, host and path, or verdict, regex and literals (an array)."""
    spaced = lambda c: F.filter(F.split(F.translate(c, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    marked = lambda kind, c: F.transform(c, lambda t: F.concat(F.lit(kind), t))
    table = table.distinct()
    if "regex" in table.columns:
        tokens = marked("u:", F.flatten(F.transform("literals", spaced)))
        out = table.select(F.col("regex").alias("rule"), F.col("verdict").alias("rule_verdict"), "regex", F.lit("url").alias("over"), F.lit(0).alias("span"), F.lit(0).alias("host_span"), tokens.alias("tokens"))
    else:
        path = F.coalesce("path", F.lit(""))
        # the last run of a path may go on in the URL
        closed = F.regexp_replace(path, r"[\p{L}\p{N}]+$", "")
        rule = F.concat("host", path)
        out = table.select(rule.alias("rule"), F.col("verdict").alias("rule_verdict"), F.concat(F.lit(r"(?s)^(?:[^/]*\.)?\Q"), rule, F.lit(r"\E.*")).alias("regex"), F.lit("hp").alias("over"), F.length(rule).alias("span"), F.length("host").alias("host_span"), F.concat(marked("h:", spaced(F.col("host"))), marked("p:", spaced(closed))).alias("tokens"))
    return out.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("rule without a literal token: "), "rule"))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The id, host, path, rule and verdict of every row.

    One shuffle: rows are grouped by id and URL, which also gathers repeated rows. The index of rules is written first, so
    Spark knows its size when it plans the join, and broadcasts it only if that is under the session's threshold.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    keyed = F.array_distinct(F.concat(_tokens("h:", host_of(F.col("url"))), _tokens("p:", path_of(F.col("url"))), _tokens("u:", F.coalesce("url", F.lit("")))))
    literal = rules.select("rule", F.explode(F.array_distinct("tokens")).alias("token"))
    seen = urls.select(F.explode(keyed).alias("token")).join(literal.select(F.col("token").alias("t")).distinct(), F.col("token") == F.col("t"), "left_semi").groupBy("token").count()
    rarest = literal.join(seen, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))
    index = keep(spark, rules.drop("tokens").distinct().join(rarest, "rule"), "rule-index")
    urls = urls.groupBy("id", "url").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    # one row a URL besides those of the rules that it fetches
    fetched = urls.withColumn("token", F.explode(F.concat(F.array(F.lit("")), keyed))).join(index, "token", "left").filter("token = '' OR rule IS NOT NULL")
    fits = F.coalesce(F.expr("regexp_like(CASE WHEN over = 'hp' THEN concat(host, path) ELSE url END, regex)"), F.lit(False))
    fetched = fetched.withColumn("fits", F.when(F.col("rule").isNotNull(), fits).otherwise(False))
    rank = F.struct("span", "host_span", "rule", "rule_verdict")
    best = fetched.groupBy("id", "url", "host", "path", "n").agg(
        F.max(F.when(F.col("fits") & (F.col("over") == "hp"), rank)).alias("host_rule"),
        F.max(F.when(F.col("fits") & (F.col("over") == "url"), F.struct("rule", "rule_verdict"))).alias("pattern"),
    )
    out = best.select(
        F.col("id").alias(id_col), "host", "path", F.col("host_rule.rule").alias("rule"),
        F.coalesce("host_rule.rule_verdict", "pattern.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
