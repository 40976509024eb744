"""URL filter (native): pattern rules indexed by their rarest literal token.

Every rule states a regular expression over ``host || path`` and the literal tokens that each url it matches must
hold as whole tokens.  The rarest of these, by the number of urls holding it, is the rule's index entry.  A url's
tokens fetch the candidate rules and only those run their expression.

Up to ``INLINE_RULES`` rules are compiled into the row's expression (no shuffle at all); a longer list becomes a
table that the distinct urls' tokens join, of which Spark broadcasts what is under its own checked threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

INLINE_RULES = 256


@dataclass(frozen=True)
class UrlRule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    action: str
    weight: int


def host_rule(host: str, path: str, action: str) -> UrlRule:
    """Fits the host and its subdomains where the url's path starts with path; the longest name wins.  A token at
    the end of the path is indexed only if something that is not part of a token closes it."""
    text = (host + path).lower()
    found = [m for m in re.finditer(r"[a-z0-9]+", text) if m.end() < len(text)]
    return UrlRule(host + path, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(m[0] for m in found), action, len(host + path))


#: Rules of the method itself, for urls that no host rule fits.
PATTERN_RULES = (
    UrlRule("*pills", r"(?i)(?:^|[./-])(?:cheap|buy)-pills[./-]", ("pills",), "block", 1),
    UrlRule("*casino", r"(?i)(?:^|[./-])(?:online-)?casino[./-]", ("casino",), "block", 1),
    UrlRule("*adult", r"(?i)(?:^|[./-])adult[./-]", ("adult",), "block", 1),
    UrlRule("*doubleclick", r"(?i)(?:^|\.)doubleclick\.[a-z]+/", ("doubleclick",), "block", 1),
    UrlRule("*wp-login", r"(?i)/wp-login\.php", ("wp", "login"), "block", 1),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(subject), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, subject: str, rules: list[UrlRule]) -> dict[str, str]:
    """Rule name -> the one of its tokens that the fewest urls hold (ties: alphabetical).  What is gathered is one
    count for each token of the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    if urls.isEmpty() or not known:
        return {r.name: min(r.tokens, default="") for r in rules}
    tokens = urls.select(F.explode(F.array_intersect(url_tokens(F.col(subject)), F.array(*map(F.lit, known)))).alias("t"))
    count = {r["t"]: r["n"] for r in tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r.name: min(r.tokens, key=lambda t: (count.get(t, 0), t), default="") for r in rules}


def _best_inline(subject: Column, rules: list[UrlRule], index: dict[str, str]) -> Column:
    found = F.array_intersect(url_tokens(subject), F.array(*map(F.lit, sorted({*index.values()}))))
    out = []
    for r in rules:
        fits = subject.rlike(r.regex)
        if index[r.name]:
            fits = F.array_contains(found, index[r.name]) & fits
        out.append(F.when(fits, F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))))
    return F.array_max(F.array_compact(F.array(*out)))


def filter_urls(pages: DataFrame, host_rules: list[UrlRule], pattern_rules=PATTERN_RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns keep, host, path, rule, verdict, pattern; one row per input row.

    A null url, or one without ://, has an empty host and path, no rule and verdict allow.  Repeated rows are judged
    alike, each on its own.  Other columns of pages are not read.  Of rules of the same length the later name wins."""
    rules = [*host_rules, *pattern_rules]
    host, path = url_parts(F.col(url))
    base = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("_subject", F.concat("host", "path"))
    index = rarest_tokens(base, "_subject", rules)
    if len(rules) <= INLINE_RULES:
        judged = base.withColumns({"_rule": _best_inline(F.col("_subject"), list(host_rules), index), "_pattern": _best_inline(F.col("_subject"), list(pattern_rules), index)})
    else:
        judged = _judge_by_join(base, list(host_rules), list(pattern_rules), index)
    verdict = F.coalesce(F.col("_rule.action"), F.col("_pattern.action"), F.lit("allow"))
    return judged.select(*keep, "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"), F.col("_pattern.name").alias("pattern"))


def _judge_by_join(base: DataFrame, host_rules, pattern_rules, index) -> DataFrame:
    spark = base.sparkSession
    rows = [(index[r.name], r.regex, r.weight, r.name, r.action, r in host_rules) for r in [*host_rules, *pattern_rules]]
    table = spark.createDataFrame(rows, "token string, regex string, weight int, name string, action string, is_host boolean")
    subjects = base.select("_subject").distinct()
    asked = subjects.select("_subject", F.explode(F.array_union(url_tokens(F.col("_subject")), F.array(F.lit("")))).alias("token")).distinct()
    fits = asked.join(table, "token").where(F.expr("_subject rlike regex"))
    value = F.struct("weight", "name", "action")
    best = fits.groupBy(F.col("_subject")).agg(F.max(F.when(F.col("is_host"), value)).alias("_rule"), F.max(F.when(~F.col("is_host"), value)).alias("_pattern"))
    return base.join(best, "_subject", "left")
