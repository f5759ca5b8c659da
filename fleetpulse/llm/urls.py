"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` with literal tokens that every match contains.
Tokens of all urls are counted, each rule is filed under its rarest token, and the tokens of a url
fetch its candidate rules in a join; only those run their expression. The highest ``rank`` wins, then
the longest text, then the text last in order; without a rule the verdict is ``default``.

Defined results: a null url, or one without ``://``, has an empty host and path and takes the
default. Equal urls are judged once, and every row gets its verdict. Empty tables of urls or rules
are fine. The page's own columns stay inside ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.store import stage

TOKEN = r"[a-z0-9]+"
# Upper-case to lower-case for A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``text`` identifies the rule; ``tokens`` are whole tokens that occur in whatever it matches."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(verdict: str, text: str) -> UrlRule:
    """A rule ``host/path``: the host and its subdomains, for paths that start with the rule's.

    Tokens that touch the end of the rule may go on in the url, so only closed ones are literals.
    """
    host, slash, path = text.partition("/")
    rest = re.match(r"(?:.*[^A-Za-z0-9])?", slash + path, re.S)[0]
    tokens = tuple(re.findall(TOKEN, host)) + tuple(re.findall(TOKEN, rest.translate(str.maketrans(UPPER, LOWER))))
    return UrlRule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens, 1)


def label_rule(verdict: str, label: str) -> UrlRule:
    """A rule for hosts that have ``label`` as one of their dot-separated parts."""
    return UrlRule(label, verdict, rf"^(?:[^/]*\.)?{re.escape(label)}\.[^/]", tuple(re.findall(TOKEN, label)))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[UrlRule]) -> DataFrame:
    """Rules as a frame, for lists kept in code; large lists are better read from a table."""
    schema = "text string, verdict string, pattern string, tokens array<string>, rank int"
    return spark.createDataFrame([(r.text, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules], schema)


def filtered_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every page (inside ``row``) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``text, verdict, pattern, tokens, rank``; a rule without tokens is tried on every url.
    """
    col = pages[f"`{url}`"]
    df = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), host_of(col).alias("host"), path_of(col).alias("path"))
    target = F.concat("host", "path")
    urls = df.select("host", "path").distinct().withColumn("__target", target)
    lowered = F.translate(F.col("__target"), UPPER, LOWER)
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))
    urls = stage(urls.withColumn("__tokens", tokens), "url-tokens")

    listed = rules.select(F.col("text").alias("rule"), F.col("verdict").alias("__verdict"), "pattern", F.col("rank").alias("__rank"),
                          F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))).alias("tokens"))
    exploded = listed.select("rule", F.explode("tokens").alias("token"))
    wanted = exploded.select("token").distinct()
    counted = urls.select(F.explode("__tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        exploded.join(counted, "token", "left").groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = stage(rarest.join(listed.drop("tokens"), "rule").select("token", "rule", "__verdict", "pattern", "__rank").coalesce(1), "url-rules")

    fits = (
        urls.select("host", "path", "__target", F.explode("__tokens").alias("token")).join(index, "token")
        .where(F.regexp_like("__target", "pattern"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.col("__rank").alias("rank"), F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("__verdict").alias("verdict"))).alias("best"))
    )
    return df.join(fits, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rank").alias("rank"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
