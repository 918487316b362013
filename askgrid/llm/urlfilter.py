"""URL rules by hashed expressions: host suffixes and path prefixes meet the rules on short hashes.

A rule is a host and a path; it fits a url of that host or a subdomain whose path starts with the
rule's. Its expression is the host with the path up to its last slash. A url has an expression for
each suffix of its host, of as many labels as a rule has at most, and each prefix of its path that
ends in a slash, of as many slashes as a rule has at most: no other expression can be a rule's.

1. urls are brought to distinct (host, path): a page that a third of all rows name is judged once;
2. their expressions meet the rules' on the first four bytes of the SHA-256 digest;
3. whole digests confirm a meeting, and what a rule's path has after its last slash is compared as
   text;
4. of the rules that fit a url the longest wins (of equally long ones that with the longer host), and
   decides; other urls have the default verdict.

The rules are broadcast behind a count, and so are the urls that a rule fits; beyond it the same
joins shuffle light rows, whose hot keys adaptive execution splits.

Defined results: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z in lower case, port and user included; the path goes on from there up to ``?``, ``#`` or the end.
A null url, or one without ``://``, has an empty host and path, which no rule fits. Rules without a
host or a verdict are left out, a null path is empty and fits every path; of rules for one host and
path that differ, ``block`` wins. Without rules every url has the default verdict. Rows repeated whole
are judged alike, and columns of the input keep their names, whatever they are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.workspace import free_name, written

#: Rules, or urls that rules fit, which are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return _lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _occurs(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _short(digest: Column) -> Column:
    """The first four bytes of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _with_rules(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, verdict, rule, digest, short): distinct rules with the hash of their expressions."""
    own = rules.select(_lowered("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> '' AND verdict IN ('allow', 'block')")
    own = own.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("rule_host", F.regexp_extract("rule_path", "(?s)^(?:.*/)?", 0)), 256)
    return own.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", digest).withColumn("short", _short(F.col("digest")))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict): the rule that decides each distinct (host, path) that any fits."""
    own = written(_with_rules(rules), "rules")
    most = own.agg(F.max(_occurs(F.col("rule_host"), ".") + 1).alias("labels"), F.max(_occurs(F.col("rule_path"), "/")).alias("slashes")).first()
    labels = F.sequence(F.lit(1), F.least(_occurs(F.col("host"), ".") + 1, F.lit(most["labels"] or 1)))
    slashes = F.sequence(F.lit(0), F.least(_occurs(F.col("path"), "/"), F.lit(most["slashes"] or 0)))
    said = urls.where("host <> ''").select("host", "path").distinct().withColumn("l", F.explode(labels)).withColumn("s", F.explode(slashes))
    suffix = F.expr("substring_index(host, '.', -l)")
    prefix = F.expr("CASE WHEN s = 0 THEN '' ELSE concat(substring_index(path, '/', s), '/') END")
    said = said.select("host", "path", F.sha2(F.concat(suffix, prefix), 256).alias("said")).withColumn("short", _short(F.col("said")))
    met = said.join(_few(own), "short").where((F.col("said") == F.col("digest")) & F.startswith("path", F.col("rule_path")))
    order = F.struct(F.length("rule"), F.length("rule_host"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The columns ``keep`` (all of them without it) with host, path, the rule that decides (null: none) and the verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).
    """
    keep = pages.columns if keep is None else keep
    named = {c: free_name(keep, c) for c in ("host", "path", "rule", "verdict")}
    host, path = url_parts(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep)]
    urls = pages.select(*kept, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    best = written(fitting_rules(urls, rules), "fitting")
    judged = urls.join(_few(best), ["host", "path"], "left")
    return judged.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keep)], F.col("host").alias(named["host"]), F.col("path").alias(named["path"]), F.col("rule").alias(named["rule"]), F.coalesce("verdict", F.lit(default)).alias(named["verdict"]))
