"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A URL is expanded into every suffix of its host (by labels) joined with every
prefix of its path that is as long as some rule's path. Expressions meet rules in
an equi-join on the first 32 bits of their SHA-256; the full digests then confirm,
and the longest confirmed rule wins.

Only distinct (host, path head) keys are expanded, so a host that holds a third of
all pages is expanded once for each of its few path heads. The keys' verdicts meet the pages in
``SALTS`` copies each, so the pages of one key are dealt to as many tasks. Rules are broadcast
only if Catalyst's size estimate allows it; else the join is a sort-merge join.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
no rule; an empty URL likewise; repeated rows each get a row; of rules with the
same host and path, one that blocks wins; rules with a null host, path or action
are ignored; a very long url is one row, of whose path as much as the longest rule has is a key;
other columns of the input are ignored; an empty table of pages or
rules is fine (without rules every page gets the default verdict).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower

#: First ``://``; host up to ``/ ? #``; path up to ``? #``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


SALTS = 16


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    wanted = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.transform(wanted, lambda n: F.substr(path, F.lit(1), n))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page. ``rules``: host, path, action.

    The distinct lengths of rule paths go to the driver: a set of small integers,
    bounded by the longest path that a rule may have.
    """
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", F.lower("action").alias("action"))
        .na.drop()
        .groupBy("host", "path")
        .agg((F.max(F.when(F.col("action") == "block", 1).otherwise(0)) == 1).alias("blocks"))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2("rule", 256))
        .select("rule", "blocks", "digest", F.substring("digest", 1, 8).alias("short"), F.length("path").alias("n"))
    )
    lengths = sorted(r.n for r in rules.select("n").distinct().collect()) or [0]
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("head", F.substring("path", 1, max(lengths)))
    expressions = (
        judged.select("host", "head")
        .distinct()
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("prefix", F.explode(path_prefixes(F.col("head"), lengths)))
        .select("host", "head", F.sha2(F.concat("suffix", "prefix"), 256).alias("url_digest"))
        .withColumn("short", F.substring("url_digest", 1, 8))
    )
    best = (
        expressions.join(rules, "short")
        .where(F.col("url_digest") == F.col("digest"))
        .groupBy("host", "head")
        .agg(F.max(F.struct(F.length("rule").alias("length"), "blocks", "rule")).alias("best"))
        .select("host", "head", "best.rule", "best.blocks")
    )
    verdict = F.when(F.col("rule").isNull(), default).when(F.col("blocks"), "block").otherwise("allow")
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return judged.join(best, ["host", "head", "salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
