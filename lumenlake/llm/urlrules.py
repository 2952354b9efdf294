"""URL rules by a sorted sweep, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's.  A url is keyed once for each of its host's suffixes: reversed host labels, a
separator, the path.  A rule's key is then a plain prefix of the keys that it fits, that is,
an interval [key, key + FF) of byte strings.  (A rule fits subdomains too, and those lie between its
host and its path in any order of whole keys, so the host's part is met by the suffixes and the
intervals nest by path.)  Openings, closings and urls are sorted by key;
the running sum of +1 and -1 is the height of the stack of open rules, and the last rule that
opened at the present height is the stack's top, the longest rule open for that key.  Of a
url's suffixes the longest rule wins.

Separators that occur in a host are escaped, so that no host can pass for another.

The sweep runs per suffix that has rules.  A suffix with many urls is cut into salts, with the
suffix's rules repeated in each, so that no host, however common, is one task's work.

Edge cases: null urls and urls without ``://`` have an empty host and path and no rule; a rule
with a null host or path, or an unknown verdict, is ignored; of equal rules with differing
verdicts block wins; of fitting rules of equal length that with the longer host wins; repeated
urls are judged once and joined back, very common ones without a shuffle; urls of any length are
processed whole; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import ascii_lower, joined_hot

SALT_ROWS = 5_000
LABEL_END = "\u0001"
PATH_START = "\u0002"
ESCAPE = "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(raw_host), path


def _labels(host: Column) -> Column:
    """A host's labels, last first, without a bare separator in any."""
    for code, mark in ((ESCAPE, "c"), (LABEL_END, "a"), (PATH_START, "b")):
        host = F.replace(host, F.lit(code), F.lit(ESCAPE + mark))
    return F.reverse(F.split(host, "\\."))


def _suffix_keys(host: Column) -> Column:
    """The reversed-label key of each suffix of a host, shortest first."""
    labels = _labels(host)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), LABEL_END), F.lit(LABEL_END)),
    )


def _host_key(host: Column) -> Column:
    return F.concat(F.array_join(_labels(host), LABEL_END), F.lit(LABEL_END))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A table of rules (host, path, verdict) made of literals."""
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(suffix, rule_path, verdict, length, host_length, rule): one row per distinct host and path."""
    clean = rules.where(
        F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block")
    ).select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    return (
        clean.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            _host_key(F.col("host")).alias("suffix"),
            F.col("path").alias("rule_path"),
            "verdict",
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            F.concat("host", "path").alias("rule"),
        )
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = prepared_rules(rules)
    # each distinct host and path once, keyed by those suffixes that have rules
    distinct = rows.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("_one")).drop("_one")
    keyed = distinct.select("host", "path", F.explode(_suffix_keys(F.col("host"))).alias("suffix"))
    points = keyed.join(known.select("suffix").distinct(), "suffix", "left_semi")
    salts = points.groupBy("suffix").agg(
        F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("salts")
    )
    salted = points.join(salts, "suffix").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int"))
    spread = known.join(salts, "suffix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = F.encode(F.concat("suffix", F.lit(PATH_START), "path"), "UTF-8")
    rule_key = F.encode(F.concat("suffix", F.lit(PATH_START), "rule_path"), "UTF-8")
    payload = F.struct("length", "host_length", "rule", "verdict")
    none = F.lit(None)
    opens = spread.select(
        "suffix", "salt", rule_key.alias("key"), F.lit(1).alias("step"), F.lit(0).alias("kind"), payload.alias("opened"),
        none.cast("string").alias("host"), none.cast("string").alias("path"),
    )
    closes = opens.select(
        "suffix", "salt", F.expr("concat(key, X'FF')").alias("key"), F.lit(-1).alias("step"), F.lit(2).alias("kind"),
        F.when(F.lit(False), F.col("opened")).alias("opened"), "host", "path",
    )
    urls = salted.select(
        "suffix", "salt", key.alias("key"), F.lit(0).alias("step"), F.lit(1).alias("kind"),
        none.cast(opens.schema["opened"].dataType).alias("opened"), "host", "path",
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("suffix", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        opens.unionByName(closes)
        .unionByName(urls)
        .repartition("suffix", "salt")  # else the windows would take over the joins' partitions by suffix alone
        .withColumn("height", F.sum("step").over(sweep))
        .withColumn("top", F.last("opened", ignorenulls=True).over(slot))
        .where("kind = 1 AND height > 0")
    )
    best = swept.groupBy("host", "path").agg(F.max("top").alias("best"))
    found = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return joined_hot(rows, found, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
