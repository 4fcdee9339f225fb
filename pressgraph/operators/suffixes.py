"""Public suffixes of hosts, by a joinable table of rules.

A rule is a line of a public suffix list: ``com.pl``, a wildcard ``*.ck`` or an
exception ``!www.ck``.  Of the rules that a host ends in an exception wins, else
the one with most labels; a host that meets none has its last label as suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgraph.functions import urls as U

_ADDRESS = r"^\d+(\.\d+){3}$"


def suffix_rules(lines: DataFrame) -> DataFrame:
    """``(rule)``: distinct rules of the lines ``(value)`` of a list; comments and blank lines are left out."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    return lines.select(rule.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    return suffix_rules(spark.read.text(path))


def fixed_suffix_rules(spark: SparkSession, rules: Sequence[str] = U.MULTI_LABEL_SUFFIXES) -> DataFrame:
    return suffix_rules(spark.createDataFrame([(r,) for r in rules], "value string"))


def _tail(labels: Column, at: Column) -> Column:
    return F.array_join(F.slice(labels, at + 1, F.greatest(F.size(labels) - at, F.lit(0))), ".")


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, suffix, registered_domain, brand, subdomain)`` of the distinct hosts of ``hosts`` (host).

    Addresses of four numbers, hosts of one label and hosts that are a suffix have no registered domain: brand and
    registered domain are the host itself.  Null hosts and those with empty labels give no suffix.
    """
    distinct = hosts.select("host").filter(F.col("host").isNotNull()).distinct()
    labels = F.split("host", r"\.")
    named = ~F.col("host").rlike(_ADDRESS) & ~F.array_contains(labels, "")
    at = F.sequence(F.lit(0), F.size(labels) - 1)
    keys = F.flatten(F.transform(at, lambda i: F.array(
        F.struct(_tail(labels, i).alias("rule"), (F.size(labels) - i).alias("n")),
        F.struct(F.concat(F.lit("*."), _tail(labels, i + 1)).alias("rule"), (F.size(labels) - i).alias("n")),
        F.struct(F.concat(F.lit("!"), _tail(labels, i)).alias("rule"), (F.size(labels) - i - 1).alias("n")))))
    met = distinct.filter(named).select("host", F.explode(keys).alias("k")).select("host", "k.rule", "k.n").join(rules, "rule")
    excepted = F.col("rule").startswith("!")
    longest = met.groupBy("host").agg(F.max(F.struct(excepted.alias("excepted"), F.col("n"))).alias("best"))
    n = F.when(~named, 0).otherwise(F.coalesce("best.n", F.lit(1)))
    d = distinct.join(longest, "host", "left").select("host", labels.alias("labels"), n.alias("n"))
    own = F.size("labels") - F.col("n") - 1  # place of the registered label
    whole = (F.col("n") == 0) | (own < 0)
    return d.select(
        "host",
        _tail(F.col("labels"), F.size("labels") - F.col("n")).alias("suffix"),
        F.when(whole, F.col("host")).otherwise(_tail(F.col("labels"), own)).alias("registered_domain"),
        F.when(whole, F.col("host")).otherwise(F.get("labels", own)).alias("brand"),
        F.when(whole, "").otherwise(F.array_join(F.slice("labels", F.lit(1), F.greatest(own, F.lit(0))), ".")).alias("subdomain"))


def with_suffixes(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with suffix, registered_domain, brand and subdomain of the host of ``url``."""
    keyed = df.withColumn("host", U.host(url))
    return keyed.join(host_suffixes(keyed, rules), "host", "left")
