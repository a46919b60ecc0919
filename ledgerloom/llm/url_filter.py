"""URL filter: host-suffix and path-prefix expressions against a rule list.

Each distinct (host, head of path) is expanded into the expressions that could be a rule. They
meet the rules by an equi-join on a short hash prefix; the full digest then confirms the match,
and the longest confirmed rule decides. Only built-in column functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PREFIX = 8  # hex digits of the short hash
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _expression(host: Column, path: Column) -> Column:
    """Text of an expression; a space can stand in neither of the two parts of a rule."""
    return F.concat(host, F.lit(" "), path)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Host, path, deciding rule and verdict of each row of ``pages`` (page_id, url).

    ``rules`` has rule_host, rule_path and rule_verdict. A rule fits its host and all subdomains
    if the path starts with the rule's path. The longest rule (host and path together, then the
    longer host) wins; of repeated rules with different verdicts ``block`` wins. Without a fitting
    rule the verdict is ``default``. A NULL url or one without ``://`` has an empty host and path.
    Rows of repeated or NULL page_ids are all kept; other columns are not read.

    Rules are a table of any size: the join chooses its strategy from measured sizes. A very
    common host is one row before the expansion.
    """
    spec = rules.select("rule_host", "rule_path", "rule_verdict").dropna()
    spec = spec.withColumn("digest", F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256))
    spec = spec.groupBy("digest", "rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    spec = spec.withColumn("short", F.substring("digest", 1, PREFIX))
    # Only prefixes as long as some rule's path can match; there are few distinct lengths.
    lengths = sorted(r[0] for r in spec.select(F.length("rule_path").alias("n")).distinct().collect())
    head = max(lengths, default=0)

    judged = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("_head", F.substring("path", 1, head))
    places = judged.select("host", "_head").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_head"))
    asked = places.withColumn("_suffix", F.explode(suffixes)).withColumn("_n", F.explode(fitting))
    asked = asked.withColumn("digest", F.sha2(_expression(F.col("_suffix"), F.expr("substring(_head, 1, _n)")), 256))
    asked = asked.select("host", "_head", "digest", F.substring("digest", 1, PREFIX).alias("short"))

    hits = asked.join(spec.withColumnRenamed("digest", "rule_digest"), "short").filter("digest = rule_digest")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "digest"
    )
    best = hits.groupBy("host", "_head").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), order).alias("best")
    )
    out = judged.join(best, ["host", "_head"], "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
