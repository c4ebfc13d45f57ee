"""URL filters: a sort-merge range join of reversed-host keys with host and path rules.

A host is turned round label by label ("www.example.com" -> "com.example.www."), so a rule's
host and all its subdomains form one interval of keys, and intervals nest or are disjoint.
Urls and interval ends are sorted together; a running sum of openings and closings is the
depth of the stack, and the value opened last at each level below it is the stack itself.
The innermost active host whose rule paths start the url's path gives the verdict.

The sweep runs in slices: a url goes to the slice of its hash, and the ends of the rule
intervals (two rows per rule host) go to every slice, so that no host, however hot, makes a
large slice, and what is repeated is only the rules.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the
default verdict.  Equal rules count once; of rules that differ in the verdict only, a block
holds.  A rule with a null or empty host fits nothing; a null path reads as empty.
Repeated pages are judged once each; extra columns pass through, whatever their names, but
for those that are named as the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules of the query.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host from the last to the first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and its rules, longest path first (at equal paths block before allow)."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    one = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(F.length("path").alias("n"), "path", F.concat("host", "path").alias("rule"), "verdict")
    return one.groupBy("host").agg(F.sort_array(F.collect_list(rule), asc=False).alias("rules")).select(host_key(F.col("host")).alias("key"), "rules")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, slices: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``rules``: host, path, verdict ('allow' or 'block').  The longest host wins, then the
    longest path.  Only the greatest number of labels in a rule host reaches the driver.
    """
    spark = pages.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = rule_nodes(rules)
    levels = nodes.agg(F.max(F.size(F.split("key", r"\.")) - 1)).first()[0] or 0
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = F.struct(*(F.col(f"`{c}`") for c in own))
    named = [F.col(f"`{c}`") for c in own if not any(t in pages.schema[c].dataType.simpleString() for t in ("map<", "variant"))]  # what can be hashed
    points = pages.select(
        F.pmod(F.xxhash64(*named), F.lit(slices)).alias("slice"),
        host_key(url_host(F.col(url))).alias("key"), F.lit(0).alias("step"), parts.alias("page"),
    )
    ends = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")).alias("slice"), "rules",
        F.explode(F.array(F.struct(F.col("key"), F.lit(1).alias("step")), F.struct(F.regexp_replace("key", r"\.$", "/").alias("key"), F.lit(-1).alias("step")))).alias("end"),
    ).select("slice", F.col("end.key").alias("key"), F.col("end.step").alias("step"), "rules")
    order = Window.partitionBy("slice").orderBy("key", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(ends, allowMissingColumns=True).withColumn("depth", F.sum("step").over(order))
    opened = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == k), F.col("rules")), ignorenulls=True).over(order).alias(f"level{k}") for k in range(1, levels + 1)]
    found = swept.select("page", "depth", *opened).where("page IS NOT NULL")
    host, path = url_host(F.col("page").getField(url)), url_path(F.col("page").getField(url))
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    if levels:
        stack = F.array(*(F.when(F.col("depth") >= k, F.col(f"level{k}")) for k in range(levels, 0, -1)))
        found = found.select("page", F.try_element_at(F.filter(F.flatten(F.filter(stack, lambda s: s.isNotNull())), lambda r: F.startswith(path, r["path"])), F.lit(1)).alias("hit"))
        rule, verdict = F.col("hit.rule"), F.coalesce("hit.verdict", F.lit(default))
    return found.select(*(F.col("page").getField(c).alias(c) for c in own), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_CASES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP1_SQL = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rid
  FROM pages),
r(rh, rp, v) AS (VALUES {_CASES}),
m AS (SELECT p.*, rh || rp AS rule, v,
             row_number() OVER (PARTITION BY rid ORDER BY length(rh) DESC, length(rp) DESC) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM m WHERE k = 1
"""
