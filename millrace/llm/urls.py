"""URL rules applied by a sort-merge range join.

The labels of a host, reversed and joined with a separator that sorts before everything else, form
a key in which a domain and its subdomains are one interval, so rule hosts are nested or disjoint
intervals. Rules and urls are sorted by this key together, and the sweep carries the stack of rules
whose intervals are open at the last rule it met: the rules of that host and of all hosts around
it. A url falls under those of the stack whose host interval contains it and whose path its own
path starts with; the longest of them gives the verdict.

The sweep runs in parts: a part holds the urls of one top label and one salt of many, and all rules
under that label, so a host with a third of all urls is spread over all salts.

Defined results: a null url or one without `://` has an empty host and path and gets the default
verdict, as does every url that no rule fits; repeated rows give repeated rows; no rules at all
leave every url to the default; among rules of equal length the one of the longer host wins, then
block before allow. Other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SALTS = 64
_END = "\u0001"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by the separator."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END))


def top_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: key, top and the stack of all rules of this host and those around it.

    `rules` has host, path and verdict.
    """
    rules = rules.select(_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    own = rules.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    pairs = own.select("host", F.explode(around).alias("outer"))
    outer = own.select(F.col("host").alias("outer"), F.col("own").alias("theirs"))
    stacks = pairs.join(outer, "outer").groupBy("host").agg(F.flatten(F.collect_list("theirs")).alias("stack"))
    return stacks.select(host_key(F.col("host")).alias("key"), top_label(F.col("host")).alias("top"), "stack")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url)."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("url", "page_id"), F.lit(salts)).cast("int").alias("salt"))
    urls = urls.select("page_id", "host", "path", "salt", host_key(F.col("host")).alias("key"), top_label(F.col("host")).alias("top"), F.lit(1).alias("kind"))
    stacks = rule_stacks(rules)
    opened = stacks.select("key", "top", "stack", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"))
    events = urls.unionByName(opened, allowMissingColumns=True)
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter(F.col("kind") == 1)
    # of the open intervals at the last rule, those that still contain this key
    fits = F.filter("stack", lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))
    best = F.array_max(ranked)
    return met.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
q AS (
  SELECT page_id, path,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM p),
r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT q.page_id, q.host, q.path, r.*,
         row_number() OVER (PARTITION BY q.page_id ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM q LEFT JOIN r ON (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict
FROM f WHERE n = 1
"""
