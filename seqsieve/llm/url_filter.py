"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Only DataFrame functions. One shuffle of (id, url); the rules are joined as Spark sizes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed rules of the query: action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if null or without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty if null or without `://`."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def expressions(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Array of texts: each suffix of the host that has one of the numbers of labels, with each prefix of the path that has one
    of the lengths. Other suffixes can't be a rule's, so a host of very many labels costs no more than its length."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in depths)))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, path.substr(F.lit(1), n))))))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """A row for each row of pages: the key, host, path, rule and verdict; other columns of pages don't matter.

    rules has action (allow or block), host and path. A rule fits its host and all subdomains if the path starts with the
    rule's. The longest rule (host and path) wins; of two equal rules allow wins; without one, rule is null and the verdict
    is `default`. Null urls and those without `://` have empty host and path, which no rule with a host fits.
    Repeated rows stay repeated; null keys stay. No rules or no pages are fine.

    Expressions are joined on the first `prefix_digits` hex digits of their SHA-256; the full digest then confirms.
    What the driver learns of the rules is the sets of lengths of their paths and of numbers of labels of their hosts.
    """
    clean = rules.select("action", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).filter("host != ''")
    clean = clean.groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min("action").alias("action"))
    lengths = sorted(r[0] for r in clean.select(F.length("path")).distinct().collect()) or [0]
    depths = sorted(r[0] for r in clean.select(F.size(F.split("host", r"\."))).distinct().collect()) or [1]
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    held = clean.select(F.concat("host", "path").alias("_rule"), "action").withColumn("_full", digest(F.col("_rule")))
    held = held.select(F.substring("_full", 1, prefix_digits).alias("_short"), F.col("_full").alias("_rule_full"), "_rule", "action")
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).groupBy("_key", "_url").agg(F.count("*").alias("_copies"))
    own = own.withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    each = own.withColumn("_full", F.explode_outer(F.transform(expressions(F.col("_host"), F.col("_path"), depths, lengths), digest)))
    each = each.withColumn("_short", F.substring("_full", 1, prefix_digits)).join(held, "_short", "left")
    won = F.max(F.when(F.col("_full") == F.col("_rule_full"), F.struct(F.length("_rule"), F.col("_rule"), F.col("action"))))
    best = each.groupBy("_key", "_url", "_copies", "_host", "_path").agg(won.alias("_won"))
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return best.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_won._rule").alias("rule"), F.coalesce("_won.action", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
m AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
