"""URL filters by expressions of host suffix and path prefix.

A URL expands into expressions: every suffix of its host's labels with every prefix of its path that
ends in "/" (and the empty one). A rule is filed under its own host and the longest such prefix of its
path. Expressions meet rules in an equi-join on the first bytes of their SHA-256; full digests confirm,
then the rest of the rule's path is compared. The longest rule wins; of equally long ones the one with the
longer host, then "block".

Only distinct URLs expand, and only to the depth of the deepest rule: what cannot match isn't made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The verdict of a URL that no rule fits.
DEFAULT = "allow"
#: Hex digits of the digest in the join key.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://", A-Z lower-cased, and path up to "?" or "#"; empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def _suffixes(host: Column, most: Column) -> Column:
    """Suffixes of whole labels, with at most so many labels as any rule has."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), most)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _prefixes(path: Column, most: Column) -> Column:
    """The empty prefix and those that end in "/", with at most so many "/" as any rule has."""
    parts = F.split(path, "/", -1)
    slashes = F.least(F.size(parts) - 1, most)
    return F.transform(F.sequence(F.lit(0), slashes), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def _key(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of ``pages`` with these names are replaced).

    rules: (host, path, verdict); a repeated rule counts once, rules with a null are left out. A null URL or one without "://"
    has no host and no path and gets the default, as does every URL that no rule fits. Repeated pages each get their verdict.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    depth = rules.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\.", -1))), F.lit(1)).alias("labels"), F.coalesce(F.max(F.size(F.split("rule_path", "/", -1)) - 1), F.lit(0)).alias("slashes")).first()
    filed = rules.withColumn("digest", _key(F.col("rule_host"), F.regexp_extract("rule_path", "^(?s)(.*/)?", 0))).withColumn("short", F.substring("digest", 1, SHORT))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    spread = urls.where("host != ''").select("url", "path", F.explode(_suffixes(F.col("host"), F.lit(depth["labels"]))).alias("suffix"))
    spread = spread.select("url", "path", "suffix", F.explode(_prefixes(F.col("path"), F.lit(depth["slashes"]))).alias("prefix"))
    expressions = spread.withColumn("full", _key(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, SHORT))
    fits = expressions.join(filed, "short").where((F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), name.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy("url").agg(F.max(order).alias("best")).select(F.col("url").alias("__rule_url"), F.col("best").alias("__rule_best"))
    host, path = host_and_path(F.col(url_col))
    met = pages.join(best, F.col(url_col) == F.col("__rule_url"), "left")
    return met.withColumns({"host": host, "path": path, "rule": F.col("__rule_best.rule"), "verdict": F.coalesce(F.col("__rule_best.verdict"), F.lit(default))}).drop("__rule_url", "__rule_best")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH r(h, p, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
a AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT row, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT row, page_id, translate(coalesce(raw, ''), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(substr(rest, length(raw) + 1), ''), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), '{DEFAULT}') AS verdict
FROM c LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY row, page_id, host, path
"""
