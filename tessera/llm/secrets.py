"""Secret scans over a ledger of blobs (native: DataFrame functions only).

Every version of a text is addressed by its content (SHA-256). The ledger has a row for each blob and
rule version that has been scanned, with the findings. A scan takes the blobs whose pair with the
present rule version isn't in the ledger, each once however many paths hold it, and joins the findings
back to all paths. Spans come from the matches and the gaps between them: the gaps' and matches' lengths
in code points add up to offsets, in one running sum along each blob and rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, exists

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: (kind, pattern, group whose length counts, least length), in the order in which kinds are listed; "base" ones first.
#: Runs of a class are matched with their least length at once where that leaves the same matches.
BASE_RULES = (
    ("assign", rf"""(?:{_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What this method finds besides.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"


def _pieces(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<rank, at, gap, size, keep>>: the leftmost non-overlapping matches in order, each with the code points between it and the one before; empty without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("m"), part.alias("k"))
    # What follows the last match has no match of its own.
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.cast("long").alias("at"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), (F.length(x["k"]) >= least).alias("keep")))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<rank:int,at:bigint,gap:bigint,size:bigint,keep:boolean>>"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_texts(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, findings): the sorted spans of each different blob of (blob, content), in time proportional to the matches.

    Matches leave their texts as rows of numbers; the running sum of gaps and sizes along a blob and rule gives the spans. A blob that stands in several rows counts once.
    """
    every = F.flatten(F.array(*[_pieces(F.col("content"), k, *rule[1:]) for k, rule in enumerate(rules)]))
    # One exchange, by blob; what follows needs no other. Blobs without a match keep a row of nulls.
    found = blobs.select("blob", F.explode_outer(every).alias("p")).select("blob", "p.*").repartition("blob").dropDuplicates(["blob", "rank", "at"])
    along = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(along)
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in rules]), F.col("rank") + 1)
    placed = found.withColumn("end", end).select("blob", F.when(F.col("keep"), F.struct((F.col("end") - F.col("size")).alias("start"), "end", "rank", kind.alias("kind"))).alias("span"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("findings"))


def scan_versions(versions: DataFrame, content_col: str = "text", key_col: str = "doc_id", ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows) for a table of versions.

    versions: a row for each historical version of each path; ``key_col`` tells rows apart cheaply (rows
    that share it and their content are scanned together). ledger: (blob, rule_version, findings) of earlier scans.
    Null contents are empty; very long ones, with any number of matches, are scanned whole; spans that tie go by their end, then by the order of the rules; other columns are ignored, whatever their names; repeated rows each get the findings; no rows give no rows. The ledger returned holds what
    this scan added, blobs without findings too; append it to the earlier one.
    """
    tables = Tables(versions.sparkSession, "secrets")
    content = F.coalesce(F.col(content_col), F.lit(""))
    addressed = tables.keep(versions.select(F.col(key_col).alias("key"), F.sha2(content, 256).alias("blob")))
    unseen = addressed.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    texts = versions.select(F.col(key_col).alias("at"), F.sha2(content, 256).alias("blob"), content.alias("content"))
    todo = texts.join(unseen.select("key", F.col("blob").alias("want")), F.col("at").eqNullSafe(F.col("key")) & (F.col("blob") == F.col("want")))
    fresh = tables.keep(scan_texts(todo, rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings"))
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == rule_version).select(*fresh.columns))
    # Blobs without findings need no join: paths keep the empty list.
    found = known.where(F.size("findings") > 0).select("blob", "findings")
    empty = F.array().cast(found.schema["findings"].dataType)
    by_path = addressed.join(found, "blob", "left").select(F.col("key").alias(key_col), "blob", F.coalesce("findings", empty).alias("findings"))
    return by_path, fresh


def scan_with_ledger(versions: DataFrame, path: str, **settings) -> DataFrame:
    """Findings by path as of ``scan_versions``, with the ledger at ``path``: read if there is one, and what this scan added appended."""
    spark = versions.sparkSession
    ledger = spark.read.parquet(path) if exists(spark, path) else None
    found, fresh = scan_versions(versions, ledger=ledger, **settings)
    fresh.write.mode("append").parquet(path)
    return found


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """The ledger is kept between runs where the setting tessera.secrets.ledger names a folder for it; else each run starts a new one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = spark.conf.get("tessera.secrets.ledger", None)
    found = scan_with_ledger(docs, path) if path else scan_versions(docs)[0]
    base = F.filter("findings", lambda s: s["rank"] < len(BASE_RULES))

    def count(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r[0]) for r in BASE_RULES], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT row, {rank} AS rank, '{kind}' AS kind, (list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s, length(m[i]) AS n FROM "
            f"(SELECT row, unnest(range(1, len(m) + 1)) AS i, g, m, k FROM (SELECT row, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS k FROM d WHERE regexp_matches(t, '{p}'))) WHERE length(k[i]) >= {least}"
        )
    listed = "coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, s + n, rank){f}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r[0]}') AS n_{r[0]}" for r in BASE_RULES)
    base = listed.replace("{f}", f" FILTER (WHERE rank < {len(BASE_RULES)})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {listed.replace('{f}', '')} AS spans FROM d LEFT JOIN f USING (row) GROUP BY row, doc_id
"""


SQL = _sql()
