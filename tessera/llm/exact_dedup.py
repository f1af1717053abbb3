"""Exact dedup by deterministic block naming (native: DataFrame functions only).

Texts are equal when identical after deleting white space. Each normalised text is cut into blocks of
a fixed number of code points; the distinct blocks, range-sorted by hash and content, get integer names, their numbers in that order; adjacent names are
paired and the distinct pairs, sorted, named again, round by round, until every document has one name, the same in every run. Two
documents share (level, name) exactly if their normalised texts are identical: names stand for block
contents compared as whole strings, a hash only routes them.

Traffic: distinct blocks cross two shuffles (the first pre-aggregated, so a text copied a million times travels once
per task; the second sorts what is left); everything else moves as 64-bit integers. Joins from many rows to few names are plain
equi-joins whose hot side adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, named, row_columns, whole_row

#: Code points in a block.
BLOCK = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _blocks(norm: Column, size: int) -> Column:
    found = F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(found)


def sorted_names(distinct: DataFrame, by: list[str], keep: list[str], tables: Tables, ranges: int | None = None) -> DataFrame:
    """``keep`` and ``name``: the number of each row of ``distinct`` in the order of its columns ``by``, from 0.

    Rows are sorted in ranges of the first ``ranges`` of those columns (all, without it), a sample of which goes to the driver. A row's number is its place in its range after all rows of the ranges before, so names depend on nothing but the rows.
    """
    # The place is the range's number times 2 ** 33 plus the place in it; it is fixed once written.
    ranged = tables.keep(distinct.repartitionByRange(*by[:ranges]).sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("place")))
    ranged = ranged.withColumn("range", F.shiftright("place", 33)).withColumn("inside", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    # A row for each partition of the sort, so the broadcast is bounded by their number.
    return ranged.join(F.broadcast(starts), "range").select(*keep, (F.col("start") + F.col("inside")).alias("name"))


def exact_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route=F.xxhash64) -> tuple[DataFrame, Tables]:
    """(rid, id, n_chars, text_sha256, level, name) for every row, and the tables behind it.

    ``route`` maps a block to the integer that names it unless two different blocks share it; then
    all rows are named through joins on the blocks themselves.
    """
    tables = Tables(docs.sparkSession, "exact")
    source = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars").cast("long"), normalised(F.col(text_col)).alias("norm"))
    cut = source.select("id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), _blocks(F.col("norm"), block).alias("blocks"))
    distinct = source.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).select(route("block").alias("h"), "block").distinct()
    names = sorted_names(distinct, ["h", "block"], ["h"], tables, 1)
    clash = names.groupBy("h").count().where("count > 1").limit(1).count() > 0
    if clash:
        names = sorted_names(distinct, ["h", "block"], ["h", "block"], tables, 1)
        rows = tables.keep(cut.withColumn("rid", F.monotonically_increasing_id()))
        spread = rows.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", route("block"))
        level = tables.keep(spread.join(names, ["h", "block"]).select("rid", "pos", "name", "n"))
    else:
        rows = tables.keep(cut.select("id", "n_chars", "text_sha256", F.transform("blocks", lambda b: route(b)).alias("hs"), F.monotonically_increasing_id().alias("rid")))
        spread = rows.select("rid", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
        level = tables.keep(spread.join(names, "h").select("rid", "pos", "name", "n"))
    resolved = [level.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    longest, k = level.agg(F.max("n")).first()[0] or 1, 0
    level = level.where("n > 1")
    while longest > 1:
        k, longest = k + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.floor((F.max("n") + 1) / 2).cast("int").alias("n"))
        pairs = tables.keep(pairs)
        pair_names = sorted_names(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], tables)
        level = tables.keep(pairs.join(pair_names, ["a", "b"]).select("rid", "pos", "name", "n"))
        tables.drop(pairs)
        resolved.append(level.where("n = 1").select("rid", F.lit(k).alias("level"), "name"))
        level = level.where("n > 1")
    identity = resolved[0]
    for part in resolved[1:]:
        identity = identity.unionByName(part)
    return tables.keep(rows.drop("hs", "blocks").join(identity, "rid")), tables


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points stays, then the smallest id (null ids last),
    then, among fully repeated rows, one of them. A null text is empty; all empty texts are one group.
    Other columns of ``docs`` are ignored, whatever their names; no rows give no rows.
    """
    ids, tables = exact_identity(docs, id_col, text_col, block, route)
    order = F.struct(-F.col("n_chars"), F.col("id").isNull(), "id", "rid")
    best = ids.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    # Only groups of several rows are joined back, as a table of their own: a plain join, whose hot groups adaptive execution splits.
    best = tables.keep(best.where("group_size > 1").select("level", "name", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")))
    met = ids.join(best, ["level", "name"], "left")
    alone = F.col("keep_rid").isNull()
    return met.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256", "n_chars")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; columns may have any names.

    Of rows that share the id, the normalised text and the length of the one that stays, one is kept: that of the least hash of all its columns but maps.
    """
    text = named(text_col)
    staying = exact_groups(docs.select(named(id_col).alias("id"), text.alias("text")), "id", "text")
    staying = staying.groupBy("id", "text_sha256", "n_chars").agg(F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("many")).where("kept")
    staying = Tables(docs.sparkSession, "exact-rows").keep(staying.select(F.col("id").alias("at"), F.col("text_sha256").alias("sha"), F.col("n_chars").alias("n"), "many"))
    plain = [named(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marked = docs.select(whole_row(docs), named(id_col).alias("id"), F.sha2(normalised(text), 256).alias("own_sha"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("own_n"), F.xxhash64(*plain).alias("order"))
    met = marked.join(staying, F.col("id").eqNullSafe(F.col("at")) & (F.col("own_sha") == F.col("sha")) & (F.col("own_n") == F.col("n")))
    if not staying.where("many").limit(1).count():
        return met.select(*row_columns(docs.columns))
    # Repeated rows are reduced to one by an aggregation, which begins before its exchange; all others pass.
    one = met.where("many").groupBy("at", "sha", "n").agg(F.min_by("row", "order").alias("row")).select("row")
    return met.where("NOT many").select("row").unionByName(one).select(*row_columns(docs.columns))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY norm) AS group_size,
      first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
