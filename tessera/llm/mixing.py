"""Mixing sources to target weights as a time-varying curriculum (native: DataFrame functions only).

Every source has a share of all words (its target) and a schedule: a piecewise-linear density over the
training time 0..1 with integral 1. Target times the integral of the density is the source's cumulative
demand of words at a time. The documents of a source, in a hashed order, supply words: copy ``e`` of a
document starts at ``e * source size + words of the documents before it``. Inverting the demand at that
offset gives the training position of the copy; sorting copies by position gives the mix.

A source may hold any part of the rows: its running sum is taken in hash ranges (one window per source
and range) above pre-aggregated range totals, so no task needs a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import sorted_names
from .store import Tables, named, row_columns, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Density over time of the sources of each weight, as (time, relative density) knots: the first fades, the last comes in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: No document is taken more often.
MOST = 3
#: Hex digits of the hash that make a range: 4096 ranges of each source.
RANGE_DIGITS = 3
#: Sources that are added up in one window.
PART = 10_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, schedule, target) from (source, source_size), a row for each source.

    Water filling: sources are capped at ``most`` times their size in order of cap by weight; a source is
    capped when its cap is below its share of what the sources before it leave.
    """
    tables = Tables(sizes.sparkSession, "targets")
    cap, last = F.lit(most) * F.col("source_size"), F.col("source").isNull()
    ranked = sorted_names(sizes.withColumn("last", last), ["last", "source"], ["source", "source_size", "last"], tables)
    w = ranked.withColumn("k", (F.col("name") % len(weights)).cast("int")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1))
    # Sources in rising order of cap over weight, with what those before them hold: ranges of them are added up first, so no task needs all.
    order = ["ratio", "last", "source"]
    placed = sorted_names(w.withColumn("ratio", F.col("source_size") / F.col("weight")), order, [*order, "source_size", "weight", "k"], tables)
    placed = tables.keep(placed.withColumn("part", F.floor(F.col("name") / PART)))
    parts = placed.groupBy("part").agg(F.sum(cap).alias("caps"), F.sum("weight").alias("part_weight"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("caps").over(along), F.lit(0)).alias("caps_before"), F.coalesce(F.sum("part_weight").over(along), F.lit(0)).alias("weight_before"))
    inside = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    w = placed.join(parts, "part").join(F.broadcast(sums), F.lit(True))
    rest = F.col("total") - F.col("caps_before") - F.coalesce(F.sum(cap).over(inside), F.lit(0))
    weighs = F.col("all_weight") - F.col("weight_before") - F.coalesce(F.sum("weight").over(inside), F.lit(0))
    # The first source that is not capped fixes the level for itself and all after it.
    w = w.withColumn("level", rest.cast("double") / weighs).withColumn("open", cap >= F.col("level") * F.col("weight"))
    level = w.agg(F.min_by("level", F.when(F.col("open"), F.col("name"))).alias("at"))
    w = w.join(F.broadcast(level), F.lit(True))
    target = F.when(cap.cast("double") <= F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("weight"), cap.cast("double")).otherwise(F.col("at") * F.col("weight"))
    return w.select("source", "source_size", "weight", F.col("k").alias("schedule"), target.alias("target"))


def _invert(share: Column, schedule: Column, schedules) -> Column:
    """The time at which a schedule has given out ``share`` (0..1) of its target."""
    out = None
    for k, knots in enumerate(schedules):
        whole = sum((b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
        done, time = 0.0, None
        for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
            m0, m1 = m0 / whole, m1 / whole
            piece, bend = (m0 + m1) / 2 * (t1 - t0), (m1 - m0) / (t1 - t0)
            left = F.greatest(share - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * bend) * left, F.lit(0.0)))
            at = F.lit(t0) + F.when(left > 0, F.lit(2.0) * left / (F.lit(m0) + root)).otherwise(0.0)
            time = F.when(share >= F.lit(done), at) if time is None else F.when(share >= F.lit(done), at).otherwise(time)
            done += piece
        time = F.least(F.greatest(time, F.lit(0.0)), F.lit(1.0))
        out = F.when(schedule == k, time) if out is None else out.when(schedule == k, time)
    return out


def _order(id_: Column, text: Column) -> Column:
    """The hash that orders a source. Rows that share an id, or have none, are told apart by their texts, so they spread over the ranges too."""
    return F.md5(F.concat_ws(" ", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, copies, hash.

    ``copies`` holds (copy, position, words) for each copy that the mix takes words of, ``position`` in 0..1.
    The last copy that a source gives is taken in part, so that its words meet the target (rounded).
    Null sources are one source, the last; null texts and texts without words have size 0 and are never
    taken; repeated rows are taken one by one; equal hashes go by id; no rows give no rows.
    """
    tables = Tables(docs.sparkSession, "mixing")
    sized = tables.keep(docs.select(named(id_col).alias("id"), named(source_col).alias("source"), word_count(named(text_col)).alias("size"), _order(named(id_col), named(text_col)).alias("hash")))
    sized = sized.withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before"))
    ranges = ranges.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    placed = sized.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = Window.partitionBy("s", "r").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    want = F.round("target").cast("long")

    def copy(e):
        # A source without words has target 0; its copies have no words and are left out below.
        start = F.col("offset") + F.lit(e) * F.col("source_size")
        words = F.greatest(F.least(want - start, F.col("size")), F.lit(0)).cast("long")
        return F.struct(F.lit(e).alias("copy"), _invert(F.try_divide(start, F.col("target")), F.col("schedule"), schedules).alias("position"), words.alias("words"))

    taken = F.filter(F.array(*[copy(e) for e in range(most)]), lambda c: c["words"] > 0)
    placed = placed.withColumn("copies", taken).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "copies", "hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` as the mix gives them: a whole row for each copy of which it takes at least half, range-sorted by position.

    Rows with the same id, source and text take the plans made for such rows one each, those equal in all columns counted together, others by a
    hash of their columns (maps left out). Columns may have any names.
    """
    tables = Tables(docs.sparkSession, "mixed")
    bare = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(source_col).alias("source"))
    whole = F.filter("copies", lambda c: F.lit(2) * c["words"] >= F.col("size"))
    copies = plan_mix(bare, "id", "text", "source", **settings).select("id", "source", "hash", F.transform(whole, lambda c: c["position"]).alias("positions"))
    # Most plans are their rows' only ones. Of others the plans with most copies come first.
    copies = copies.groupBy("id", "source", "hash").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(F.size("positions"), "positions")), asc=False).alias("plans"))
    copies = copies.where(F.exists("plans", lambda p: F.size(p["positions"]) > 0)).select(F.col("id").alias("at"), F.col("source").alias("of"), F.col("hash").alias("known"), "n", F.transform("plans", lambda p: p["positions"]).alias("plans"))
    copies = tables.keep(copies)
    rows = docs.select(whole_row(docs), named(id_col).alias("id"), named(source_col).alias("source"), _order(named(id_col), named(text_col)).alias("hash"))
    match = F.col("id").eqNullSafe(F.col("at")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("known"))
    met = rows.join(copies, match)
    out = met.where("n = 1").select("row", F.explode(F.get("plans", F.lit(0))).alias("position"), "id")
    if copies.where("n > 1").limit(1).count():
        out = out.unionByName(_shared(met.where("n > 1"), docs).select("row", "position", "id"))
    return out.orderBy("position", "id").select(*row_columns(docs.columns))


def _shared(met: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, position, id) of rows that share their plans: equal rows are counted before any meet, then each takes as many plans as it counts, one after the other."""
    kinds = dict(docs.dtypes)
    plain = [F.col("row").getField(c) for c in docs.columns if "map<" not in kinds[c] and "variant" not in kinds[c]]
    counted = met.withColumn("order", F.xxhash64(*plain)).groupBy("at", "of", "known", "order").agg(F.first("row").alias("row"), F.first("id").alias("id"), F.first("plans").alias("plans"), F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("at", "of", "known").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    own = F.slice("plans", (F.coalesce(before, F.lit(0)) + 1).cast("int"), F.col("c").cast("int"))
    return counted.withColumn("own", own).select("row", F.explode(F.flatten("own")).alias("position"), "id")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_mix(docs).withColumn("first_position", F.round(F.expr("get(copies, 0).position"), 6))
    return plan.orderBy("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")


def _sql() -> str:
    cases = []
    for k, knots in enumerate(SCHEDULES):
        whole = sum((b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
        done, branches = 0.0, []
        for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
            m0, m1 = m0 / whole, m1 / whole
            bend = (m1 - m0) / (t1 - t0)
            branches.insert(0, f"WHEN share >= {done!r}::DOUBLE THEN {t0!r}::DOUBLE + CASE WHEN share > {done!r}::DOUBLE THEN 2.0::DOUBLE * (share - {done!r}::DOUBLE) / ({m0!r}::DOUBLE + sqrt(greatest({m0 * m0!r}::DOUBLE + {2 * bend!r}::DOUBLE * (share - {done!r}::DOUBLE), 0))) ELSE 0 END")
            done += (m0 + m1) / 2 * (t1 - t0)
        cases.append(f"WHEN k = {k} THEN CASE {' '.join(branches)} END")
    weights = " ".join(f"WHEN k = {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS k, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, CASE {weights} END AS weight FROM k),
f AS (SELECT *, total - coalesce(sum({MOST} * source_size) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place FROM w
      WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest::DOUBLE / weights, place) FILTER (WHERE {MOST} * source_size >= rest::DOUBLE / weights * weight) AS level FROM f),
t AS (SELECT f.*, CASE WHEN level IS NULL OR {MOST}::DOUBLE * source_size <= level * weight THEN {MOST}::DOUBLE * source_size ELSE level * weight END AS target FROM f, l),
o AS (SELECT d.*, t.source_size, t.target, t.k, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, list_sum([greatest(least(round(target)::BIGINT - (off + e * source_size), size), 0) for e in range({MOST})])::BIGINT AS taken, off / target AS share FROM o)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(least(greatest(CASE {' '.join(cases)} END, 0), 1), 6) END AS first_position FROM c
"""


SQL = _sql()
