"""Interval joins: which range holds a position, which range comes last before it, and insertion into merged ranges.

Containment: a range of length l is filed at the level whose bins are at least as long as l, so it lies in two bins at
most, however long it is; a position asks one bin of each level that occurs. That is an equi-join on (key, level, bin),
with the exact bounds checked after it, and no position meets ranges that are far away.

Precedence: positions and ranges of a key share bins; inside a bin a running maximum gives the last range before a position, and for
positions before the first range of their bin the last range of an earlier bin is carried over from the bins' own maxima. A key with any number
of positions is so cut into bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoints
from .ngrams import _W, frequent_places, merge_ranges, phrase_locations, positions, word_arrays

#: Length of the bins of the lowest level, as a power of two.
LOWEST = 3
#: Levels lie so many powers of two apart: a position asks fewer bins, and a bin holds ranges of 8 times different lengths at most.
APART = 3


def _level(length: Column) -> Column:
    """The least level (``LOWEST`` and every ``APART``-th above it) whose bins, of 2 ** level positions, are as long as a range."""
    return (LOWEST + APART * F.ceil((F.greatest(F.lit(LOWEST), F.length(F.bin(F.greatest(length - 1, F.lit(0))))) - LOWEST) / APART)).cast("int")


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str = "at", how: str = "inner") -> DataFrame:
    """``points`` with ``start`` and ``end`` of the ranges (key, start, end; both ends count) that hold them: a row for each.

    ``how`` is inner, left (points in no range have nulls), left_semi (the points that are covered) or left_anti. Null keys and positions are in no range; ranges that
    end before they start hold nothing; repeated points and ranges each count.
    """
    if how != "inner":
        # Of the levels asked, those that don't answer aren't rows of their own: points are told apart by all their columns.
        held = containing(points.distinct().where(F.col(at).isNotNull()), ranges, key, at)
        same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in points.columns]
        if how in ("left_semi", "left_anti"):
            return points.join(held, same(points, held), how)
        right = held.select(*[F.col(c).alias(f"_{c}") for c in points.columns], "start", "end")
        on = [points[c].eqNullSafe(right[f"_{c}"]) for c in points.columns]
        return points.join(right, on, "left").select(*[points[c] for c in points.columns], "start", "end")
    ensure_checkpoints(ranges.sparkSession)
    # Read for the levels and for the join.
    sized = ranges.where((F.col("end") >= F.col("start")) & F.col(key).isNotNull()).withColumn("_level", _level(F.col("end") - F.col("start") + 1)).checkpoint()
    # A range is no longer than a bin, so it lies in two.
    bin_of = lambda bound: F.expr(f"shiftright(cast(`{bound}` AS bigint), _level)")
    filed = sized.select(F.col(key).alias("_key"), "start", "end", "_level", F.explode(F.array_distinct(F.array(bin_of("start"), bin_of("end")))).alias("_in_bin"))
    # At most 22 levels occur, whatever the ranges are.
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    asked = points.withColumn("_at", F.explode_outer(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col(at).cast("long"), n).alias("bin")) for n in levels]) if levels else F.lit(None).cast("array<struct<level:int,bin:bigint>>")))
    match = (F.col(key) == F.col("_key")) & (F.col("_at.level") == F.col("_level")) & (F.col("_at.bin") == F.col("_in_bin")) & F.col(at).between(F.col("start"), F.col("end"))
    return asked.join(filed, match).select(*points.columns, "start", "end")


def preceding(points: DataFrame, ranges: DataFrame, key: str, at: str = "at", bits: int = 10) -> DataFrame:
    """``points`` with ``start`` and ``end`` of the range (key, start, end) that starts last before them (not where they are); nulls if there is none.

    Of ranges that start together the longest counts. Bins have 2 ** bits positions. Null keys and positions have no such range.
    """
    ensure_checkpoints(ranges.sparkSession)
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    unknown = points.where(~known).select(*points.columns, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    points = points.where(known)
    point = F.struct(*[F.col(c) for c in points.columns])
    bin_of = lambda c: F.shiftright(F.col(c).cast("long"), bits)
    marks = ranges.where(F.col(key).isNotNull() & F.col("start").isNotNull()).groupBy(F.col(key).alias("_key"), F.col("start").cast("long").alias("_start")).agg(F.max(F.col("end").cast("long")).alias("_end"))
    # Read for the bins' maxima and beside the positions.
    marks = marks.withColumn("_bin", bin_of("_start")).withColumn("_range", F.struct("_start", "_end")).checkpoint()
    # The last range of each bin that has one, and the bin in which the next one stands: bins between them take it over.
    lasts = marks.groupBy("_key", "_bin").agg(F.max("_range").alias("_last"))
    along = Window.partitionBy("_key").orderBy("_bin")
    lasts = lasts.select("_key", F.struct((F.col("_bin") + 1).alias("from"), F.coalesce(F.lead("_bin").over(along), F.lit((1 << 62) - 1)).alias("to")).alias("_of"), "_last")
    # A position's own bin, and the range carried into it.
    both = points.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_start"), bin_of(at).alias("_bin"), F.lit(None).cast("struct<_start:bigint,_end:bigint>").alias("_range"), point.alias("_point"))
    both = both.unionByName(marks.select("_key", "_start", "_bin", "_range", F.lit(None).cast(both.schema["_point"].dataType).alias("_point")))
    inside = Window.partitionBy("_key", "_bin").orderBy("_start").rangeBetween(Window.unboundedPreceding, -1)
    own = both.withColumn("_found", F.max("_range").over(inside)).where(F.col("_point").isNotNull()).checkpoint()
    near = own.where(F.col("_found").isNotNull()).select("_point.*", F.col("_found._start").alias("start"), F.col("_found._end").alias("end"))
    far = own.where(F.col("_found").isNull()).select("_point.*", "_bin")
    reach = lasts.select(F.col("_key").alias(key), F.col("_of.from").alias("start"), F.col("_of.to").alias("end"), "_last")
    # The stretches of bins between ranges are ranges themselves.
    carried = containing(far.select(key, "_bin").distinct(), reach.select(key, "start", "end"), key, "_bin")
    carried = carried.join(reach, [key, "start", "end"]).select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), "_last")
    rest = far.join(carried, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")), "left")
    return near.unionByName(rest.select(*points.columns, F.col("_last._start").alias("start"), F.col("_last._end").alias("end"))).unionByName(unknown)


def insert_ranges(ranges: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merged ``ranges`` (key, start, end) with ``new`` ones put in; only the keys that get any are merged again."""
    touched = ranges.join(new.select(key).distinct(), key, "left_semi")
    rest = ranges.join(new.select(key).distinct(), key, "left_anti")
    return rest.select(key, "start", "end").unionByName(merge_ranges(touched.select(key, "start", "end").unionByName(new.select(key, "start", "end")), key))


def _repeated(spark, sf_dir):
    """Stretches of documents covered by trigrams that occur four times, merged."""
    arrays = word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).withColumnRenamed("doc_id", "rec")
    return merge_ranges(frequent_places(arrays, "rec", 3, 4).withColumn("end", F.col("start") + 2), "rec")


def _places(spark, sf_dir):
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return phrase_locations(tok, ["the"]).select("rec", F.col("start").alias("at"))


def q_containing(spark, sf_dir):
    """Where "the" stands, with the repeated stretch around it if there is one."""
    return containing(_places(spark, sf_dir), _repeated(spark, sf_dir), "rec", how="left")


def q_covered(spark, sf_dir):
    """By document, how many of those places are covered."""
    return containing(_places(spark, sf_dir), _repeated(spark, sf_dir), "rec", how="left_semi").groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


def q_preceding(spark, sf_dir):
    """Where "the" stands, with the repeated stretch that starts last before it."""
    return preceding(_places(spark, sf_dir), _repeated(spark, sf_dir), "rec")


_R = (
    f"WITH {_W}, t AS (SELECT doc_id, i - 1 AS s, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)), f AS (SELECT a, b, c FROM t GROUP BY ALL HAVING count(*) >= 4), m AS (SELECT doc_id, s, s + 2 AS e FROM t SEMI JOIN f USING (a, b, c)), "
    "n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n), r AS (SELECT doc_id AS rec, min(s)::BIGINT AS start, max(e)::BIGINT AS end FROM g GROUP BY doc_id, k), "
    "p AS (SELECT doc_id AS rec, i - 1 AS at FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] = 'the')"
)
QUERIES = {"range_containing": q_containing, "range_covered": q_covered, "range_preceding": q_preceding}
SQL = {
    "range_containing": f"{_R} SELECT p.rec, p.at, r.start, r.end FROM p LEFT JOIN r ON p.rec = r.rec AND p.at BETWEEN r.start AND r.end",
    "range_covered": f"{_R} SELECT rec, count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.rec = p.rec AND p.at BETWEEN r.start AND r.end) GROUP BY rec",
    "range_preceding": f"{_R} SELECT p.rec, p.at, r.start, r.end FROM (SELECT *, (SELECT max(start) FROM r WHERE r.rec = p.rec AND r.start < p.at) AS s FROM p) p LEFT JOIN r ON r.rec = p.rec AND r.start = p.s",
}
