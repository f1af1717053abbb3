"""Feature maps and vectors over them: names get indices once and for all, batches add new ones at the end, and a protected map takes no more.

A map is a table (name, index); vectors are sparse maps from index to value, so vectors made with earlier states of a map stay valid with later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoints
from .maps import added


def extend_features(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The map (name, index) with the names of ``names`` (name) that ``known`` lacks put after its last index, in the order of the names. Indices count from 0; null names have none."""
    from ..operators.suffixes import places

    ensure_checkpoints(names.sparkSession)
    new = names.where(F.col("name").isNotNull()).select("name").distinct()
    if known is not None:
        new = new.join(known, "name", "left_anti")
    placed = places(new.withColumn("n", F.lit(1).cast("long")), ["name"])
    if known is None:
        return placed.select("name", (F.col("place") - 1).alias("index"))
    # One row: where the new indices begin.
    start = known.agg((F.coalesce(F.max("index"), F.lit(-1)) + 1).alias("_start"))
    return known.unionByName(placed.join(F.broadcast(start), F.lit(True)).select("name", (F.col("_start") + F.col("place") - 1).alias("index")))


def feature_vectors(rows: DataFrame, features: DataFrame) -> DataFrame:
    """(id, vector) of rows (id, name, value) over a protected map: names that it lacks are left out, values of one name add up, zero sums are no entries.

    An id whose names are all unknown has an empty vector.
    """
    met = rows.join(features, "name", "left").groupBy("id", "index").agg(F.sum(F.when(F.col("index").isNotNull(), F.col("value").cast("double"))).alias("value"))
    entries = F.collect_list(F.when(F.col("index").isNotNull() & (F.col("value") != 0), F.struct("index", "value")))
    return met.groupBy("id").agg(F.map_from_entries(F.array_sort(entries)).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    """The sum of products over the indices that both vectors have."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, by) -> Column:
    return F.transform_values(a, lambda k, v: v * by)


def feature_names(vectors: DataFrame, features: DataFrame) -> DataFrame:
    """(id, name, value): vectors (id, vector) spelled out again."""
    return vectors.select("id", F.explode("vector").alias("index", "value")).join(features, "index").select("id", "name", "value")


def _rows(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"), F.concat(F.lit("digits="), F.length(F.col("n_chars").cast("string"))))
    return d.select(F.col("doc_id").alias("id"), "lang", F.explode(named).alias("name"), F.lit(1.0).alias("value"))


def _map(rows: DataFrame) -> DataFrame:
    """First the features of one language, then those of all."""
    return extend_features(rows, extend_features(rows.where("lang = 'en'")))


def q_map(spark, sf_dir):
    return _map(_rows(spark, sf_dir))


def q_vectors(spark, sf_dir):
    """Each document's vector with the sum of all over a map that lacks what only other languages have: their product, and entries."""
    rows = _rows(spark, sf_dir)
    protected = extend_features(rows.where("lang = 'en'"))
    v = feature_vectors(rows, protected)
    total = rows.join(protected, "name").groupBy("index").agg(F.sum("value").alias("value"))
    # As many rows as the map has, in one vector.
    whole = total.agg(F.map_from_entries(F.collect_list(F.struct("index", "value"))).alias("whole"))
    met = v.join(F.broadcast(whole), F.lit(True))
    return met.select("id", F.size("vector").alias("entries"), dot(F.col("vector"), F.col("whole")).alias("product"), F.aggregate(F.map_values(added(F.col("vector"), F.col("vector"), -0.5)), F.lit(0.0), lambda s, x: s + x).alias("half"))


_F = "WITH r AS (SELECT doc_id AS id, lang, unnest(['lang=' || lang, 'source=' || source, 'digits=' || length(n_chars::VARCHAR)]) AS name FROM documents), f AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS index FROM (SELECT DISTINCT name FROM r WHERE lang = 'en' AND name IS NOT NULL))"
QUERIES = {"feature_map": q_map, "feature_vectors": q_vectors}
SQL = {
    "feature_map": f"{_F} SELECT name, index FROM f UNION ALL SELECT name, (SELECT count(*) FROM f) + row_number() OVER (ORDER BY name) - 1 FROM (SELECT DISTINCT name FROM r WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM f))",
    "feature_vectors": f"{_F}, t AS (SELECT name, count(*)::DOUBLE AS n FROM r SEMI JOIN f USING (name) GROUP BY name) SELECT id, count(t.name)::INT AS entries, coalesce(sum(n), 0)::DOUBLE AS product, count(t.name) * 0.5::DOUBLE AS half FROM r LEFT JOIN t USING (name) GROUP BY id",
}
