"""Maps as structures, hash tables and sparse arrays; character maps; bits by ranges; word ids with 0 for unknown words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(m: Column, key, default=None) -> Column:
    """The value of a key, or ``default``."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default)) if default is not None else F.try_element_at(m, F.lit(key))


def remove(m: Column, key) -> Column:
    return F.map_filter(m, lambda k, v: k != F.lit(key))


def put(m: Column, key, value: Column) -> Column:
    """With the key's value set, whether it was there or not."""
    return F.map_concat(remove(m, key), F.create_map(F.lit(key), value))


def put_new(m: Column, key, value: Column) -> Column:
    """With the key's value set only if there was none."""
    return F.when(F.map_contains_key(m, F.lit(key)), m).otherwise(F.map_concat(m, F.create_map(F.lit(key), value)))


def replace(m: Column, key, value: Column) -> Column:
    """With the key's value set only if there was one."""
    return F.transform_values(m, lambda k, v: F.when(k == F.lit(key), value).otherwise(v))


def add_count(m: Column, key, n: Column) -> Column:
    """With n added to the key's count, which is 0 where there is none."""
    return put(m, key, F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0)) + n)


def field_names(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def between(m: Column, low, high) -> Column:
    """The entries of a sparse array whose index lies in low..high, both included."""
    return F.map_filter(m, lambda k, v: (k >= F.lit(low)) & (k <= F.lit(high)))


def added(a: Column, b: Column, scale=1.0) -> Column:
    """The sum of two sparse vectors, the second one scaled; entries that only one has count too."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.lit(scale) * F.coalesce(y, F.lit(0.0)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a stands before, with or after b; nulls stand first and are equal."""
    both = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(both)


def mapped(text: Column, source: str, target: str) -> Column:
    """Characters of ``source`` replaced by those of ``target`` in the same places; those without a partner go."""
    return F.translate(text, source, target)


def insert_text(text: Column, at: int, more: Column) -> Column:
    """``more`` put before the character at 0-based place ``at``."""
    return F.concat(F.substring(text, 1, at), more, F.substring(text, at + 1, 1 << 30))


def elide_text(text: Column, start: int, stop: int) -> Column:
    """Without the characters start..stop, both included and counted from 0."""
    return F.concat(F.substring(text, 1, start), F.substring(text, stop + 2, 1 << 30))


def bits_overlap(a: Column, b: Column) -> Column:
    """Whether two bit vectors (arrays of 0 and 1) have a bit in common."""
    return F.exists(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0)) == 1) & (F.coalesce(y, F.lit(0)) == 1)), lambda x: x)


def set_range(a: Column, low: int, high: int, value: int = 1) -> Column:
    """With bits low..high, both included, set to a value; a vector that ends before is made longer."""
    longer = F.concat(a, F.array_repeat(F.lit(0), F.greatest(F.lit(high + 1) - F.size(a), F.lit(0))))
    return F.transform(longer, lambda x, i: F.when((i >= low) & (i <= high), value).otherwise(x))


def cleared(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(0))


def word_ids(words: DataFrame, vocabulary: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with ``id`` from vocabulary(word, id), 0 for words that it doesn't hold."""
    known = vocabulary.select(F.col("word").alias("_known"), F.col("id"))
    return words.join(known, F.col(word_col) == F.col("_known"), "left").drop("_known").withColumn("id", F.coalesce("id", F.lit(0)))


def words_of_ids(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``ids`` with ``word``, null for 0 and unknown ids."""
    return ids.join(vocabulary.select("id", "word"), "id", "left")


def extend_vocabulary(vocabulary: DataFrame, words: DataFrame, word_col: str = "word") -> DataFrame:
    """The vocabulary with new words; ids that were given stay, new ones follow them in order of the words."""
    from ..operators.ngrams import vocabulary as numbered

    new = words.select(F.col(word_col).alias("word")).join(vocabulary.select("word"), "word", "left_anti")
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return vocabulary.select("word", "id").unionByName(numbered(new).join(F.broadcast(last)).select("word", (F.col("id") + F.col("last")).alias("id")))


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def q_map_functions(spark, sf_dir):
    p = _parts(spark, sf_dir)
    m = F.map_from_arrays(F.array(F.lit("key"), F.lit("size")), F.array(F.col("p_partkey"), F.col("p_size").cast("long")))
    n = put_new(add_count(add_count(put(m, "key", F.lit(7).cast("long")), "size", F.lit(2).cast("long")), "seen", F.lit(1).cast("long")), "size", F.lit(0).cast("long"))
    p = p.withColumns({"m": m, "n": n})
    return p.select("p_partkey", get(F.col("n"), "key").alias("k"), get(F.col("n"), "size").alias("s"), get(F.col("n"), "none", -1).cast("long").alias("d"), F.array_join(field_names(F.col("n")), ",").alias("names"), F.array_join(field_names(remove(F.col("n"), "size")), ",").alias("left"), get(replace(F.col("m"), "seen", F.lit(3).cast("long")), "seen", 0).cast("long").alias("r"))


def q_sparse_arrays(spark, sf_dir):
    """Quantities by line number of each order: those of lines 2 to 4, and the whole with these added twice."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("w"))
    lines = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "w"))).alias("q"))
    part = between(F.col("q"), 2, 4)
    both = added(F.col("q"), part, 2.0)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    return lines.select("l_orderkey", F.size(part).cast("long").alias("n"), F.round(total(part), 4).alias("slice"), F.round(total(both), 4).alias("sum"))


def q_strings(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return p.select("p_partkey", mapped(F.col("p_name"), "aeiou", "AEI").alias("mapped"), insert_text(F.col("p_name"), 3, F.lit("<>")).alias("inserted"), elide_text(F.col("p_name"), 1, 2).alias("elided"), compare(F.reverse("p_name"), F.reverse(F.lower("p_type"))).cast("int").alias("order"))


def q_bit_ranges(spark, sf_dir):
    p = _parts(spark, sf_dir)
    bits = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(F.col(c) / F.pow(F.lit(2.0), i)), F.lit(2)).cast("int"))
    a, b = bits("p_size", 6), bits("p_partkey", 4)
    return p.select("p_partkey", bits_overlap(a, b).alias("overlap"), F.array_join(set_range(a, 4, 7).cast("array<string>"), "").alias("ranged"), F.array_join(set_range(b, 1, 2, 0).cast("array<string>"), "").alias("off"), F.array_join(cleared(b).cast("array<string>"), "").alias("cleared"))


def q_word_ids(spark, sf_dir):
    """The words of the benchmark by their ids in the documents' vocabulary, 0 where it lacks them."""
    from ..operators.ngrams import positions, vocabulary

    known = vocabulary(positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
    asked = positions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id").withColumnRenamed("rec", "item_id")
    return word_ids(asked, known).select("item_id", "pos", "word", "id")


QUERIES = {"map_functions": q_map_functions, "sparse_arrays": q_sparse_arrays, "string_functions": q_strings, "bit_ranges": q_bit_ranges, "word_ids": q_word_ids}
SQL = {
    "map_functions": "SELECT p_partkey, 7::BIGINT AS k, p_size::BIGINT + 2 AS s, -1::BIGINT AS d, 'key,seen,size' AS names, 'key,seen' AS \"left\", 0::BIGINT AS r FROM part",
    "sparse_arrays": "SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 2 AND 4) AS n, round(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber BETWEEN 2 AND 4), 0), 4) AS slice, round(sum(l_quantity) + 2 * coalesce(sum(l_quantity) FILTER (WHERE l_linenumber BETWEEN 2 AND 4), 0), 4) AS sum FROM lineitem GROUP BY l_orderkey",
    "string_functions": "SELECT p_partkey, replace(replace(translate(p_name, 'aei', 'AEI'), 'o', ''), 'u', '') AS mapped, substr(p_name, 1, 3) || '<>' || substr(p_name, 4) AS inserted, substr(p_name, 1, 1) || substr(p_name, 4) AS elided, CASE WHEN reverse(p_name) < reverse(lower(p_type)) THEN -1 WHEN reverse(p_name) > reverse(lower(p_type)) THEN 1 ELSE 0 END AS \"order\" FROM part",
    "bit_ranges": "WITH b AS (SELECT p_partkey, list_transform(range(0, 6), lambda i: (p_size >> i) & 1) AS a, list_transform(range(0, 4), lambda i: ((p_partkey >> i) & 1)::INT) AS b FROM part) SELECT p_partkey, (a[1] & b[1]) + (a[2] & b[2]) + (a[3] & b[3]) + (a[4] & b[4]) > 0 AS overlap, array_to_string(a[1:4], '') || '1111' AS ranged, b[1] || '00' || b[4] AS off, '0000' AS cleared FROM b",
    "word_ids": r"WITH v AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)), q AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark)) SELECT item_id, pos, word, coalesce(id, 0) AS id FROM q LEFT JOIN v USING (word)",
}
