"""List, set and bit-vector functions over arrays, with the duplicate rules of list processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, in a's order, duplicates kept (``array_except`` drops them)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def intersection(a: Column, b: Column) -> Column:
    """Elements of a that b has, in a's order, duplicates kept."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def union(a: Column, b: Column) -> Column:
    """Elements that only b has, in b's order, then all of a."""
    return F.concat(F.filter(b, lambda x: ~F.array_contains(a, x)), a)


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def equivalent(a: Column, b: Column) -> Column:
    """Equal lengths and each side's elements all in the other; [a, a, b] and [a, b, b] are."""
    return (F.size(a) == F.size(b)) & subset_of(a, b) & subset_of(b, a)


def contains_run(a: Column, b: Column) -> Column:
    """Whether b stands in a as a contiguous run; an empty b always does."""
    last = F.size(a) - F.size(b) + 1
    return F.when(F.size(b) == 0, True).when(last < 1, False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(a, i, F.size(b)) == b))


def position(a: Column, x: Column) -> Column:
    """0-based place of the first x, -1 if there is none."""
    return (F.array_position(a, x) - 1).cast("int")


def last_position(a: Column, x: Column) -> Column:
    at = F.array_position(F.reverse(a), x)
    return F.when(at == 0, -1).otherwise(F.size(a) - at).cast("int")


def subsequence(a: Column, start: Column, stop: Column) -> Column:
    """Elements start..stop, both counted from 0 and included."""
    return F.when(stop >= start, F.slice(a, start + 1, stop - start + 1)).otherwise(F.slice(a, 1, 0))


def insert_at(a: Column, at: Column, items: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), at), items, F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0))))


def elide(a: Column, start: Column, stop: Column) -> Column:
    """a without elements start..stop."""
    return F.concat(F.slice(a, F.lit(1), start), F.slice(a, stop + 2, F.greatest(F.size(a) - stop - 1, F.lit(0))))


def set_nth(a: Column, at: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def push(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def push_new(a: Column, x: Column) -> Column:
    return F.when(F.array_contains(a, x), a).otherwise(F.array_prepend(a, x))


def pop(a: Column) -> Column:
    """The rest after the first element."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def association(pairs: Column, key: Column) -> Column:
    """The first struct of ``pairs`` (key, value) with that key."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))


def flatten_deep(a: Column, depth: int) -> Column:
    """Nested arrays of a known depth as one array."""
    for _ in range(depth - 1):
        a = F.flatten(a)
    return a


def joined(a: Column) -> Column:
    return F.array_join(a, " ")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed between two states of an index, with multiplicity."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def bit_and(a: Column, b: Column) -> Column:
    """Of arrays of 0 and 1: as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    """As long as the longer one."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0))))


def bit_minus(a: Column, b: Column) -> Column:
    """As long as the left one."""
    return F.slice(F.zip_with(a, b, lambda x, y: F.when(F.coalesce(y, F.lit(0)) == 0, F.coalesce(x, F.lit(0))).otherwise(0)), F.lit(1), F.size(a))


def bit_not(a: Column) -> Column:
    return F.transform(a, lambda x: 1 - x)


def bits_set(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


# Queries over the tables: the parts of each supplier by return flag as lists and as bit vectors.

def supplier_lists(spark, sf_dir: str) -> DataFrame:
    """(s, a, b): part keys of a supplier's returned (a) and accepted (b) lines, sorted, duplicates kept."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag")
    return lines.groupBy(F.col("l_suppkey").alias("s")).agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))).alias("b"))


_LISTS = "WITH l AS (SELECT l_suppkey AS s, coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'R')), []) AS a, coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'A')), []) AS b FROM lineitem GROUP BY l_suppkey)"


def _list_query(columns):
    """columns: a function that gives the columns, which need a session to be made."""
    return lambda spark, sf_dir: supplier_lists(spark, sf_dir).select("s", *[c.alias(k) for k, c in columns().items()])


def _bits(spark, sf_dir):
    """(s, a, b): bit k is set if the supplier has a returned (a) or accepted (b) line of quantity k + 1; lengths follow the largest."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    sets = lines.groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("q"))).alias("r"), F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("q"))).alias("k"))

    def vector(c):
        return F.when(F.size(c) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.coalesce(F.array_max(c), F.lit(1))), lambda i: F.array_contains(c, i).cast("int")))

    return sets.select("s", vector("r").alias("a"), vector("k").alias("b"))


def q_bits(op):
    def run(spark, sf_dir):
        out = op(F.col("a"), F.col("b"))
        return _bits(spark, sf_dir).select("s", F.size(out).alias("length"), bits_set(out).alias("n"))

    return run


_BITS = "WITH v AS (SELECT l_suppkey AS s, coalesce(list_distinct(list(l_quantity::INT) FILTER (WHERE l_returnflag = 'R')), []) AS r, coalesce(list_distinct(list(l_quantity::INT) FILTER (WHERE l_returnflag = 'A')), []) AS k FROM lineitem GROUP BY l_suppkey), m AS (SELECT *, coalesce(list_max(r), 0) AS lr, coalesce(list_max(k), 0) AS lk FROM v)"

QUERIES = {
    "set_difference": _list_query(lambda: dict(d=difference(F.col("a"), F.col("b")))),
    "set_intersection": _list_query(lambda: dict(d=intersection(F.col("a"), F.col("b")))),
    "set_union": _list_query(lambda: dict(d=union(F.col("a"), F.col("b")))),
    "set_distinct": _list_query(lambda: dict(d=F.array_distinct("a"))),
    "set_subset_equiv": _list_query(lambda: dict(sub=subset_of(F.col("a"), F.col("b")), eq=equivalent(F.col("a"), F.reverse("a")), over=F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)), run=contains_run(F.col("a"), F.slice("a", 2, 3)))),
    "set_equivalence": _list_query(lambda: dict(eq=equivalent(F.transform("a", lambda x: x % 3), F.transform("b", lambda x: x % 3)), run=contains_run(F.transform("a", lambda x: x % 3), F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>")))),
    "list_position": _list_query(lambda: dict(p=F.when(F.size("b") > 0, position(F.col("a"), F.get("b", F.lit(0)))).otherwise(-1), sub=subsequence(F.col("a"), F.lit(1), F.lit(3)), without=elide(F.col("a"), F.lit(0), F.lit(1)), rest=pop(F.col("a")), rev=F.reverse("a"))),
    "bit_and_count": q_bits(bit_and),
    "bit_or_count": q_bits(bit_or),
    "bit_minus_count": q_bits(bit_minus),
    "bit_not_count": q_bits(lambda a, b: bit_not(a)),
}
SQL = {
    "set_difference": f"{_LISTS} SELECT s, list_filter(a, lambda x: NOT list_contains(b, x)) AS d FROM l",
    "set_intersection": f"{_LISTS} SELECT s, list_filter(a, lambda x: list_contains(b, x)) AS d FROM l",
    "set_union": f"{_LISTS} SELECT s, list_concat(list_filter(b, lambda x: NOT list_contains(a, x)), a) AS d FROM l",
    "set_distinct": f"{_LISTS} SELECT s, list_sort(list_distinct(a)) AS d FROM l",
    "set_subset_equiv": f"{_LISTS} SELECT s, list_has_all(b, a) AS sub, true AS eq, list_has_any(a, b) AS over, true AS run FROM l",
    "set_equivalence": f"{_LISTS}, m AS (SELECT s, list_transform(a, lambda x: x % 3) AS a, list_transform(b, lambda x: x % 3) AS b FROM l) SELECT s, len(a) = len(b) AND list_has_all(a, b) AND list_has_all(b, a) AS eq, len(list_filter(range(1, len(a) - 1), lambda i: a[i] = 0 AND a[i + 1] = 1 AND a[i + 2] = 2)) > 0 AS run FROM m",
    "list_position": f"{_LISTS} SELECT s, CASE WHEN len(b) > 0 THEN (coalesce(list_position(a, b[1]), 0) - 1)::INT ELSE -1 END AS p, a[2:4] AS sub, a[3:] AS without, a[2:] AS rest, list_reverse(a) AS rev FROM l",
    "bit_and_count": f"{_BITS} SELECT s, least(lr, lk)::INT AS length, len(list_filter(r, lambda x: list_contains(k, x)))::INT AS n FROM m",
    "bit_or_count": f"{_BITS} SELECT s, greatest(lr, lk)::INT AS length, len(list_distinct(list_concat(r, k)))::INT AS n FROM m",
    "bit_minus_count": f"{_BITS} SELECT s, lr::INT AS length, len(list_filter(r, lambda x: NOT list_contains(k, x)))::INT AS n FROM m",
    "bit_not_count": f"{_BITS} SELECT s, lr::INT AS length, (lr - len(r))::INT AS n FROM m",
}
