"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node it can reach.

    Each node points to its smallest neighbour so far, and the smaller neighbours besides it are linked to that one instead. Then every
    pointer is replaced by the pointer of the node that it leads to, so paths halve. Rounds go on until each node has one
    pointer, to a node without any. Only a node's smaller neighbours meet in a task, and one by one. Links that come as stars around
    their smallest node, as the operators make them, give a node few of these, and a centre none; the replacement is a plain join
    with a table of one row for each node, whose hubs can be split.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    along, before = Window.partitionBy("u").orderBy("v"), None
    while True:
        several, moved = Observation(), Observation()
        ranked = edges.select("u", "v", F.first("v").over(along).alias("m"), F.row_number().over(along).alias("k"))
        home = F.col("k") == 1
        stars = ranked.where(home | (F.col("v") != F.col("m"))).select(F.when(home, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), home.alias("home"))
        stars = tables.keep(stars.observe(several, F.count(F.when(~F.col("home"), 1)).alias("n")))
        pointers = stars.where("home").select(F.col("u").alias("v"), F.col("v").alias("to"))
        after = stars.join(pointers, "v", "left").select("u", F.coalesce("to", "v").alias("v"), F.col("to").isNotNull().alias("moved")).where("u != v")
        # Many nodes may link the same two others; each link goes on once.
        after = after.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        after = tables.keep(after.observe(moved, F.count(F.when(F.col("moved"), 1)).alias("n")))
        tables.drop(stars, *([before] if before is not None else []))
        edges, before = after.select("u", "v"), after
        if not several.get["n"] and not moved.get["n"]:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
