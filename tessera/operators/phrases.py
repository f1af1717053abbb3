"""Match sets: occurrences of phrases whose every word may be any of several, with the lengths to which they extend.

A pattern is a table of candidates (step, word). Words that are candidates of no step are left out before anything is shuffled; a word at position p that fits step s
speaks for a match that begins at p - s, so one aggregation by (record, beginning) finds all matches of all lengths, however many candidates a step has: there
is no join for each step and none for each candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import bounded
from .ngrams import _W, positions


def match_lengths(tok: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec, start, length): for each position of tok(rec, pos, word) where a match begins, how many steps of candidates(step, word) it can be extended by.

    Steps count from 0; a step without candidates ends every match. ``length`` is that of the longest match; all shorter ones begin there too. Null words match nothing.
    """
    steps = candidates.where(F.col("word").isNotNull()).groupBy("word").agg(F.collect_set("step").alias("steps"))
    fits = tok.join(bounded(steps), "word").select("rec", "pos", F.explode("steps").alias("step"))
    met = fits.groupBy("rec", (F.col("pos") - F.col("step")).cast("int").alias("start")).agg(F.collect_set("step").alias("steps"))
    ordered = F.array_sort("steps")
    # Steps 0, 1, 2 ... up to the first that is missing; there are no more than the pattern has.
    run = F.size(F.filter(ordered, lambda s, i: s == i))
    return met.select("rec", "start", run.alias("length")).where("length > 0")


def extend_matches(matches: DataFrame, tok: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extended, unextendable) of matches (rec, start, end): those followed at once by any of words(word), one word longer, and the others as they are."""
    following = tok.join(bounded(words.select("word").distinct()), "word", "left_semi").select("rec", F.col("pos").alias("_next")).distinct()
    on = [matches["rec"] == following["rec"], matches["end"] + 1 == following["_next"]]
    extended = matches.join(following, on, "left_semi").withColumn("end", F.col("end") + 1)
    return extended, matches.join(following, on, "left_anti")


def _candidates(spark, sf_dir, steps: int) -> DataFrame:
    """Step k may be any word that stands k-th in an item of the benchmark."""
    return positions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id").where(F.col("pos") < steps).select(F.col("pos").alias("step"), "word").distinct()


def q_classes(spark, sf_dir):
    """How far the documents can be read as the benchmark's items begin, word by word from any item."""
    return match_lengths(positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"), _candidates(spark, sf_dir, 6)).where("length > 1")


def q_extended(spark, sf_dir):
    """Occurrences of first words of items, by whether a second word of any item follows."""
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    step = lambda k: _candidates(spark, sf_dir, 2).where(F.col("step") == k).select("word")
    begun = tok.join(bounded(step(0)), "word", "left_semi").select("rec", F.col("pos").alias("start"), F.col("pos").alias("end"))
    extended, rest = extend_matches(begun, tok, step(1))
    count = lambda df, kind: df.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).select("rec", F.lit(kind).alias("kind"), "n")
    return count(extended, "extended").unionByName(count(rest, "unextendable"))


_C = f"WITH {_W}, c AS (SELECT DISTINCT k - 1 AS step, w[k] AS word FROM (SELECT w, unnest(range(1, least(len(w), 6) + 1)) AS k FROM q)), t AS (SELECT doc_id AS rec, i - 1 AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d))"
QUERIES = {"phrase_classes": q_classes, "phrase_extension": q_extended}
SQL = {
    "phrase_classes": f"{_C}, m AS (SELECT rec, pos - step AS start, list_sort(list(DISTINCT step)) AS s FROM t JOIN c USING (word) GROUP BY ALL) SELECT rec, start::INT AS start, len([x for x, i in s if x = i - 1])::INT AS length FROM m WHERE len([x for x, i in s if x = i - 1]) > 1",
    "phrase_extension": f"{_C}, b AS (SELECT rec, pos, EXISTS (SELECT 1 FROM t u JOIN c ON c.step = 1 AND c.word = u.word WHERE u.rec = t.rec AND u.pos = t.pos + 1) AS x FROM t WHERE word IN (SELECT word FROM c WHERE step = 0)) SELECT rec, CASE WHEN x THEN 'extended' ELSE 'unextendable' END AS kind, count(*) AS n FROM b GROUP BY ALL",
}
