"""Tokens, term vectors and TF-IDF.

A sparse vector is rows of (key, term, weight). Corpus statistics are ``term_stats(term, tf, df)`` and a document count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import spread

#: Weight of a term that the statistics don't know.
UNKNOWN_IDF = 1000.0
#: Words of documents in DuckDB, as ``tokens`` gives them.
TERMS_SQL = r"words AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents)"


def tokens(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each run of letters, lower-cased; ``keep`` names columns that go along."""
    docs = spread(docs.select(*(keep or []), text_col))
    return docs.select(*(keep or []), F.explode(F.expr(rf"regexp_extract_all(lower(`{text_col}`), '([\\p{{L}}]+)', 1)")).alias("term"))


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(id, *extra, term, weight): term frequencies."""
    keys = [id_col, *(extra or [])]
    return tokens(docs, text_col, keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def term_stats(tv: DataFrame) -> DataFrame:
    """(term, tf, df) from (key, term, weight)."""
    return tv.groupBy("term").agg(F.sum("weight").cast("long").alias("tf"), F.count(F.lit(1)).alias("df"))


def idf(n_docs, df) -> F.Column:
    """ln(N / df); ln(N + 1) for a term in no document."""
    return F.when(df > 0, F.log(n_docs / df)).otherwise(F.log(n_docs + 1.0))


def tf_idf(tf, df, n_docs) -> F.Column:
    """tf * ln(N / df) / df over the corpus; 0 for a term in more documents than there are."""
    return F.when(df > n_docs + 1, 0.0).otherwise(tf * idf(n_docs, df) / df)


def update_stats(stats: DataFrame, more: DataFrame) -> DataFrame:
    """Statistics after further documents: counts add up."""
    return stats.unionByName(more).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def weighted(tv: DataFrame, stats: DataFrame, n_docs: int, default: float = UNKNOWN_IDF) -> DataFrame:
    """Weights times idf; unknown terms get the default idf."""
    known = stats.select("term", idf(F.lit(float(n_docs)), F.col("df")).alias("_idf"))
    return tv.join(known, "term", "left").withColumn("weight", F.col("weight") * F.coalesce("_idf", F.lit(default))).drop("_idf")


def reweight(tv: DataFrame, weight) -> DataFrame:
    """Weights by an expression over term and weight."""
    return tv.withColumn("weight", weight)


def l2_normalised(tv: DataFrame, key: str = "key") -> DataFrame:
    lengths = tv.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l"))
    return tv.join(lengths, key).withColumn("weight", F.col("weight") / F.col("_l")).drop("_l")


def merged(left: DataFrame, right: DataFrame, use_max: bool = False, key: str = "key") -> DataFrame:
    """The vectors of both tables, terms summed or, with ``use_max``, at their larger weight."""
    return left.unionByName(right).groupBy(key, "term").agg((F.max if use_max else F.sum)("weight").alias("weight"))


def centroid(tv: DataFrame, cluster: str) -> DataFrame:
    """(cluster, term, weight): the sum of the members' vectors."""
    return tv.groupBy(cluster, "term").agg(F.sum("weight").alias("weight"))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_tfidf(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    # Each word with the number of its documents in one aggregation; the corpus size joins as a single row.
    stats = term_stats(document_vectors(docs))
    n = docs.agg(F.countDistinct("doc_id").cast("double").alias("n"))
    return stats.join(n, F.lit(True)).select("term", "tf", "df", F.round(tf_idf(F.col("tf"), F.col("df"), F.col("n")), 6).alias("tfidf"))


_STATS = f"WITH {TERMS_SQL}, tv AS (SELECT doc_id, term, count(*) AS w FROM words GROUP BY ALL), st AS (SELECT term, sum(w)::BIGINT AS tf, count(*) AS df FROM tv GROUP BY term), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents)"


def q_idf_default(spark, sf_dir):
    """Words of the benchmark with their idf in the documents; unknown ones get the default."""
    stats = term_stats(document_vectors(_documents(spark, sf_dir)))
    n = _documents(spark, sf_dir).agg(F.countDistinct("doc_id").cast("double").alias("n"))
    asked = tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).distinct()
    return asked.join(stats, "term", "left").join(n, F.lit(True)).select("term", F.round(F.when(F.col("df").isNull(), UNKNOWN_IDF).otherwise(idf(F.col("n"), F.col("df"))), 6).alias("idf"))


def q_doc_term_norm(spark, sf_dir):
    return l2_normalised(document_vectors(_documents(spark, sf_dir)), "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def q_centroid(spark, sf_dir):
    return centroid(document_vectors(_documents(spark, sf_dir), extra=["source"]), "source").select("source", "term", "weight")


def q_merge(use_max):
    def run(spark, sf_dir):
        tv = document_vectors(_documents(spark, sf_dir), extra=["lang"])
        halves = [centroid(tv.where(f"doc_id % 2 = {k}"), "lang").withColumnRenamed("lang", "key") for k in (0, 1)]
        return merged(*halves, use_max=use_max)

    return run


def q_vector_totals(spark, sf_dir):
    from ..functions.similarity import vector_totals

    t = vector_totals(document_vectors(_documents(spark, sf_dir)), "doc_id")
    return t.select("doc_id", "total", "top", F.round(F.sqrt("squares"), 6).alias("length"))


QUERIES = {
    "tfidf_top_terms": q_tfidf,
    "idf_default": q_idf_default,
    "doc_term_norm": q_doc_term_norm,
    "cluster_centroid": q_centroid,
    "vector_merge_sum": q_merge(False),
    "vector_merge_max": q_merge(True),
    "vector_totals": q_vector_totals,
}
_MERGE = r"WITH w AS (SELECT doc_id % 2 AS half, lang AS key, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents), c AS (SELECT half, key, term, count(*)::DOUBLE AS weight FROM w GROUP BY ALL) SELECT key, term, "
SQL = {
    "tfidf_top_terms": f"{_STATS} SELECT term, tf, df, round(CASE WHEN df > n + 1 THEN 0 ELSE tf * ln(n / df) / df END, 6) AS tfidf FROM st, n",
    "idf_default": rf"{_STATS}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM benchmark) SELECT b.term, round(CASE WHEN df IS NULL THEN {UNKNOWN_IDF} ELSE ln(n / df) END, 6) AS idf FROM b LEFT JOIN st USING (term), n",
    "doc_term_norm": f"{_STATS} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM tv",
    "cluster_centroid": f"WITH {TERMS_SQL} SELECT source, term, count(*)::DOUBLE AS weight FROM words GROUP BY ALL",
    "vector_merge_sum": _MERGE + "sum(weight) AS weight FROM c GROUP BY ALL",
    "vector_merge_max": _MERGE + "max(weight) AS weight FROM c GROUP BY ALL",
    "vector_totals": f"{_STATS} SELECT doc_id, sum(w)::DOUBLE AS total, max(w)::DOUBLE AS top, round(sqrt(sum(w * w)), 6) AS length FROM tv GROUP BY doc_id",
}
