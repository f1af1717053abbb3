"""Incremental operators on Structured Streaming: term statistics and nearest-centroid assignment.

Sources are file streams; a run takes what is there (``availableNow``) or goes on (a processing-time trigger). State and output
live in the checkpoint folder and in tables, never on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.term_vectors import document_vectors, tokens


def file_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def streaming_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, tf): running word counts; each document adds to them once."""
    return tokens(docs, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", interval: str | None = None) -> StreamingQuery:
    """Runs a stream; ``each`` gets every batch with its number. Without an interval it ends with what is there now."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(each).start()


def update_term_stats(docs: DataFrame, table: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Each batch's (term, tf, df) is appended under its number; statistics are the sums over a table's rows, and a batch that runs again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        stats = document_vectors(batch, id_col, text_col).groupBy("term").agg(F.sum("weight").cast("long").alias("tf"), F.count(F.lit(1)).alias("df"))
        stats.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return start(docs, each, checkpoint, "append")


def read_term_stats(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def assign_stream(vectors: DataFrame, centres: list[tuple[str, list[float]]], measure: str = "cosine") -> DataFrame:
    """Vectors of a stream with their nearest centroid: stateless, so any batch can run again."""
    from ..operators.clustering import nearest_of

    return nearest_of(vectors, centres, measure)


def update_centroids(vectors: DataFrame, centres: list[tuple[str, list[float]]], table: str, checkpoint: str) -> StreamingQuery:
    """Incremental clustering: each batch's sums by cluster go to a table of their own; a centroid is the sum over all batches and its seed."""
    from ..operators.clustering import centroids, nearest_of

    def each(batch: DataFrame, number: int) -> None:
        centroids(nearest_of(batch, centres)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return start(vectors, each, checkpoint, "append")


def _folder(spark: SparkSession, name: str) -> str:
    from ..plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:8]}"


def q_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file stream, their term statistics kept up batch by batch."""
    path, where = f"{sf_dir}/documents.parquet*", _folder(spark, "terms")
    docs = file_stream(spark, path, spark.read.parquet(f"{sf_dir}/documents.parquet").schema, 4)
    query = update_term_stats(docs, f"{where}/table", f"{where}/checkpoint")
    query.awaitTermination()
    return read_term_stats(spark, f"{where}/table").select("term", "tf", "df")


def q_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a file stream, each given to the nearest of ten fixed centroids."""
    path, where = f"{sf_dir}/embeddings.parquet*", _folder(spark, "assign")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    seeds = table.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    stream = file_stream(spark, path, table.schema).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = assign_stream(stream, [(str(r[0]), [float(x) for x in r[1]]) for r in seeds])
    out = found.select("vec_id", "cluster").writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/table").format("parquet").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{where}/table")


QUERIES = {"stream_term_counts": q_term_counts, "stream_centroid_assign": q_assign}
SQL = {
    "stream_term_counts": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY term",
    "stream_centroid_assign": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label::VARCHAR AS key, arg_min(v, vec_id) AS c FROM v GROUP BY label) SELECT vec_id, key AS cluster FROM v, s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, key) = 1",
}
