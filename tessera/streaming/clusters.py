"""Clusters that open and grow in a stream: keyed state, carried from batch to batch.

Vectors are dealt by a key, and each key has clusters of its own. A key's vectors are taken in order of their ids, batch after batch: one that is like
enough to a cluster (cosine of the sum of its members) joins it, else it opens a new one, and at the limit it joins the nearest. The state of a key is its clusters' sums
and sizes, bounded by the limit; it lives in the state store, so a lost executor or a restart goes on from the last batch that was committed. As long as ids rise from batch to batch,
any cutting into batches gives the clusters that one batch would.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .incremental import _folder, file_stream

OUT = "key string, id long, cluster string, similarity double"
STATE = "sums array<array<double>>, sizes array<long>"


class Growing:
    """The clusters of one key: ``add`` takes a vector in and gives (cluster number, similarity)."""

    def __init__(self, threshold: float, most: int, sums=(), sizes=()) -> None:
        import numpy as np

        self.threshold, self.most = threshold, most
        self.sums, self.sizes = [np.array(s, float) for s in sums], list(sizes)

    def add(self, v) -> tuple[int, float]:
        import numpy as np

        v = np.asarray(v, float)
        best, at = -1.0, -1
        if self.sums:
            m = np.array(self.sums)
            s = (m @ v) / np.maximum(np.sqrt((m**2).sum(1)) * np.sqrt(v @ v), 1e-300)
            at = int(s.argmax())
            best = float(s[at])
        if at < 0 or (best < self.threshold and len(self.sums) < self.most):
            self.sums.append(v)
            self.sizes.append(1)
            return len(self.sums) - 1, 1.0
        self.sums[at] = self.sums[at] + v
        self.sizes[at] += 1
        return at, best


def _grow(threshold: float, most: int):
    def run(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        held = Growing(threshold, most, *(state.get if state.exists else ((), ())))
        # What a trigger brings of a key is sorted as a whole; a trigger's size is bounded by the source's settings.
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        found = [held.add(v) for v in rows["v"]]
        state.update(([s.tolist() for s in held.sums], [int(n) for n in held.sizes]))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "cluster": [f"<CL_{k}>" for k, _ in found], "similarity": [s for _, s in found]})

    return run


def cluster_stream(vectors: DataFrame, threshold: float, most: int) -> DataFrame:
    """(key, id, cluster, similarity) of each vector of a stream (key, id, v) as it comes; ``most`` clusters in each key.

    Rows without a key, id or vector are left out. A batch DataFrame is one batch.
    """
    rows = vectors.where(F.col("key").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(_grow(threshold, most), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def q_cluster_state(spark, sf_dir):
    """The embeddings in five files by rising id, streamed one file after the other; each label's vectors grow their own clusters."""
    where = _folder(spark, "clusters")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    cuts = table.approxQuantile("id", [0.2, 0.4, 0.6, 0.8], 0.01)
    part = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        table.where(part == k).coalesce(1).write.mode("append").parquet(f"{where}/in")
    out = cluster_stream(file_stream(spark, f"{where}/in", table.schema, 1), 0.2, 20).writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/table").format("parquet").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{where}/table").select("key", "id", "cluster", F.round("similarity", 6).alias("similarity"))


#: Vector after vector of each label in order of the ids: the sums of its clusters as lists of lists.
_SQL = """
WITH RECURSIVE v AS (SELECT label::VARCHAR AS key, vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
g AS (SELECT key, id, k, [v] AS sums, 1::BIGINT AS own, 1.0::DOUBLE AS similarity FROM v WHERE k = 1
  UNION ALL SELECT key, id, k, CASE WHEN opens THEN list_append(sums, v) ELSE [CASE WHEN i = best THEN [a[1] + a[2] for a in list_zip(sums[i], v)] ELSE sums[i] END for i in range(1, len(sums) + 1)] END, CASE WHEN opens THEN len(sums) + 1 ELSE best END, CASE WHEN opens THEN 1.0 ELSE s[best] END
  FROM (SELECT *, s[best] < 0.2 AND len(sums) < 20 AS opens FROM (SELECT *, list_position(s, list_max(s))::BIGINT AS best FROM (SELECT v.key, v.id, v.k, v.v, g.sums, [list_cosine_similarity(c, v.v) for c in g.sums] AS s FROM g JOIN v ON v.key = g.key AND v.k = g.k + 1))))
SELECT key, id, '<CL_' || (own - 1) || '>' AS cluster, round(similarity, 6) AS similarity FROM g
"""
QUERIES = {"stream_cluster_state": q_cluster_state}
SQL = {"stream_cluster_state": _SQL}
