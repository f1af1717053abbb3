"""Clustering of dense vectors: grow-seeds, k-means, agglomerative, incremental, and what clusters are judged by.

Seeds and centroids are few: they are counted, must fit ``MOST_CENTROIDS``, and enter the plan as one literal array, so giving each vector to
its nearest one is a projection without join or shuffle. New centroids are sums that are pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES, _NAMES, _dense_statistic, dense_similarity
from ..plans.config import ClusterParameters

#: Seeds or centroids in one literal, and vectors that are clustered agglomeratively, at most.
MOST_CENTROIDS, MOST_AGGLOMERATIVE = 2000, 3000


def _checked(rows: list, most: int, what: str) -> list:
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def nearest_of(vectors: DataFrame, centres: list[tuple[str, list[float]]], measure: str = "cosine", vector: str = "v") -> DataFrame:
    """``vectors`` with ``cluster`` and ``similarity`` of the nearest centre; ties go to the smallest name."""
    centres = sorted(_checked(centres, MOST_CENTROIDS, "centres"))
    kind = "array<struct<key:string,v:array<double>>>"
    literal = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for k, v in centres]).cast(kind)
    m = MEASURES[measure]
    y = "seed.v"
    x = "__v"
    out = vectors.withColumns({"__v": F.col(vector).cast("array<double>"), "__seeds": literal})
    if m.normalised and measure != "cosine":
        unit = "transform({0}, t -> t / coalesce(nullif(sqrt(aggregate({0}, 0D, (s, t) -> s + t * t)), 0D), 1D))"
        out = out.withColumns({"__v": F.expr(unit.format("__v")), "__seeds": F.expr(f"transform(__seeds, seed -> named_struct('key', seed.key, 'v', {unit.format('seed.v')}))")})
    sql = _NAMES.sub(lambda k: f"({_dense_statistic(k[1], x, y)})", m.dense)
    scored = F.expr(f"transform(__seeds, (seed, i) -> named_struct('s', cast({sql} AS double), 'i', -i, 'key', seed.key))")
    best = F.array_max(scored)
    return out.withColumn("__best", best).withColumns({"cluster": F.col("__best.key"), "similarity": F.col("__best.s")}).drop("__v", "__seeds", "__best")


def grow_seeds(vectors: DataFrame, seeds: DataFrame, threshold: float, measure: str = "cosine") -> DataFrame:
    """Each vector with the label of its nearest seed, null below the threshold. seeds: (key, v), few."""
    centres = [(r[0], r[1]) for r in seeds.select(F.col("key").cast("string"), F.col("v").cast("array<double>")).limit(MOST_CENTROIDS + 1).collect()]
    near = nearest_of(vectors, centres, measure)
    return near.withColumn("cluster", F.when(F.col("similarity") >= threshold, F.col("cluster")))


def centroids(assigned: DataFrame, mean: bool = False, vector: str = "v") -> DataFrame:
    """(cluster, v): sums (or means) of the members' vectors."""
    parts = assigned.select("cluster", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "w")).groupBy("cluster", "i").agg((F.avg if mean else F.sum)("w").alias("w"))
    return parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("p")).select("cluster", F.transform("p", lambda s: s["w"]).alias("v"))


def k_means(vectors: DataFrame, seeds: list[tuple[str, list[float]]], rounds: int = 10, measure: str = "cosine", id_col: str = "id") -> DataFrame:
    """Lloyd's rounds from given seeds: assign to the nearest centroid, take sums as new centroids, until nothing changes or ``rounds`` are done.

    Only the centroids, a bounded number, come to the driver.
    """
    rounds, centres = max(2, rounds), seeds
    for _ in range(rounds - 1):
        assigned = nearest_of(vectors, centres, measure)
        new = [(r["cluster"], r["v"]) for r in centroids(assigned, mean=measure != "cosine").collect()]
        kept = {k for k, _ in new}
        new += [(k, v) for k, v in centres if k not in kept]
        if sorted(new) == sorted(centres):
            break
        centres = new
    return nearest_of(vectors, centres, measure)


def diversity_sample(vectors: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """n vectors by hash, ordered by how little they resemble the others: the sum of squared cosines, ascending.

    That sum is a quadratic form of the vector in the sum of all outer products of unit vectors, so no two vectors meet: each task adds up its outer products, and
    one matrix, a number for each pair of dimensions, goes back to all.
    """
    import pyarrow as pa

    from ..functions.scalars import sample_rows
    from ..plans.session import ensure_checkpoints

    ensure_checkpoints(vectors.sparkSession)
    rows = sample_rows(vectors.select(F.col(id_col).alias("id"), F.col("v").cast("array<double>").alias("v")), "id", n, seed).select(F.col("id").cast("string").alias("id"), "v").checkpoint()

    def units(batch):
        import numpy as np

        x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
        return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)

    def outer(batches):
        total = None
        for batch in filter(lambda b: b.num_rows, batches):
            u = units(batch)
            total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "w"])

    parts = rows.mapInArrow(outer, "i int, w array<double>").select("i", F.posexplode("w").alias("j", "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    matrix = [r[0] for r in parts.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda s: s["w"]).alias("row")).orderBy("i").select("row").collect()]

    def crowd(batches):
        import numpy as np

        m = np.array(matrix)
        for batch in filter(lambda b: b.num_rows, batches):
            u = units(batch)
            own = (u**2).sum(1) ** 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(((u @ m) * u).sum(1) - own)], names=["id", "v", "crowding"])

    return rows.mapInArrow(crowd, "id string, v array<double>, crowding double").orderBy("crowding", "id")


def agglomerative(vectors: DataFrame, clusters: int, threshold: float, backoff: float = 0.1, id_col: str = "id") -> DataFrame:
    """(id, cluster): singletons whose nearest pair of clusters (cosine of sums) is merged while it reaches the threshold, which
    backs off in steps until so few clusters are left. For at most ``MOST_AGGLOMERATIVE`` vectors, centroids of a k-means say.
    """
    import numpy as np

    rows = sorted((r[0], r[1]) for r in vectors.select(F.col(id_col), F.col("v").cast("array<double>")).limit(MOST_AGGLOMERATIVE + 1).collect())
    _checked(rows, MOST_AGGLOMERATIVE, "vectors")
    form = f"id {vectors.schema[id_col].dataType.simpleString()}, cluster string"
    if not rows:
        return vectors.sparkSession.createDataFrame([], form)
    sums = np.array([v for _, v in rows])
    own, alive = [[k] for k in range(len(rows))], np.ones(len(rows), bool)

    def cosine(a, b):
        return (b @ a) / np.maximum(np.linalg.norm(a) * np.linalg.norm(b, axis=-1), 1e-300)

    s = np.array([cosine(v, sums) for v in sums])
    np.fill_diagonal(s, -np.inf)
    while alive.sum() > clusters:
        a, b = np.unravel_index(s.argmax(), s.shape)
        if s[a, b] < threshold:
            # Further back than the best pair at once, in whole steps.
            if threshold <= -1:
                break
            threshold = threshold - backoff * max(abs(threshold), 0.1)
            continue
        a, b = min(a, b), max(a, b)
        sums[a] += sums[b]
        own[a] += own[b]
        alive[b] = False
        s[b, :] = s[:, b] = -np.inf
        row = np.where(alive, cosine(sums[a], sums), -np.inf)
        row[a] = -np.inf
        s[a, :], s[:, a] = row, row
    out = [(rows[m][0], f"<CL_{k}>") for k, members in enumerate(own) if alive[k] for m in members]
    return vectors.sparkSession.createDataFrame(out, form)


def incremental(vectors: DataFrame, threshold: float, clusters: int, hard_limit: bool = True, state: list[tuple[str, list[float]]] = (), id_col: str = "id") -> DataFrame:
    """(id, cluster): one pass in order of the ids; a vector joins the best cluster at or above the threshold (cosine of sums), else opens one; at the hard limit it joins the nearest.

    Each decision depends on all before it, so this runs in one task by definition; it streams and holds the clusters' sums only.
    """
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    start = list(state)

    def run(batches):
        import numpy as np

        names, sums = [k for k, _ in start], [np.array(v, float) for _, v in start]
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.array(v, float)
                best, at = -np.inf, -1
                if sums:
                    m = np.array(sums)
                    s = (m @ v) / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(v), 1e-300)
                    at = int(s.argmax())
                    best = s[at]
                if best >= threshold or hard_limit and len(sums) >= clusters:
                    sums[at] = sums[at] + v
                else:
                    at = len(sums)
                    names.append(f"<CL_{at}>")
                    sums.append(v)
                out.append(names[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "cluster"])

    form = StructType([StructField("id", vectors.schema[id_col].dataType), StructField("cluster", StringType())])
    ordered = vectors.select(F.col(id_col).alias("id"), F.col("v").cast("array<double>")).repartition(1).sortWithinPartitions("id")
    return ordered.mapInArrow(run, form)


def multipass(vectors: DataFrame, threshold: float, clusters: int, id_col: str = "id") -> DataFrame:
    """A pass at nine tenths of the threshold gives the clusters, a second one starts from their sums."""
    first = incremental(vectors, 0.9 * threshold, clusters, id_col=id_col)
    sums = centroids(vectors.withColumnRenamed(id_col, "id").join(first, "id"))
    state = [(r[0], r[1]) for r in sums.orderBy("cluster").limit(MOST_CENTROIDS + 1).collect()]
    return incremental(vectors, threshold, clusters, state=_checked(state, MOST_CENTROIDS, "clusters"), id_col=id_col)


def hierarchical_seeds(vectors: DataFrame, clusters: int, seed: int = 0, id_col: str = "id") -> list[tuple[str, list[float]]]:
    """Seeds for k-means: a sample is agglomerated to three times as many clusters, the largest ones' sums are taken."""
    sample = diversity_sample(vectors, 10 * clusters, seed, id_col)
    grouped = agglomerative(sample, 3 * clusters, 1.0)
    sizes = {r[0]: r[1] for r in grouped.groupBy("cluster").count().collect()}
    sums = {r[0]: r[1] for r in centroids(sample.join(grouped, "id")).collect()}
    return [(k, sums[k]) for k in sorted(sums, key=lambda k: (-sizes[k], k))[:clusters]]


def representative_similarity(pairs: DataFrame, rep: str, group: list[str], similarity: str = "similarity") -> DataFrame:
    """(group..., similarity) of a vector to a cluster from its similarities to the members: nearest (0 at least), furthest (1 at most), average or rms."""
    s = F.col(similarity)
    how: Column = {"nearest": F.greatest(F.max(s), F.lit(0.0)), "furthest": F.least(F.min(s), F.lit(1.0)), "average": F.avg(s), "rms": F.sqrt(F.avg(s * s))}[rep]
    return pairs.groupBy(*group).agg(how.alias("similarity"))


def cluster(vectors: DataFrame, parameters: ClusterParameters | str, seeds: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(id, cluster) by the method that the parameters name.

    seeds: (key, v), asked for by grow-seeds; k-means takes them too, else as many vectors as it makes clusters, the least alike of a sample. With another representative
    than the centroid these two methods go by all members (``member_clusters``); the others know centroids only and raise.
    """
    p = ClusterParameters.parse(parameters) if isinstance(parameters, str) else parameters
    if p.rep != "centroid":
        from .member_clusters import cluster_by_members

        if seeds is None:
            raise ValueError(f"representative {p.rep} needs seeds: the first members")
        return cluster_by_members(vectors, p, seeds)
    if p.method in ("gac", "multipass_gac", "agglomerative", "kmeans_hclust") and p.measure != "cosine":
        raise NotImplementedError(f"{p.method} with measure {p.measure}")
    known = None if seeds is None else [(r[0], r[1]) for r in seeds.select(F.col("key").cast("string"), F.col("v").cast("array<double>")).limit(MOST_CENTROIDS + 1).collect()]
    if p.method == "growseed":
        if known is None:
            raise ValueError("grow-seeds needs seeds")
        near = nearest_of(vectors, known, p.measure)
        return near.select("id", F.when(F.col("similarity") >= p.threshold, F.col("cluster")).alias("cluster"))
    if p.method == "gac":
        return incremental(vectors, p.threshold, p.clusters, p.hard_limit)
    if p.method == "multipass_gac":
        return multipass(vectors, p.threshold, p.clusters)
    if p.method == "agglomerative":
        return agglomerative(vectors, p.clusters, p.threshold)
    if p.method == "kmeans_hclust":
        known = hierarchical_seeds(vectors, p.clusters, seed)
    elif known is None:
        known = [(f"<CL_{k}>", r[0]) for k, r in enumerate(diversity_sample(vectors, 4 * p.clusters, seed).select("v").limit(p.clusters).collect())]
    return k_means(vectors, known, p.iterations, p.measure).select("id", "cluster")


def merge_equivalent(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters that share a seed name become one. names: (cluster, seed)."""
    return assigned.join(names, "cluster", "left").withColumn("cluster", F.coalesce("seed", "cluster")).drop("seed")


def drop_singletons(assigned: DataFrame) -> DataFrame:
    """Without generated clusters of one member."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    return assigned.join(sizes, "cluster").where((F.col("_n") > 1) | ~F.col("cluster").rlike(r"^<CL_\d+>$")).drop("_n")


def trim(assigned: DataFrame, order: list[Column], k: int) -> DataFrame:
    from ..functions.scalars import top_k

    return top_k(assigned, ["cluster"], order, k).drop("rank")


def threshold_at(freq1: Column, freq2: Column, steps: list[tuple[int, float]], scale: float = 1.0) -> Column:
    """The threshold for the smaller frequency from rising (count, threshold) steps."""
    low, out = F.least(freq1, freq2), F.lit(steps[0][1])
    for count, value in sorted(steps):
        out = F.when(low >= count, value).otherwise(out)
    return out * scale


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def _seeds(v):
    """The vector of smallest id for each label."""
    return v.groupBy("label").agg(F.min_by("v", "id").alias("v")).select(F.col("label").cast("string").alias("key"), "v")


def q_growseed(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return grow_seeds(v, _seeds(v), 0.1).select("id", "cluster", F.round("similarity", 6).alias("similarity"))


def q_kmeans(rounds):
    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        seeds = [(r[0], r[1]) for r in _seeds(v).collect()]
        out = k_means(v, seeds, rounds) if rounds > 1 else nearest_of(v, seeds)
        return out.select("id", "cluster")

    return run


def q_knn(k):
    """The neighbours of every vector whose id is divisible by 100."""

    def run(spark, sf_dir):
        from .member_clusters import knn

        v = _vectors(spark, sf_dir)
        return knn(v, v.where("id % 100 = 0"), k).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))

    return run


def q_entry(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return cluster(v, "method=grow,threshold=0.1", _seeds(v))


def q_agglomerative(spark, sf_dir):
    """The centroids of the labels, merged to four clusters."""
    c = centroids(_vectors(spark, sf_dir).withColumn("cluster", F.col("label").cast("string")))
    return agglomerative(c.withColumnRenamed("cluster", "id"), 4, 0.9)


def q_representatives(spark, sf_dir):
    """How near the members of each label are to its sum: nearest, furthest, average and rms."""
    v = _vectors(spark, sf_dir).withColumn("cluster", F.col("label"))
    met = v.join(centroids(v).withColumnRenamed("v", "y"), "cluster")
    s = dense_similarity(met, "cosine", "v", "y")
    c = F.col("similarity")
    return s.groupBy("label").agg(*[F.round(x, 6).alias(k) for k, x in (("nearest", F.max(c)), ("furthest", F.min(c)), ("average", F.avg(c)), ("rms", F.sqrt(F.avg(c * c))))])


_S = "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label::VARCHAR AS key, arg_min(v, id) AS v FROM v GROUP BY label)"
_NEAREST = "a{n} AS (SELECT v.id, v.v, c.key, list_cosine_similarity(v.v, c.v) AS sim FROM v, {c} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY sim DESC, c.key) = 1)"
_SUMS = "m{n} AS (SELECT key, list(w ORDER BY i) AS v FROM (SELECT key, i, sum(w) AS w FROM (SELECT key, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY key, i) GROUP BY key), c{n} AS (SELECT * FROM m{n} UNION ALL SELECT * FROM {c} WHERE key NOT IN (SELECT key FROM m{n}))"
_KNN = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT q.id AS query, v.id, list_cosine_similarity(q.v, v.v) AS s FROM q JOIN v ON q.id <> v.id) SELECT query, row_number() OVER w AS rank, id, round(s, 6) AS similarity FROM s WINDOW w AS (PARTITION BY query ORDER BY s DESC, id) QUALIFY rank <= {k}"
QUERIES = {
    "growseed": q_growseed,
    "cluster_entry": q_entry,
    "knn_topk": q_knn(10),
    "nearest_neighbor": q_knn(1),
    "kmeans_assign_step": q_kmeans(1),
    "kmeans_3_rounds": q_kmeans(3),
    "agglomerative": q_agglomerative,
    "gac": lambda spark, sf_dir: incremental(_vectors(spark, sf_dir), 0.3, 50),
    "gac_multipass": lambda spark, sf_dir: multipass(_vectors(spark, sf_dir), 0.3, 50),
    "kmeans_hclust": lambda spark, sf_dir: k_means(_vectors(spark, sf_dir), hierarchical_seeds(_vectors(spark, sf_dir), 8), 3).select("id", "cluster"),
    "diversity_sample": lambda spark, sf_dir: diversity_sample(_vectors(spark, sf_dir), 60, 3).select("id", F.round("crowding", 6).alias("crowding")),
    "cluster_representatives": q_representatives,
}
SQL = {
    "growseed": f"{_S}, {_NEAREST.format(n=0, c='s')} SELECT id, CASE WHEN sim >= 0.1 THEN key END AS cluster, round(sim, 6) AS similarity FROM a0",
    "cluster_entry": f"{_S}, {_NEAREST.format(n=0, c='s')} SELECT id, CASE WHEN sim >= 0.1 THEN key END AS cluster FROM a0",
    "knn_topk": _KNN.format(k=10),
    "nearest_neighbor": _KNN.format(k=1),
    "kmeans_assign_step": f"{_S}, {_NEAREST.format(n=0, c='s')} SELECT id, key AS cluster FROM a0",
    "kmeans_3_rounds": f"{_S}, {_NEAREST.format(n=0, c='s')}, {_SUMS.format(n=0, c='s')}, {_NEAREST.format(n=1, c='c0')}, {_SUMS.format(n=1, c='c0')}, {_NEAREST.format(n=2, c='c1')} SELECT id, key AS cluster FROM a2",
    "diversity_sample": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5('3:' || vec_id), vec_id LIMIT 60) SELECT a.id::VARCHAR AS id, round(sum(list_cosine_similarity(a.v, b.v) ** 2), 6) AS crowding FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id",
    "cluster_representatives": "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(w ORDER BY i) AS y FROM (SELECT label, i, sum(w) AS w FROM (SELECT label, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM v) GROUP BY label, i) GROUP BY label), s AS (SELECT label, list_cosine_similarity(v, y) AS s FROM v JOIN c USING (label)) SELECT label, round(max(s), 6) AS nearest, round(min(s), 6) AS furthest, round(avg(s), 6) AS average, round(sqrt(avg(s * s)), 6) AS rms FROM s GROUP BY label",
}
