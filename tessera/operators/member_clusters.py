"""Clusters that are represented by their members, not by a centroid, and assignment under constraints.

How like a vector is to a cluster follows from how like it is to all members: the nearest, the furthest, their average or root mean square.
Averages and root mean squares of cosines follow from sums over members, and the nearest of a vector that is a member itself from its own direction: that work grows with the
vectors. For the rest vectors and members are dealt into blocks, and each pair of blocks is one key: of a matrix product for the cosine, of an equi-join for other measures; its pairs are aggregated by vector and cluster where they are
made; so a task holds two blocks, nothing is broadcast, and a cluster may have any number of members. That work is vectors times members by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import dense_similarity
from ..plans.config import ClusterParameters
from ..plans.session import ensure_checkpoints
from .clustering import _vectors, nearest_of, representative_similarity

#: Vectors and members in a block, where pairs are rows.
BLOCK = 1000
#: Numbers in a block of a matrix product.
ENTRIES = 1 << 21
#: Clusters whose moments are in a block.
CLUSTERS = 100


def _dealt(df: DataFrame, own: str, other: str, id_col: str, own_blocks: int, other_blocks: int) -> DataFrame:
    """Each row in its block, once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(own_blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))


def _units(column):
    """(unit vectors, which are missing) of a column; vectors of another width than the widest are zero."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kept = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kept = kept if isinstance(kept, pa.Array) else pa.concat_arrays(kept.chunks) if kept.num_chunks else pa.array([], column.type)
    sizes = np.array(pc.fill_null(pc.list_value_length(kept), 0), dtype=np.int64)
    width = int(sizes.max(initial=0))
    rows = np.zeros((len(sizes), width))
    if width:
        rows[sizes == width] = np.array(kept.filter(pa.array(sizes == width)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
    return rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-300), kept.is_null().to_numpy(zero_copy_only=False)


def _cosines(left, right):
    """(id, cluster, most, least, total, squares, n): a block of vectors against one of members, by cluster."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = right["cluster"].combine_chunks().dictionary_encode()
    names = names if isinstance(names, pa.Array) else names.chunk(0)
    codes = names.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))[: len(codes)]
    (x, gone), (y, lost) = _units(left["x"]), _units(right["y"])
    if not len(x) or not len(y):
        rows = np.empty((0, 0))
        ids, clusters, out, n = left["id"].slice(0, 0), names.dictionary.slice(0, 0), [rows.ravel()] * 4, np.empty(0, np.int64)
    else:
        width = max(x.shape[1], y.shape[1])
        x, y = (v if v.shape[1] == width else np.zeros((len(v), width)) for v in (x, y[order]))
        step, found = max(1, (1 << 22) // len(y)), []
        for k in range(0, len(x), step):
            s = x[k : k + step] @ y.T
            s[gone[k : k + step]] = -1.0
            s[:, lost[order]] = -1.0
            found.append([f.reduceat(v, first, axis=1).ravel() for f, v in ((np.maximum, s), (np.minimum, s), (np.add, s), (np.add, s * s))])
        out = [np.concatenate(v) for v in zip(*found)]
        n = np.tile(np.diff(np.append(first, len(codes))), len(x)).astype(np.int64)
        ids = left["id"].take(pa.array(np.repeat(np.arange(len(x)), len(first))))
        clusters = names.dictionary.take(pa.array(np.tile(codes[order][first], len(x))))
    return pa.table([ids, clusters, *map(pa.array, out), pa.array(n)], names=["id", "cluster", "most", "least", "total", "squares", "n"])


def _moments(squares: bool):
    """Members (cluster, y) to (cluster, width, r, s, n), sums of a task: of unit vectors, or row r of the sum of their outer products; missing vectors have width -1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict = {}

        def out():
            rows = [(c, w, r, s, n if r == 0 else 0) for (c, w), (total, n) in held.items() for r, s in enumerate(total.tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f) for k, f in enumerate((kind, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64()))], names=["cluster", "width", "r", "s", "n"])

        for b in batches:
            kind = b.column(0).type
            names = b.column(0).dictionary_encode()
            codes, dictionary = names.indices.to_numpy(), names.dictionary.to_pylist()
            widths = np.array(pc.fill_null(pc.list_value_length(b.column(1)), -1), dtype=np.int64)
            for w in np.unique(widths):
                here = np.flatnonzero(widths == w)
                x, own = _units(b.column(1).take(pa.array(here)))[0], codes[here]
                for c in np.unique(own):
                    y = x[own == c]
                    total = np.zeros((1, 0)) if w < 0 else y.T @ y if squares and w else y.sum(0, keepdims=True)
                    before, n = held.get((dictionary[c], int(w)), (0, 0))
                    held[dictionary[c], int(w)] = before + total, n + len(y)
            if sum(v.nbytes for v, _ in held.values()) > 1 << 25:
                yield out()
        if held:
            yield out()

    return run


def _added(rows):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    total = np.sum(rows["s"].to_pylist(), axis=0)
    return pa.table([rows[c].slice(0, 1) for c in ("cluster", "width", "r")] + [pa.array([list(total)], pa.list_(pa.float64())), pa.array([pc.sum(rows["n"]).as_py()], pa.int64())], names=["cluster", "width", "r", "s", "n"])


def _from_moments(squares: bool):
    """A block of vectors (id, x) against clusters' moments: (id, cluster, similarity)."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        moments: dict = {}
        for c, w, r, s, n in zip(*(right[k].to_pylist() for k in ("cluster", "width", "r", "s", "n"))):
            own = moments.setdefault(c, {"n": 0, "lost": 0, "rows": {}})
            own["n"] += n
            own["lost"] += n if w < 0 else 0
            own["rows"].setdefault(w, {})[r] = s
        widths = np.array(pc.fill_null(pc.list_value_length(left["x"]), -1), dtype=np.int64)
        found = []
        for w in np.unique(widths):
            here = pa.array(np.flatnonzero(widths == w))
            part = left.take(here)
            x = _units(part["x"])[0]
            for c, own in moments.items():
                rows = own["rows"].get(int(w), {})
                m = np.array([rows[r] for r in sorted(rows)], float)
                if w < 0:
                    s = np.full(len(x), 1.0 if squares else -1.0)
                elif squares:
                    s = np.sqrt(np.maximum((((x @ m) * x).sum(1) if m.size else np.zeros(len(x))) + own["lost"], 0) / own["n"])
                else:
                    s = ((x @ m[0] if m.size else np.zeros(len(x))) - own["lost"]) / own["n"]
                found.append(pa.table([part["id"], pa.array([c] * len(x), right.schema.field("cluster").type), pa.array(s)], names=["id", "cluster", "similarity"]))
        return pa.concat_tables(found) if found else pa.table([left["id"].slice(0, 0), right["cluster"].slice(0, 0), pa.array([], pa.float64())], names=["id", "cluster", "similarity"])

    return run


def cluster_similarity(vectors: DataFrame, members: DataFrame, rep: str, measure: str = "cosine", block: int | None = None) -> DataFrame:
    """(id, cluster, similarity) of vectors(id, v) to each cluster of members(member, cluster, v).

    A missing vector is -1 alike to all members; members without a cluster belong to none. No members give no rows. Averages and root mean squares of cosines follow
    from the clusters' sums of unit vectors and of their outer products, so no pairs are made. Blocks have ``ENTRIES`` numbers for cosines, else ``BLOCK`` vectors.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    some = members.where(F.col("cluster").isNotNull()).select("member", "cluster", F.col("v").cast("array<double>").alias("y"))
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = block or (max(1, ENTRIES // max(width or 1, 1)) if measure == "cosine" else BLOCK)
    rows = max(-(-n // block), min(cores, n), 1)
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("x"))
    kind = some.schema["cluster"].dataType
    if measure == "cosine" and rep in ("average", "rms"):
        form = T.StructType([T.StructField("cluster", kind), T.StructField("width", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
        moments = some.select("cluster", "y").mapInArrow(_moments(rep == "rms"), form).groupBy("cluster", "width", "r").applyInArrow(_added, form)
        columns = max(-(-some.select("cluster").distinct().count() // CLUSTERS), 1)
        left, right = _dealt(vectors, "_i", "_j", "id", rows, columns), _dealt(moments, "_j", "_i", "cluster", columns, rows)
        form = T.StructType([left.schema["id"], T.StructField("cluster", kind), T.StructField("similarity", T.DoubleType())])
        return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(_from_moments(rep == "rms"), form)
    columns = max(-(-some.count() // block), 1)
    left = _dealt(vectors, "_i", "_j", "id", rows, columns)
    right = _dealt(some, "_j", "_i", "member", columns, rows)
    if measure == "cosine":
        form = T.StructType([left.schema["id"], T.StructField("cluster", kind), *(T.StructField(c, T.DoubleType()) for c in ("most", "least", "total", "squares")), T.StructField("n", T.LongType())])
        parts = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(_cosines, form)
        how = {"nearest": F.greatest(F.max("most"), F.lit(0.0)), "furthest": F.least(F.min("least"), F.lit(1.0))}[rep]
        return parts.groupBy("id", "cluster").agg(how.alias("similarity"))
    met = left.hint("shuffle_hash").join(right, ["_i", "_j"]).select("id", "cluster", "x", "y")
    return representative_similarity(dense_similarity(met, measure, "x", "y"), rep, ["id", "cluster"])


def _one(column):
    import pyarrow as pa

    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _scaled(column, rows):
    """Vectors of one width, each brought near 1 by a power of two, which changes no cosine: (transposed, sums of squares, unit vectors, which have no direction)."""
    import numpy as np
    import pyarrow as pa

    v = np.array(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
    top = np.abs(v).max(1)
    v = np.ldexp(v, -np.frexp(np.where(np.isfinite(top), top, 1.0))[1][:, None]).T.copy()
    squares = np.zeros(len(rows))
    for x in v:
        squares += x * x
    none = ~((squares > 0) & (squares < np.inf))
    return v, squares, np.where(none, 0.0, v / np.sqrt(np.where(none, 1.0, squares))).T.copy(), none


def _top(x, y, k: int, low, high, entries: int):
    """(row, column, cosine) of the k columns of ``y`` most like each column of ``x``, in that order, ties to the lower one; those from ``low`` to ``high`` are left out, cosines without a value come first.

    A matrix product says which pairs can't be among the k; the others' products are added one after another and divided as in the SQL, so that equal cosines are equal to the last bit.
    """
    import numpy as np

    (xs, xx, xu, x_none), (ys, yy, yu, y_none) = x, y
    step, found = max(1, entries // max(len(yu), 1)), []
    for at in range(0, len(xu), step):
        s = xu[at : at + step] @ yu.T
        s[:, y_none] = np.inf
        s[x_none[at : at + step]] = np.inf
        for r in np.flatnonzero(high[at : at + step] > low[at : at + step]):
            s[r, low[at + r] : high[at + r]] = -np.inf
        # The k-th largest of the largest in groups is no larger than the k-th largest of all.
        n = s.shape[1]
        groups = s[:, : n // 32 * 32].reshape(len(s), 32, -1).max(1) if n >= 64 * k else s
        bound = np.partition(groups, -k, axis=1)[:, -k] if n > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= bound[:, None] - 1e-10) & (s > -np.inf))
        total = np.zeros(len(r))
        for p, q in zip(xs, ys, strict=True):
            total += p[at + r] * q[c]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.clip(total / np.sqrt(xx[at + r] * yy[c]), -1.0, 1.0)
        order = np.lexsort((c, -np.where(np.isnan(cosine), np.inf, cosine), r))
        begin = np.searchsorted(r[order], np.arange(len(s)))
        order = order[np.arange(len(order)) - begin[r[order]] < k]
        found.append((at + r[order], c[order], cosine[order]))
    return [np.concatenate(f) for f in zip(*found, strict=True)]


def _neighbours(k: int, entries: int):
    """Blocks of vectors (id, y) and of queries (query, x) to (query, id, similarity), the k best of each query in the block, in numbers as many as there are; null for vectors that can't be compared."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.take(pc.sort_indices(left["id"]))
        ids, queries, y, x = _one(left["id"]), _one(right["query"]), _one(left["y"]), _one(right["x"])
        codes = _one(pa.chunked_array([ids, queries]).dictionary_encode().unify_dictionaries().combine_chunks()).indices.to_numpy() if len(ids) or len(queries) else np.zeros(0, int)
        own, asked = codes[: len(ids)], codes[len(ids) :]
        repeats = np.bincount(own, minlength=codes.max(initial=-1) + 1)
        first = np.zeros(len(repeats), int)
        first[own[::-1]] = np.arange(len(own))[::-1]
        # Vectors with missing numbers, and empty ones, are like nothing.
        lost = lambda v: np.bincount(pc.list_parent_indices(v).to_numpy(), weights=pc.is_null(v.flatten()).to_numpy(zero_copy_only=False), minlength=len(v)) > 0
        widths = [np.where(lost(v), 0, pc.list_value_length(v).to_numpy()) for v in (y, x)]
        rows, columns, cosines = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for w in np.unique(widths[1][widths[1] > 0]):
            some, mine = np.flatnonzero(widths[0] == w), np.flatnonzero(widths[1] == w)
            if not len(some):
                continue
            flat = np.array(y.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(some), w)
            same = np.unique(flat.view(f"V{8 * w}").ravel(), return_inverse=True)[1]
            # Of equal vectors only the first can be among the best: k, and as many as share a query's id.
            order = np.argsort(same, kind="stable")
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order)) - np.searchsorted(same[order], same[order])
            some = some[place < k + repeats.max()]
            low, high = (np.searchsorted(some, f[asked[mine]]) for f in (first, first + repeats))
            r, c, s = _top(_scaled(x, mine), _scaled(y, some), k, low, high, entries)
            rows.append(mine[r])
            columns.append(some[c])
            cosines.append(s)
        r, c, s = map(np.concatenate, (rows, columns, cosines))
        had, more = np.bincount(r, minlength=len(queries)), []
        for q in np.flatnonzero(had < min(k, len(ids))):
            rest = np.flatnonzero((widths[0] != widths[1][q]) | (widths[0] == 0))
            more += [(q, i) for i in rest[own[rest] != asked[q]][: k - had[q]]]
        r, c = (np.append(v, [m[j] for m in more]).astype(int) for j, v in enumerate((r, c)))
        return pa.table([queries.take(pa.array(r)), ids.take(pa.array(c)), pa.array([*s, *[None] * len(more)] if more else s, pa.float64())], names=["query", "id", "similarity"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", block: int | None = None, entries: int = 1 << 22) -> DataFrame:
    """(query, rank, id, similarity): the k vectors of vectors(id, v) most like each of queries(id, v), without the one of its own id; ties to the smaller id.

    Queries and vectors meet in blocks, and each task keeps its k best of a query before anything is shuffled; for cosines a block is a matrix product, whose pairs are ``entries`` at once at most.
    Null ids and vectors take no part. A zero vector has no cosine (NaN), which comes before all others, as in SQL; vectors that can't be compared come last, with null.
    """
    own = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("y"))
    asked = queries.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").alias("query"), F.col("v").cast("array<double>").alias("x"))
    (n, width), m = own.agg(F.count(F.lit(1)), F.max(F.size("y"))).first(), asked.count()
    block = block or (max(1, ENTRIES // max(width or 1, 1)) if measure == "cosine" else BLOCK)
    rows, columns = max(-(-n // block), min(own.sparkSession.sparkContext.defaultParallelism, n), 1), max(-(-m // block), 1)
    left, right = _dealt(own, "_i", "_j", "id", rows, columns), _dealt(asked, "_j", "_i", "query", columns, rows)
    if measure == "cosine":
        form = T.StructType([right.schema["query"], left.schema["id"], T.StructField("similarity", T.DoubleType())])
        scored = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(_neighbours(k, entries), form)
    else:
        met = left.hint("shuffle_hash").join(right, ["_i", "_j"]).where("id <> query")
        scored = dense_similarity(met.select("query", "id", "x", "y"), measure, "x", "y").select("query", "id", "similarity")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def most_similar(scored: DataFrame) -> DataFrame:
    """(id, cluster, similarity) of each id's best cluster; ties go to the smallest name."""
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "cluster")
    return scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def best_clusters(vectors: DataFrame, members: DataFrame, rep: str, measure: str = "cosine") -> DataFrame:
    """(id, cluster, similarity) of each vector's best cluster; ties go to the smallest name.

    No cosine is above 1, so where a vector's own direction is among the members (in k-means it always is) those are its nearest; only the others meet all members.
    Missing and zero vectors are equally like all clusters.
    """
    if measure != "cosine" or rep != "nearest":
        return most_similar(cluster_similarity(vectors, members, rep, measure))
    some = members.where(F.col("cluster").isNotNull())
    size = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    # Directions to 40 bits: closer ones have a cosine of 1 in double precision.
    sized = lambda df: df.withColumn("_size", size).withColumn("_way", F.when((F.col("_size") > 0) & (F.col("_size") < float("inf")) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)), F.transform("v", lambda x: F.floor(x.cast("double") / F.col("_size") * F.lit(float(1 << 40))))))
    own = sized(vectors.select("id", "v"))
    ways = sized(some).where("_way IS NOT NULL").groupBy("_way").agg(F.min("cluster").alias("cluster"))
    first = some.agg(F.min("cluster").alias("cluster")).where("cluster IS NOT NULL")
    met = own.join(ways, "_way", "left")
    alike = met.where("cluster IS NOT NULL").select("id", "cluster", F.lit(1.0).alias("similarity"))
    none = F.col("v").isNull() | F.forall("v", lambda x: F.coalesce(x == 0, F.lit(False)))
    level = own.where(none).select("id").crossJoin(F.broadcast(first)).select("id", "cluster", F.lit(0.0).alias("similarity"))
    rest = met.where(F.col("cluster").isNull() & ~none).select("id", "v")
    return alike.unionByName(level).unionByName(most_similar(cluster_similarity(rest, some, rep, measure)))


def cluster_by_members(vectors: DataFrame, parameters: ClusterParameters | str, seeds: DataFrame) -> DataFrame:
    """(id, cluster) of vectors(id, v) where clusters are as like as their members are.

    seeds: (key, v), any number of vectors for each key: the first members. Grow-seeds gives each vector the best cluster, if it reaches the threshold.
    K-means takes what a round has put into a cluster, the vector itself with it, as the members of the next, until nothing changes or the rounds are done; a
    cluster that got no member is gone.
    """
    p = ClusterParameters.parse(parameters) if isinstance(parameters, str) else parameters
    if p.rep == "centroid" or p.method not in ("growseed", "kmeans"):
        raise NotImplementedError(f"{p.method} with representative {p.rep} by members")
    ensure_checkpoints(vectors.sparkSession)
    members = seeds.select(F.xxhash64("key", "v").alias("member"), F.col("key").cast("string").alias("cluster"), "v")
    own = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    best = best_clusters(own, members, p.rep, p.measure)
    if p.method == "growseed":
        met = own.select("id").join(best, "id", "left")
        return met.select("id", F.when(F.col("similarity") >= p.threshold, F.col("cluster")).alias("cluster"))
    best = best.select("id", "cluster").checkpoint()
    for _ in range(max(2, p.iterations) - 1):
        members = own.join(best, "id").select(F.col("id").alias("member"), "cluster", "v")
        new = best_clusters(own, members, p.rep, p.measure).select("id", "cluster").checkpoint()
        changed = new.join(best.withColumnRenamed("cluster", "before"), "id").where("cluster <> before").limit(1).count()
        best = new
        if not changed:
            break
    return best


def nearest_without_conflict(vectors: DataFrame, centres: list[tuple[str, list[float]]], forbidden: DataFrame, measure: str = "cosine") -> DataFrame:
    """(id, cluster, similarity): the nearest of few centres that a vector isn't forbidden; where all are, the nearest of all.

    forbidden: (id, cluster), as many rows as there are. They are gathered by vector, a list no longer than the centres are many, and meet the vectors in one join;
    each vector then chooses by itself.
    """
    names = [k for k, _ in sorted(centres)]
    lists = forbidden.where(F.col("cluster").isin(names)).groupBy(F.col("id").alias("_id")).agg(F.collect_set("cluster").alias("_no"))
    met = vectors.join(lists, F.col("id") == F.col("_id"), "left").drop("_id")
    free = nearest_of(met.where("_no IS NULL"), centres, measure).select("id", "cluster", "similarity")
    tied = met.where("_no IS NOT NULL")
    # One column for each centre: its similarity, unless the vector may not have it.
    scored = tied.select("id", "v", "_no", F.explode(F.array(*[F.struct(F.lit(k).alias("cluster"), F.array(*[F.lit(float(x)) for x in v]).alias("y")) for k, v in sorted(centres)])).alias("c"))
    scored = dense_similarity(scored.select("id", "v", "c.*", F.array_contains("_no", F.col("c.cluster")).alias("no")), measure, "v", "y")
    best = Window.partitionBy("id").orderBy("no", F.desc("similarity"), "cluster")
    chosen = scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("id", "cluster", "similarity")
    return free.unionByName(chosen)


def seed_conflicts(vectors: DataFrame, centres: list[str], own: str = "seed") -> DataFrame:
    """(id, cluster): a vector that has a seed's name is forbidden all other seeds' clusters."""
    named = vectors.where(F.col(own).isNotNull()).select("id", F.col(own).cast("string").alias("_own"))
    return named.withColumn("cluster", F.explode(F.array(*[F.lit(k) for k in centres]))).where("cluster <> _own").select("id", "cluster")


def pair_conflicts(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, cluster) from pairs (id, other) that may not share a cluster: the vector of the larger id may not have the cluster of the other one, so that of two which
    stand against each other one gives way. assigned: (id, cluster).
    """
    ordered = pairs.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).where("id <> other").distinct()
    return ordered.join(assigned.select(F.col("id").alias("other"), "cluster"), "other").where(F.col("cluster").isNotNull()).select("id", "cluster").distinct()


def q_representative(rep):
    """Two rounds from the labels, clusters being as like as their members are."""

    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        return cluster_by_members(v, f"method=kmeans,rep={rep},iterations=2", v.select(F.col("label").cast("string").alias("key"), "v"))

    return run


def q_growseed(spark, sf_dir):
    """Labels as clusters that are as like a vector as the root mean square of their members; null below the threshold."""
    v = _vectors(spark, sf_dir)
    return cluster_by_members(v, "method=grow,rep=rms,threshold=0.19", v.select(F.col("label").cast("string").alias("key"), "v"))


def q_conflicts(spark, sf_dir):
    """Nearest labels where neighbours by id may not share one and a vector may not have the label before its own."""
    v = _vectors(spark, sf_dir)
    seeds = [(str(r[0]), [float(x) for x in r[1]]) for r in v.groupBy("label").agg(F.min_by("v", "id").alias("v")).collect()]
    first = nearest_of(v, seeds).select("id", "cluster")
    pairs = pair_conflicts(v.select("id", (F.col("id") + 1).alias("other")), first)
    own = v.select("id", ((F.col("label") + 9) % 10).cast("string").alias("cluster"))
    return nearest_without_conflict(v, seeds, pairs.unionByName(own)).select("id", "cluster", F.round("similarity", 6).alias("similarity"))


_V = "WITH v AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings)"


_HOW = {"nearest": "greatest(max(s), 0)", "furthest": "least(min(s), 1)", "average": "avg(s)", "rms": "sqrt(avg(s * s))"}
_P = f"{_V}, p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM v x, v y), r0 AS (SELECT id, label AS cluster FROM v)"


def _representative_sql(rep: str) -> str:
    step = "(SELECT a AS id, cluster FROM (SELECT p.a, m.cluster, {how} AS q FROM p JOIN {m} m ON m.id = p.b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY q DESC, cluster) = 1)"
    return f"{_P}, r1 AS MATERIALIZED {step.format(how=_HOW[rep], m='r0')}, r2 AS {step.format(how=_HOW[rep], m='r1')} SELECT * FROM r2"


QUERIES = {f"cluster_rep_{r}": q_representative(r) for r in ("nearest", "furthest", "average", "rms")} | {"cluster_rep_growseed": q_growseed, "cluster_conflicts": q_conflicts}
SQL = {f"cluster_rep_{r}": _representative_sql(r) for r in ("nearest", "furthest", "average", "rms")} | {
    "cluster_rep_growseed": f"{_P}, q AS (SELECT p.a, m.cluster, {_HOW['rms']} AS q FROM p JOIN r0 m ON m.id = p.b GROUP BY ALL) SELECT a AS id, CASE WHEN q >= 0.19 THEN cluster END AS cluster FROM q QUALIFY row_number() OVER (PARTITION BY a ORDER BY q DESC, cluster) = 1",
    "cluster_conflicts": f"{_V}, s AS (SELECT label AS key, arg_min(v, id) AS c FROM v GROUP BY label), q AS (SELECT v.id, v.label, key, list_cosine_similarity(v.v, c) AS sim FROM v, s), a AS (SELECT id, key FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, key) = 1), "
    "f AS (SELECT id + 1 AS id, key FROM a UNION SELECT id, ((label::INT + 9) % 10)::VARCHAR FROM v) SELECT id, q.key AS cluster, round(sim, 6) AS similarity FROM q LEFT JOIN f USING (id, key) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f.key IS NOT NULL, sim DESC, q.key) = 1",
}
