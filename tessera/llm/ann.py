"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample by balanced splitting (every cut halves its part) and a few mean steps. A vector
is filed under its nearest centroid and, near a boundary, under further ones whose distance is within a ratio of the
least. A query reads the lists whose centroids are within a wider ratio of its nearest one; the ratio is the one at which queries
of the sample reach the recall asked for among the sample. Nearest
centroids, for filing and for queries, are found by a best-first walk over a graph of the centroids held in memory.

Lists stay on the executors: queries travel to the lists they read, each list hands back its best few, and these are merged.
Lists of more than ``LIST_BLOCK`` entries are salted into blocks, so identical or crowded vectors fill no task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables
from .words import group_bounds, key_groups

#: Vectors that centroids are fitted on at most (lowest hashes first).
SAMPLE = 40_000
#: Centroids: one for so many vectors, up to so many times the square root of their number, and at most what each worker is to hold.
LIST_SIZE, ROOTS, CENTROIDS = 60, 4, 4096
#: Lists that a vector is filed under at most, and the ratio of distances up to which it is.
REPLICAS, FILED = 4, 1.1
#: The recall within the sample that the reading ratio is fitted to, and the queries of the sample that it is fitted on.
RECALL, FITTED = 0.95, 300
LIST_BLOCK = 4000
#: Found rows that a task holds before it keeps the nearest only, and the parts for each core that lists are dealt to: a query gives k rows at most for each part, however many lists it reads.
HELD, PARTS = 1 << 18, 4
NEIGHBOURS, BEAM = 24, 48


class CentroidGraph:
    """Centroids with links to their nearest ones and a few long ones."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        self.norms = (self.centroids**2).sum(1)
        k = min(NEIGHBOURS, n - 1)
        near = self._distances(self.centroids)
        np.fill_diagonal(near, np.inf)
        links = np.argpartition(near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((n, 1), int)
        far = np.random.default_rng(5).integers(0, n, (n, 4))
        self.links = np.hstack([links, far])
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(int)
        #: Ratios hold against this distance at least: a vector that is nearly a centroid still has the neighbourhood of any other.
        self.floor = 0.0

    def _distances(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """From each row of x to all centroids, or to a row of them each."""
        if at is None:
            d = self.norms - 2 * x @ self.centroids.T
        else:
            d = self.norms[at] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[at])
        return np.sqrt(np.maximum(d + (x**2).sum(1)[:, None], 0))

    def search(self, x: np.ndarray, ratio: float, most: int | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs within ``ratio`` of the nearest centroid found; ``most`` nearest at most, ``least`` at least.

        The walk of a row goes on from its nearest unvisited nodes until none of those it would go on from
        lies within the ratio (or among its nearest ``BEAM``).
        """
        rows, n = np.arange(len(x)), len(self.centroids)
        beam = min(n, max(BEAM, least))
        found = np.full((len(x), n), np.inf, np.float32)
        if 2 * least >= n:
            found[:] = self._distances(x)
        else:
            found[:, self.entries] = self._distances(x, np.tile(self.entries, (len(x), 1)))
        walked = np.zeros((len(x), n), bool)
        active = rows
        while len(active):
            part = np.where(walked[active], np.inf, found[active])
            step = min(8, n)
            ahead = np.argpartition(part, step - 1, axis=1)[:, :step]
            open_ = np.take_along_axis(part, ahead, 1)
            rank = np.partition(found[active], beam - 1, axis=1)[:, beam - 1]
            limit = np.maximum(np.maximum(found[active].min(1), self.floor) * ratio, np.where(np.isfinite(rank), rank, np.inf))
            useful = open_.min(1) <= limit
            useful &= np.isfinite(open_.min(1))
            active, ahead = active[useful], ahead[useful]
            if not len(active):
                break
            walked[active[:, None], ahead] = True
            links = self.links[ahead].reshape(len(active), -1)
            found[active[:, None], links] = self._distances(x[active], links)
        near = found <= np.maximum(found.min(1, keepdims=True), self.floor) * ratio + 1e-7
        if least > 1:
            np.put_along_axis(near, np.argpartition(found, min(least, n) - 1, axis=1)[:, :least], True, 1)
            near &= np.isfinite(found)
        if most is not None and most < n:
            nearest = np.argpartition(found, most - 1, axis=1)[:, :most]
            allowed = np.zeros_like(near)
            np.put_along_axis(allowed, nearest, True, 1)
            near &= allowed
        return np.nonzero(near)


def balanced_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` parts of about equal size: each part is halved along the line between two far points, then two mean steps."""
    rng, parts = np.random.default_rng(9), [np.arange(len(sample))]
    while len(parts) < count:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        v = sample[part]
        a = v[rng.integers(len(v))]
        a = v[((v - a) ** 2).sum(1).argmax()]
        b = v[((v - a) ** 2).sum(1).argmax()]
        order = np.argsort(v @ (b - a), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    means = np.array([sample[p].mean(0) for p in parts])
    for _ in range(3):
        own = np.concatenate([((means**2).sum(1) - 2 * s @ means.T).argmin(1) for s in np.array_split(sample, max(1, len(sample) // 2000))])
        counts = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, sample)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def usable(vector: Column) -> Column:
    """Vectors that are neither null nor zero and hold neither nulls nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([a.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for a in arrays]) if arrays else np.empty((0, width))


def _file(graph: CentroidGraph, width: int, ratio: float, most: int | None, kind: int, least: int = 1):
    """(id, vector) to (list, kind, id, vector) for each list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows, lists = graph.search(_matrix(part.column(1), width).astype(np.float32), ratio, most, least)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(np.full(len(rows), kind), pa.int32()), taken.column(0), taken.column(1)], names=["list", "kind", "id", "vector"])

    return run


def _first(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of (query, id, distance) to the k nearest ids of each query; an id found several times counts once, with its least distance."""
    q, v, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((d, v, q))
    q, v, d = q[order], v[order], d[order]
    once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))[: len(q)]
    q, v, d = q[once], v[once], d[once]
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    begin = group_bounds([q])
    near = np.arange(len(q)) - np.repeat(begin[:-1], np.diff(begin)) < k
    return q[near], v[near], d[near]


def _best(width: int, k: int):
    """Sorted (list, block, kind, id, vector), queries before entries, to (query_id, vec_id, score): the best k of each query among all blocks of the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], HELD
        for t in key_groups(batches, 2):
            bounds = group_bounds([t.column(0).to_numpy(), t.column(1).to_numpy()])
            kinds, ids = t.column(2).to_numpy(), t.column(3).to_numpy()
            vectors = _matrix(t.column(4), width).astype(np.float64)
            q_out, v_out, s_out = [], [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                cut = low + int(np.searchsorted(kinds[low:high], 1))
                if cut == low or cut == high:
                    continue
                x, x_ids = vectors[cut:high], ids[cut:high]
                norms = (x**2).sum(1)
                # Ids are sorted; each counts once, with its nearest vector.
                begin = np.flatnonzero(np.append(True, x_ids[1:] != x_ids[:-1]))
                names, several = x_ids[begin], len(begin) < len(x_ids)
                for at in range(low, cut, 256):
                    q = vectors[at : min(at + 256, cut)]
                    rough = norms - 2 * q @ x.T + (q**2).sum(1)[:, None]
                    if several:
                        rough = np.minimum.reduceat(rough, begin, axis=1)
                    for r in range(len(q)):
                        d = np.where(names == ids[at + r], np.inf, rough[r])
                        # All that may be among the best k after rounding are measured exactly.
                        limit = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                        near = np.flatnonzero((d <= limit + 1e-9 * (norms.max() + (q[r] ** 2).sum())) & np.isfinite(d))
                        if not len(near):
                            continue
                        if several:
                            ends = np.append(begin[1:], len(x_ids))
                            exact = np.array([np.sqrt(((x[begin[j] : ends[j]] - q[r]) ** 2).sum(1)).min() for j in near])
                        else:
                            exact = np.sqrt(((x[near] - q[r]) ** 2).sum(1))
                        first = np.lexsort((names[near], exact))[:k]
                        q_out.append(np.full(len(first), ids[at + r]))
                        v_out.append(names[near[first]])
                        s_out.append(exact[first])
            if q_out:
                held.append(tuple(map(np.concatenate, (q_out, v_out, s_out))))
            if sum(len(h[0]) for h in held) > most:
                held = [_first(held, k)]
                # What is kept is bounded by the queries; past that bound the limit moves, so that each cut halves what is held.
                most = max(HELD, 2 * len(held[0][0]))
        if held:
            q, v, d = _first(held, k)
            for at in range(0, len(q), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (q, v, d)], names=["query_id", "vec_id", "score"])

    return run


def reading_ratio(graph: CentroidGraph, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The ratio up to which queries of the sample must read lists to meet a share ``recall`` of their k nearest others in it."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    x = sample.astype(np.float32)
    asked = x[:FITTED]
    d = (x**2).sum(1) - 2 * asked @ x.T
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
    rows, lists = graph.search(x[near], FILED, REPLICAS)
    whole = graph._distances(asked)
    need = np.full(len(near), np.inf)
    np.minimum.at(need, rows, whole[rows // k, lists])
    base = np.repeat(np.maximum(whole.min(1), graph.floor), k)
    # Where all vectors are equal there is nothing to prune.
    ratio = np.divide(need, base, out=np.ones_like(need), where=base > 0)
    return float(min(max(1.0, np.quantile(ratio, recall)), 1e6))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", read: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found among ``vectors``, without itself, by Euclidean distance.

    Ids are integers and name vectors: repeated rows are found once (rows that share an id but not the vector by the nearest of them), rows with a null id take no part. Vectors that aren't ``usable``, or whose
    length isn't the commonest one, take no part either, as queries or candidates. Ties go to the smaller id. Other columns are ignored, whatever their names. ``read`` sets
    the reading ratio; without it, it is fitted (``reading_ratio``). With no more lists than a query reads, the result is exact. No rows give no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "nearest")

    def clean(df):
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    base = clean(vectors)
    shape = base.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    form = "query_id long, rank int, vec_id long, score double"
    if not shape:
        return spark.createDataFrame([], form)
    width, total = shape[0]["width"], shape[0]["n"]
    base = base.where(F.size("vector") == width)
    if base.groupBy("id").count().where("count > 1").limit(1).count():
        base = base.dropDuplicates(["id", "vector"])
    asked = clean(queries).where(F.size("vector") == width)
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    sample = _matrix(sample.column(0), width).astype(np.float64)
    graph = CentroidGraph(balanced_centroids(sample, max(1, min(CENTROIDS, int(ROOTS * total**0.5), total // LIST_SIZE, len(sample) // 8))))
    some = sample[:2000].astype(np.float32)
    graph.floor = 0.95 * float(np.median(graph._distances(some).min(1)))
    ratio = reading_ratio(graph, sample, k) if read is None else read
    kind = base.schema["vector"].dataType.simpleString()
    entry = f"list int, kind int, id long, vector {kind}"
    filed = tables.keep(base.mapInArrow(_file(graph, width, FILED, REPLICAS, 1), entry))
    # A row for each list: the number of centroids bounds it.
    sizes = {r[0]: r[1] for r in filed.groupBy("list").agg(F.countDistinct("id")).collect()}
    blocks = {i: -(-n // LIST_BLOCK) for i, n in sizes.items() if n > LIST_BLOCK}
    # So many lists hold more than k different vectors even if they are the shortest ones.
    held = np.cumsum(sorted(sizes.get(i, 0) for i in range(len(graph.centroids)))) / REPLICAS
    least = int(min(np.searchsorted(held, 2 * k + 1) + 1, len(graph.centroids)))
    many = F.lit(1) if not blocks else F.coalesce(F.get(F.array(*[F.lit(blocks.get(i, 1)) for i in range(len(graph.centroids))]), F.col("list")), F.lit(1))
    entries = filed.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    asking = asked.mapInArrow(_file(graph, width, ratio, None, 0, least), entry).withColumn("block", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
    dealt = entries.unionByName(asking).select("list", "block", "kind", "id", "vector").repartition(PARTS * spark.sparkContext.defaultParallelism, "list", "block").sortWithinPartitions("list", "block", "kind", "id")
    found = dealt.mapInArrow(_best(width, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
