"""Embedding whitening by a bit-sliced scatter.

Entries become integers. Of the distinct vectors each dimension is shifted to start at 0 and cut into bit planes; the bits
of 64 rows make a word. The sum of products of two dimensions is then the sum over pairs of their planes of
2 ** (a + b) times the number of common bits, so AND and popcount over words give all cross products exactly. Tasks weigh
their counts into limbs of 64-bit integers, Spark adds the limbs as decimals, and the driver, which gets one row for each pair
of dimensions, centres them as integers (n * sum of products minus product of sums, free of the shift) before
the eigenvectors are taken. So nothing is rounded before the covariance, however large the mean is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Tables

#: An entry c becomes floor(SCALE * c).
SCALE = 256
#: Components that are returned.
COMPONENTS = 4
#: Rows whose planes are made at once, a multiple of 64.
BLOCK = 4096
#: Bits of weight in one limb: a limb of a task stays below 2 ** 63 for 2 ** 32 rows.
LIMB = 20
#: Entries beyond this many bits can't become integers exactly.
_WIDEST = 62


def usable(vector: Column) -> Column:
    """Not null, and no null, non-finite or (2 ** 62 / SCALE and more) too large entry."""
    far = float(1 << _WIDEST) / SCALE
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(far)), F.lit(False)))


def whole_entries(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bit_planes(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """The planes of a matrix of non-negative integers, dimension by dimension, low bit first, each as words of 64 rows."""
    rows = -len(u) % 64
    u = np.vstack([u, np.zeros((rows, u.shape[1]), u.dtype)]) if rows else u
    planes = [(u[:, d] >> np.uint64(b)) & np.uint64(1) for d in range(u.shape[1]) for b in range(bits[d])]
    if not planes:
        return np.zeros((0, len(u) // 64), np.uint64)
    return np.packbits(np.array(planes, np.uint8), axis=1, bitorder="little").view("<u8")


def _scatter(lows: list[int], bits: list[int]):
    """(i, j, limb, total): of each pair of dimensions the weighted common bits of a task's rows; pairs with j = -1 hold the sums of dimension i."""
    width = len(lows)
    dims = np.repeat(np.arange(width), bits)
    weight = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if sum(bits) else np.empty(0, np.int64)
    limbs = max(2 * max(bits, default=0) // LIMB + 1, 1)
    first = np.concatenate([[0], np.cumsum(bits)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width, limbs), np.int64)
        some = False
        for batch in batches:
            x = _rows(batch.column(0), width)
            for low in range(0, len(x), BLOCK):
                some = True
                planes = bit_planes((x[low : low + BLOCK] - np.array(lows)).view(np.uint64), bits)
                np.add.at(total[width], (dims, weight // LIMB), np.bitwise_count(planes).sum(1, dtype=np.int64) << (weight % LIMB))
                for i in range(width):
                    own, rest = planes[first[i] : first[i + 1]], planes[first[i] :]
                    for a in range(len(own)):
                        common = np.bitwise_count(own[a] & rest).sum(1, dtype=np.int64)
                        s = weight[first[i] :] + a
                        np.add.at(total[i], (dims[first[i] :], s // LIMB), common << (s % LIMB))
        if some:
            i, j, limb = (x.ravel() for x in np.indices(total.shape))
            use = (j >= i) | (i == width)
            i, j = np.where(i == width, j, i), np.where(i == width, -1, j)
            columns = [pa.array(v.astype(np.int32)[use]) for v in (i, j, limb)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total.ravel()[use])], names=["i", "j", "limb", "total"])

    return run


def _limits(width: int):
    """(d, low, high, n) of each dimension over a task's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), width)
                n, low, high = n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(width, n))], names=["d", "low", "high", "n"])

    return run


class Fit:
    """n, integer sums, and components of a fit list; ``values`` fall, ``vectors`` has a row for each component."""

    def __init__(self, n: int, sums: list[int], cross: dict[tuple[int, int], int], least: list[int], most: list[int], count: int) -> None:
        """sums and cross: of entries less ``least``."""
        width = len(sums)
        self.n, self.sums = n, [s + n * low for s, low in zip(sums, least)]
        v = np.zeros((width, width))
        for (i, j), p in cross.items():
            # Integers up to the last division, which rounds once.
            v[i, j] = v[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(v)
        self.trace = float(np.trace(v))
        self.values = values[::-1][:count]
        self.vectors = vectors.T[::-1][:count]
        # A component without variance (up to rounding) can't be scaled to one.
        self.flat = self.values <= self.trace * 1e-13 * width
        # Whether the sum of squares of n * x - S fits 64 bits for every x between the bounds.
        self.fits = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(least, most, self.sums)) < 1 << 63

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A row of components for each row of x; null (nan) for components without variance."""
        mean = np.array([s // self.n for s in self.sums], np.int64), np.array([(s % self.n) / self.n for s in self.sums])
        # The whole part of the mean is taken off as an integer, so large means cost no digits.
        centred = (x - mean[0]).astype(float) - mean[1]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.flat, np.nan, centred @ self.vectors.T / np.sqrt(np.where(self.flat, 1.0, self.values)))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        if self.fits:
            # The difference fits 64 bits; modulo 2 ** 64 it is right even where its parts don't.
            sums = np.array([s % (1 << 64) for s in self.sums], np.uint64).view(np.int64)
            return ((self.n * x - sums) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _fit(distinct: DataFrame, width: int, count: int) -> Fit:
    """What reaches the driver is a row for each dimension and for each pair of dimensions (and limb), however many vectors there are."""
    limits = distinct.mapInArrow(_limits(width), "d int, low long, high long, n long").groupBy("d").agg(F.min("low"), F.max("high"), F.sum("n")).orderBy("d").collect()
    least, most, n = [r[1] for r in limits], [r[2] for r in limits], limits[0][3] if limits else 0
    bits = [(b - a).bit_length() for a, b in zip(least, most)]
    added = distinct.mapInArrow(_scatter(least, bits), "i int, j int, limb int, total long").groupBy("i", "j", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums, cross = [0] * width, {}
    for i, j, limb, total in added.toLocalIterator():
        part = int(total) << (LIMB * limb)
        if j < 0:
            sums[i] += part
        else:
            cross[i, j] = cross.get((i, j), 0) + part
    return Fit(n, sums, cross, least, most, count)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    Entries become floor(scale * c). The covariance is that of the distinct vectors, so repeated rows don't shift it; they each get their
    rows, null ids too. Rows whose vector is null, holds a null or non-finite entry, or one of 2 ** 62 / scale and more, take no part; nor do rows whose
    length isn't the commonest one (ties: the longer), for which there is no covariance; empty vectors have no components, so no rows. ``deviation`` is null where
    it doesn't fit 64 bits. Equal eigenvalues leave their components' order and direction open, but all rows get the same. A component without variance has a null
    ``whitened`` and no part in ``identity_error``, which is null if there is no other; ``explained`` is null if no component has variance. The covariance (a number for each pair of dimensions) must fit the driver. Other columns are ignored, whatever
    their names; no rows give no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "whitening")
    kind = vectors.schema[id_col].dataType
    form = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    rows = tables.keep(vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_entries(F.col(vector_col), scale).alias("x")))
    shape = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not shape or not shape[0]["width"]:
        return spark.createDataFrame([], form)
    width = shape[0]["width"]
    rows = rows.where(F.size("x") == width)
    distinct = tables.keep(rows.select("x").distinct())
    fit = _fit(distinct, width, min(components, width))
    k = len(fit.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = fit.whitened(_rows(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in range(k)], names=[f"w{c}" for c in range(k)])

    seen = distinct.mapInArrow(project, ", ".join(f"w{c} double" for c in range(k)))
    some = [c for c in range(k) if not fit.flat[c]]
    error = None
    if some:
        pairs = [(a, b) for a in some for b in some if a <= b]
        got = seen.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
        error = max(abs(v - (a == b)) for v, (a, b) in zip(got, pairs))
    explained = [max(float(e), 0.0) / fit.trace if fit.trace > 0 else None for e in fit.values]

    def results(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x, m = _rows(part.column(1), width), part.num_rows
                w = fit.whitened(x).ravel()
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    pa.array([d for d in fit.deviations(x) for _ in range(k)], pa.int64()), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=form.names)

    return rows.mapInArrow(results, form)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
