"""Whitening against exact arithmetic, on the smallest table and on odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

SHAPE = "vec_id long, embedding array<float>"


def brute(rows, components=4, scale=256):
    """{row: ...} by exact covariance; (n, values, vectors, S) and the usable rows."""
    use = [(i, [math.floor(float(scale) * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in dict.fromkeys(tuple(x) for _, x in use)]
    n, width = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(width)]
    v = [[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3)) for b in range(width)] for a in range(width)]
    values, vectors = np.linalg.eigh(np.array(v))
    deviation = {tuple(x): sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in fit}
    return use, n, s, values[::-1][:components], vectors.T[::-1][:components], deviation, float(np.trace(np.array(v)))


def check(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    use, n, s, values, vectors, deviation, trace = brute([(r[0], r[1]) for r in df.collect()])
    assert sorted(got) == sorted({i for i, _ in use})
    signs = {}
    for i, x in use:
        for k, (e, vector) in enumerate(zip(values, vectors), 1):
            for r in got[i][k]:
                assert (r.n, r.deviation) == (n, deviation[tuple(x)])
                assert r.explained == pytest.approx(e / trace, rel=1e-6)
                assert r.identity_error < 1e-9
                want = sum(float(Fraction(n * c - t, n)) * w for c, t, w in zip(x, s, vector)) / math.sqrt(e)
                if abs(want) > 1e-6:
                    sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
                    assert r.whitened == pytest.approx(sign * want, rel=1e-6, abs=1e-8)
    return got


def test_query_against_exact_covariance(spark, sf_dir):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(80).collect()]
    check(spark, rows)
    out = whitening.op11_whitening(spark, sf_dir)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 4 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=5) * [1, 2, 3, 0.1, 0.5] + [0, 100, -7, 0, 1]]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(40)]  # copies count once in the fit
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0, float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    got = check(spark, rows, "double")
    assert not set(got) & {200, 201, 202, 203} and len(got) == 100


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    check(spark, [(k, [1e9 + float(a), -1e9 + float(b)]) for k, (a, b) in enumerate(rng.normal(size=(6, 2)))], "double")
    # A deviation beyond 64 bits is null; other columns are as ever.
    far = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in far if r.vec_id != 3) and all(r.identity_error < 1e-6 for r in far)
    # An entry that no long can hold leaves its row out.
    assert {r.vec_id for r in whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()} == {2, 3}


def test_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SHAPE + ", n int, x int, id string")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None, 1, 1, "a"), (2, [], 1, 1, "a")])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0], 1, 1, "a"), (None, [1.0, 2.0], 1, 1, "a")])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in one)
    # The commonest width takes part; a constant dimension has a component without variance.
    mixed = whitening.whiten(make([(1, [1.0, 2.0, 0.5], 1, 1, "a"), (2, [3.0, 2.0, 0.25], 1, 1, "a"), (3, [2.0, 2.0, 9.0], 1, 1, "a"), (4, [1.0], 1, 1, "a")])).collect()
    assert {r.vec_id for r in mixed} == {1, 2, 3} and {r.component for r in mixed if r.whitened is None} == {3}
    assert all(r.identity_error < 1e-9 for r in mixed)


def test_planes_and_popcounts_give_cross_products():
    rng = np.random.default_rng(5)
    u = rng.integers(0, 1 << 11, (131, 4)).astype(np.uint64)
    bits = [int(c).bit_length() for c in u.max(0)]
    planes = whitening.bit_planes(u, bits)
    first = np.concatenate([[0], np.cumsum(bits)])
    for i in range(4):
        for j in range(4):
            total = sum(int(np.bitwise_count(planes[first[i] + a] & planes[first[j] + b]).sum()) << (a + b) for a in range(bits[i]) for b in range(bits[j]))
            assert total == int((u[:, i].astype(object) * u[:, j].astype(object)).sum())
