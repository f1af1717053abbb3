"""Thirty similarity measures as closed forms over sufficient statistics, for dense and sparse vectors.

One pass over a pair of vectors gives the statistics a measure needs; the measure is a column over them:

    n            number of positions (dense) or of terms in either vector (sparse)
    sx sy        sums of weights               sxx syy sxy   sums of products
    mx my        largest weights               n1 n2 nb      non-zero weights of x, of y, of both
    m1 m2        sums of x and of y where both are non-zero
    smin smax    sums of the smaller and of the larger weight
    sabs         sum of |x - y|                sdd           sum of (x - y)^2
    can          sum of |x - y| / (x + y)      rob           sum of |x / sx - y / sy|
    js           sum of p log2(p / m) + q log2(q / m), p = x / sx, q = y / sy, m = (p + q) / 2
    a b c        weighted contingency: after division by the largest weight, the sum of the smaller weight where both
                 are non-zero, of x only, of y only
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """SQL over the statistics. ``normalised``: dense vectors are divided by their length first; ``signed``: negative weights make sense."""

    dense: str
    sparse: str | None = None
    normalised: bool = True
    signed: bool = False

    @property
    def sparse_sql(self) -> str:
        return self.sparse or self.dense


_TRI_B, _TRI_C = "(CASE WHEN a = 0 AND b = 0 THEN 0.001 ELSE b END)", "(CASE WHEN a = 0 AND c = 0 THEN 0.001 ELSE c END)"
_LO, _HI = f"least({_TRI_B}, {_TRI_C})", f"greatest({_TRI_B}, {_TRI_C})"
_TRIPARTITE = f"sqrt((ln(1 + (a + {_LO}) / (a + {_HI})) / ln(2)) * (1 / sqrt(ln(2 + {_LO} / (a + 1)) / ln(2))) * (ln(1 + a / (a + {_TRI_B})) / ln(2)) * (ln(1 + a / (a + {_TRI_C})) / ln(2)))"
_HALF = "(0.5 * (m1 + m2))"

MEASURES: dict[str, Measure] = {
    "cosine": Measure("sxy / (sqrt(sxx) * sqrt(syy))", "CASE WHEN sxx = 0 OR syy = 0 THEN 0 ELSE sxy / (sqrt(sxx) * sqrt(syy)) END", signed=True),
    "euclidean": Measure("1 - sqrt(sdd)", "1 - sqrt(sdd) / (sqrt(sxx) + sqrt(syy))", signed=True),
    "manhattan": Measure("1 - sabs", "1 - sabs / (sx + sy)", signed=True),
    "jaccard": Measure("nb / (n1 + n2 - nb)", normalised=False, signed=True),
    "simpson": Measure("nb / least(n1, n2)", normalised=False, signed=True),
    "bin_dice": Measure("2 * nb / (n1 + n2)", normalised=False, signed=True),
    "bin_antidice": Measure("nb / (nb + 2 * (n1 + n2 - 2 * nb))", normalised=False, signed=True),
    "bin_gamma": Measure("CASE WHEN nb * (n - n1 - n2 + nb) + (n1 - nb) * (n2 - nb) > 0 THEN (nb * (n - n1 - n2 + nb) - (n1 - nb) * (n2 - nb)) / (nb * (n - n1 - n2 + nb) + (n1 - nb) * (n2 - nb)) ELSE 1 END", normalised=False, signed=True),
    "dice": Measure("CASE WHEN sx + sy > 0 THEN 2 * sxy / (sx + sy) ELSE 0 END", "CASE WHEN sx + sy > 0 THEN 2 * (sxy / (greatest(mx, 1) * greatest(my, 1))) / (sx / greatest(mx, 1) + sy / greatest(my, 1)) ELSE 0 END"),
    "antidice": Measure("CASE WHEN sx + sy > 0 THEN sxy / (smin + 2 * (sx + sy - m1 - m2)) ELSE 0 END", "CASE WHEN a + b + c > 0 THEN (sxy / (greatest(mx, 1) * greatest(my, 1))) / (a + 2 * (b + c)) ELSE 0 END"),
    "tanimoto": Measure("CASE WHEN smax <= smin THEN 1 ELSE smin / (smax - smin) END", "CASE WHEN smax <= sxy THEN 1 ELSE sxy / (smax - sxy) END", normalised=False),
    "extsimpson": Measure("CASE WHEN least(sx, sy) = 0 THEN 0 ELSE smin / least(sx, sy) END"),
    "braun_blanquet": Measure("CASE WHEN greatest(sx, sy) = 0 THEN 0 ELSE smin / greatest(sx, sy) END"),
    "kulczynski1": Measure("CASE WHEN n1 + n2 = 2 * nb THEN 2 * (m1 + m2) ELSE (m1 + m2) / (sx + sy - m1 - m2) END"),
    "kulczynski2": Measure("CASE WHEN sx = 0 OR sy = 0 THEN 0 ELSE (m1 / sx + m2 / sy) / 2 END"),
    "ochiai": Measure(f"CASE WHEN sx = 0 OR sy = 0 THEN 0 ELSE {_HALF} / sqrt(sx * sy) END"),
    "sokalsneath": Measure(f"CASE WHEN sx + sy = 0 THEN 0 ELSE {_HALF} / ({_HALF} + 2 * (sx - m1) + 2 * (sy - m2)) END"),
    "mcconnaughey": Measure("CASE WHEN sx = 0 OR sy = 0 THEN 0.5 ELSE ((m1 * m2 - (sx - m1) * (sy - m2)) / (sx * sy) + 1) / 2 END"),
    "lancewilliams": Measure("CASE WHEN sx + sy = 0 THEN 0 ELSE 1 - ((sx - m1) + (sy - m2)) / (sx + sy) END"),
    "braycurtis": Measure("CASE WHEN sx + sy = 0 THEN 0 ELSE 1 - sabs / (sx + sy) END"),
    "canberra": Measure("1 - can / n"),
    "circleprod": Measure("smin / n"),
    "czekanowski": Measure("CASE WHEN sx + sy = 0 THEN 0 ELSE 2 * smin / (sx + sy) END"),
    "robinson": Measure("(2 - rob) / 2", normalised=False),
    "drennan": Measure("1 - 0.5 * rob", normalised=False),
    "similarityratio": Measure("CASE WHEN sxx + syy = sxy THEN 1.7976931348623157e308 ELSE sxy / (sxx + syy - sxy) END"),
    "jensenshannon": Measure("1 - 0.5 * js", normalised=False),
    "mountford": Measure("CASE WHEN 2 * b * c + a * b + a * c <= 0 THEN (CASE WHEN a > 0 THEN 1 ELSE 0 END) ELSE 2 * a / (2 * b * c + a * b + a * c) END", normalised=False),
    "fager_mcgowan": Measure("(CASE WHEN (a + b) * (a + c) = 0 THEN (CASE WHEN a > 0 THEN 1 ELSE 0 END) ELSE a / sqrt((a + b) * (a + c)) END) - greatest(b, c) / 2", normalised=False),
    "tripartite": Measure(_TRIPARTITE, normalised=False),
}
#: Sparse vectors aren't divided by their length for these, even when asked to.
SPARSE_NEVER_NORMALISED = ("cosine", "robinson", "drennan", "simpson", "mountford", "fager_mcgowan", "tripartite")
#: Measures by the number of letters that make a name unambiguous; "none" is always 0.
_NAMES = re.compile(r"\b(sxx|syy|sxy|sx|sy|smin|smax|sabs|sdd|n1|n2|nb|m1|m2|mx|my|can|rob|js|n|a|b|c)\b")


def measure_name(text: str) -> str:
    """The measure a name or unambiguous beginning stands for."""
    key = text.strip().lower().replace("-", "_")
    if key in MEASURES or key == "none":
        return key
    found = [m for m in MEASURES if m.startswith(key)]
    if len(found) != 1:
        raise ValueError(f"{text!r} is {'ambiguous' if found else 'not a measure'}")
    return found[0]


def needed(sql: str) -> list[str]:
    return sorted(set(_NAMES.findall(sql)))


def _sum(x: str, y: str, term: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (x, y) -> {term}), 0D, (s, t) -> s + t)"


def _dense_statistic(name: str, x: str, y: str) -> str:
    """SQL over array columns x and y."""
    total = lambda v: f"aggregate({v}, 0D, (s, t) -> s + t)"
    top = lambda v: f"array_max({v})"
    each = {
        "sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y", "smin": "least(x, y)", "smax": "greatest(x, y)", "sabs": "abs(x - y)", "sdd": "(x - y) * (x - y)",
        "n1": "if(x != 0, 1D, 0D)", "n2": "if(y != 0, 1D, 0D)", "nb": "if(x != 0 AND y != 0, 1D, 0D)", "m1": "if(x != 0 AND y != 0, x, 0D)", "m2": "if(x != 0 AND y != 0, y, 0D)",
        "can": "if(x + y > 0, abs(x - y) / (x + y), 0D)",
    }
    if name in each:
        return _sum(x, y, each[name])
    if name == "n":
        return f"cast(size({x}) AS double)"
    if name in ("mx", "my"):
        return top(x if name == "mx" else y)
    scaled = lambda v, by: f"transform({v}, t -> t / {by})"
    if name in ("rob", "js"):
        p, q = scaled(x, total(x)), scaled(y, total(y))
        kl = "if({0} > 0, {0} * log2({0} / ((x + y) / 2)), 0D)"
        return _sum(p, q, "abs(x - y)" if name == "rob" else f"{kl.format('x')} + {kl.format('y')}")
    one = lambda v: f"if({top(v)} = 0, 1D, {top(v)})"
    p, q = scaled(x, one(x)), scaled(y, one(y))
    return _sum(p, q, {"a": "if(x != 0 AND y != 0, least(x, y), 0D)", "b": "if(x != 0 AND y = 0, x, 0D)", "c": "if(x = 0 AND y != 0, y, 0D)"}[name])


def dense_similarity(df: DataFrame, measure: str, x: str, y: str, normalise: bool = True, out: str = "similarity") -> DataFrame:
    """``df`` with the similarity of two array<double> columns; empty vectors are alike (1), a missing one gives -1.

    Arrays are scaled once and each statistic is worked out once, in a projection of its own.
    """
    if measure == "none":
        return df.withColumn(out, F.lit(0.0))
    m = MEASURES[measure]
    x_, y_ = "__x", "__y"
    df = df.withColumns({x_: F.col(x), y_: F.col(y)})
    if normalise and m.normalised and measure != "cosine":
        df = df.withColumns({f"{v}l": F.expr(f"coalesce(nullif(sqrt(aggregate({v}, 0D, (s, t) -> s + t * t)), 0D), 1D)") for v in (x_, y_)})
        df = df.withColumns({v: F.expr(f"transform({v}, t -> t / {v}l)") for v in (x_, y_)})
    names = needed(m.dense)
    df = df.withColumns({f"__{k}": F.expr(_dense_statistic(k, x_, y_)) for k in names})
    sql = _NAMES.sub(lambda k: f"__{k[1]}", m.dense)
    df = df.withColumn(out, F.expr(f"CASE WHEN {x_} IS NULL OR {y_} IS NULL THEN -1D WHEN size({x_}) = 0 THEN 1D ELSE cast({sql} AS double) END"))
    return df.drop(x_, y_, f"{x_}l", f"{y_}l", *[f"__{k}" for k in names])


def vector_totals(tv: DataFrame, key: str, term: str = "term", weight: str = "weight") -> DataFrame:
    """(key, total, squares, top, n) of each sparse vector, kept beside long tables so that pairs need no outer join."""
    return tv.groupBy(key).agg(F.sum(weight).alias("total"), F.sum(F.col(weight) * F.col(weight)).alias("squares"), F.greatest(F.max(weight), F.lit(0.0)).alias("top"), F.count(F.when(F.col(weight) != 0, 1)).cast("double").alias("n"))


def sparse_statistics(pairs: DataFrame, left: DataFrame, right: DataFrame, term: str = "term", weight: str = "weight") -> DataFrame:
    """All statistics for each row of pairs (x, y): left and right hold (x or y, term, weight), weights not negative.

    Terms of one side only enter through the totals of each vector, so only terms that both sides have are joined.
    """
    lt, rt = vector_totals(left, "x", term, weight), vector_totals(right, "y", term, weight)
    lt = lt.select("x", *[F.col(c).alias(f"l_{c}") for c in ("total", "squares", "top", "n")])
    rt = rt.select("y", *[F.col(c).alias(f"r_{c}") for c in ("total", "squares", "top", "n")])
    p = pairs.join(lt, "x").join(rt, "y")
    lw = left.where(F.col(weight) != 0).select("x", F.col(term).alias("t"), F.col(weight).cast("double").alias("wx"))
    rw = right.where(F.col(weight) != 0).select("y", F.col(term).alias("t"), F.col(weight).cast("double").alias("wy"))
    shared = p.select("x", "y", "l_total", "r_total", "l_top", "r_top").join(lw, "x").join(rw, ["y", "t"])
    a = F.least(F.col("wx") / F.greatest("l_top", F.lit(1.0)), F.col("wy") / F.greatest("r_top", F.lit(1.0)))
    q1, q2 = F.col("wx") / F.col("l_total"), F.col("wy") / F.col("r_total")
    mid = (q1 + q2) / 2
    bx, by = F.col("wx") / F.greatest("l_top", F.lit(1.0)), F.col("wy") / F.greatest("r_top", F.lit(1.0))
    terms = {
        "sxy": F.col("wx") * F.col("wy"), "smin": F.least("wx", "wy"), "nb": F.lit(1.0), "m1": F.col("wx"), "m2": F.col("wy"), "a": a, "bx": bx, "cy": by,
        "can": F.abs(F.col("wx") - F.col("wy")) / (F.col("wx") + F.col("wy")), "rob": F.abs(q1 - q2), "js": q1 * F.log2(q1 / mid) + q2 * F.log2(q2 / mid),
    }
    met = shared.groupBy("x", "y").agg(*[F.sum(c).alias(f"_{k}") for k, c in terms.items()])
    return from_sums(p.join(met, ["x", "y"], "left").fillna(0.0, [f"_{k}" for k in terms]))


def from_sums(s: DataFrame) -> DataFrame:
    """All statistics from the totals of x (l_total, l_squares, l_top, l_n) and of y (r_...), and the sums over the terms of both (_sxy, _smin, ...)."""
    one_x, one_y = F.col("l_total") - F.col("_m1"), F.col("r_total") - F.col("_m2")
    share = lambda part, total: F.when(F.col(total) > 0, part / F.col(total)).otherwise(0.0)
    out = {
        "n": F.col("l_n") + F.col("r_n") - F.col("_nb"), "sx": F.col("l_total"), "sy": F.col("r_total"), "sxx": F.col("l_squares"), "syy": F.col("r_squares"), "sxy": F.col("_sxy"), "mx": F.col("l_top"), "my": F.col("r_top"),
        "n1": F.col("l_n"), "n2": F.col("r_n"), "nb": F.col("_nb"), "m1": F.col("_m1"), "m2": F.col("_m2"), "smin": F.col("_smin"), "smax": F.col("l_total") + F.col("r_total") - F.col("_smin"),
        "sabs": F.col("l_total") + F.col("r_total") - 2 * F.col("_smin"), "sdd": F.greatest(F.col("l_squares") + F.col("r_squares") - 2 * F.col("_sxy"), F.lit(0.0)),
        "can": F.col("_can") + (F.col("l_n") - F.col("_nb")) + (F.col("r_n") - F.col("_nb")), "rob": F.col("_rob") + share(one_x, "l_total") + share(one_y, "r_total"), "js": F.col("_js") + share(one_x, "l_total") + share(one_y, "r_total"),
        "a": F.col("_a"), "b": F.greatest(F.col("l_total") / F.greatest("l_top", F.lit(1.0)) - F.col("_bx"), F.lit(0.0)), "c": F.greatest(F.col("r_total") / F.greatest("r_top", F.lit(1.0)) - F.col("_cy"), F.lit(0.0)),
    }
    return s.select("x", "y", *[c.alias(k) for k, c in out.items()])


def sparse_similarity(measure: str, statistics: DataFrame) -> DataFrame:
    """(x, y, similarity). An empty y is like an empty x only."""
    if measure == "none":
        return statistics.select("x", "y", F.lit(0.0).alias("similarity"))
    return statistics.select("x", "y", F.expr(f"CASE WHEN n2 = 0 THEN (CASE WHEN n1 = 0 THEN 1D ELSE 0D END) ELSE cast({MEASURES[measure].sparse_sql} AS double) END").alias("similarity"))
