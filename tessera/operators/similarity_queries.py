"""Similarity queries: every embedding against the centroid of its label, every document against that of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES, dense_similarity, from_sums, needed, sparse_similarity
from ..plans.session import ensure_checkpoints, ship, spread
from .term_vectors import TERMS_SQL

#: Bytes of text in a chunk, which a task holds as a whole, and groups whose totals may be broadcast.
CHUNK, FEW_GROUPS = 1 << 24, 200_000
LEFT, RIGHT = [f"l_{k}" for k in ("total", "squares", "top", "n")], [f"r_{k}" for k in ("total", "squares", "top", "n")]
SUMS = ["_sxy", "_smin", "_nb", "_m1", "_m2", "_a", "_bx", "_cy", "_can", "_rob", "_js"]


def label_pairs(spark, sf_dir: str, signed: bool) -> DataFrame:
    """(vec_id, x, y): y is the sum of the vectors of the row's label; negative components count by size unless ``signed``."""
    value = (lambda v: v.cast("double")) if signed else (lambda v: F.abs(v.cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", value).alias("x"))
    parts = rows.select("label", F.posexplode("x").alias("i", "w")).groupBy("label", "i").agg(F.sum("w").alias("w"))
    centroids = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("c")).select("label", F.transform("c", lambda s: s["w"]).alias("y"))
    return rows.join(centroids, "label").select("vec_id", "x", "y")


def dense_query(measure: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = label_pairs(spark, sf_dir, MEASURES[measure].signed)
        return dense_similarity(pairs, measure, "x", "y").select("vec_id", F.round("similarity", 6).alias("similarity"))

    return run


def dense_sql(measure: str) -> str:
    m = MEASURES[measure]
    x = "e.w" if m.signed else "abs(e.w)"
    scale = "x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 0), 1) AS x, y / coalesce(nullif(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 0), 1) AS y" if m.normalised and measure != "cosine" else "x, y"
    top_x, top_y = "coalesce(nullif(max(x) OVER (PARTITION BY vec_id), 0), 1)", "coalesce(nullif(max(y) OVER (PARTITION BY vec_id), 0), 1)"
    kl = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0 END"
    s = {
        "n": "count(*)", "sx": "sum(x)", "sy": "sum(y)", "sxx": "sum(x * x)", "syy": "sum(y * y)", "sxy": "sum(x * y)", "smin": "sum(least(x, y))", "smax": "sum(greatest(x, y))", "sabs": "sum(abs(x - y))", "sdd": "sum((x - y) * (x - y))",
        "n1": "count(*) FILTER (WHERE x <> 0)", "n2": "count(*) FILTER (WHERE y <> 0)", "nb": "count(*) FILTER (WHERE x <> 0 AND y <> 0)", "m1": "coalesce(sum(x) FILTER (WHERE x <> 0 AND y <> 0), 0)", "m2": "coalesce(sum(y) FILTER (WHERE x <> 0 AND y <> 0), 0)",
        "mx": "max(x)", "my": "max(y)", "can": "coalesce(sum(abs(x - y) / (x + y)) FILTER (WHERE x + y > 0), 0)", "rob": "sum(abs(p - q))", "js": f"sum({kl.format('p')} + {kl.format('q')})",
        "a": "coalesce(sum(least(u, v)) FILTER (WHERE x <> 0 AND y <> 0), 0)", "b": "coalesce(sum(u) FILTER (WHERE y = 0), 0)", "c": "coalesce(sum(v) FILTER (WHERE x = 0), 0)",
    }
    stats = ", ".join(f"({s[k]})::DOUBLE AS {k}" for k in needed(m.dense))
    return f"""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS i FROM embeddings),
k AS (SELECT label, i, sum({x.replace('e.', '')}) AS y FROM e GROUP BY label, i),
p AS (SELECT vec_id, {x} AS x, y FROM e JOIN k USING (label, i)),
z AS (SELECT vec_id, {scale} FROM p),
w AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p, y / sum(y) OVER (PARTITION BY vec_id) AS q, x / {top_x} AS u, y / {top_y} AS v FROM z),
s AS (SELECT vec_id, {stats} FROM w GROUP BY vec_id)
SELECT vec_id, round(({m.dense})::DOUBLE, 6) AS similarity FROM s
"""


def chunked(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts(x, y, text) as (part, sub, x, y, words), and the number of groups y: the words joined by spaces, in chunks of about ``CHUNK`` bytes; rows of one x and y are in one chunk, and rows without words are left out.

    A chunk is a share of one large group y, dealt out by x, or several small groups.
    """
    texts = spread(texts)
    ensure_checkpoints(texts.sparkSession)
    sizes = texts.groupBy("y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).checkpoint()
    total, groups = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    bins = max(2 * total // CHUNK, texts.sparkSession.sparkContext.defaultParallelism)
    # Groups beyond a chunk's size are no more than chunks.
    large = sizes.where(F.col("bytes") > CHUNK).select("y", F.ceil(F.col("bytes") / CHUNK).alias("subs"))
    dealt = texts.join(F.broadcast(large), "y", "left").select(
        F.when(F.col("subs").isNull(), F.pmod(F.xxhash64("y"), F.lit(bins))).otherwise(F.xxhash64("y")).alias("part"), F.when(F.col("subs").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("x"), F.col("subs"))).cast("long").alias("sub"),
        "x", "y", F.expr(r"trim(regexp_replace(lower(text), '[^\\p{L}]+', ' '))").alias("words"),
    )
    return dealt.where("words <> ''").repartition("part", "sub"), groups


def group_statistics(texts: DataFrame) -> DataFrame:
    """All statistics of the words of each x in texts(x, y, text) with the summed vector of all texts of its group y; rows without x or y are left out.

    Texts are shuffled once, into chunks of one group each where it is large. Beyond that a chunk sends each of its different words once and gets the group's sum for it back,
    so what travels grows with the words that are new to a chunk, and no word of a document is joined outside its chunk.
    """
    ship(texts.sparkSession)
    chunks, groups = chunked(texts.where("x IS NOT NULL AND y IS NOT NULL"))
    kinds = dict(texts.dtypes)
    # Both passes take the chunks with all their columns, so that one shuffle serves both.
    own = chunks.groupBy("part", "sub").applyInArrow(chunk_counts, f"part long, sub long, y {kinds['y']}, term string, n double")
    along = Window.partitionBy("y", "term").orderBy("part", "sub")
    sums = own.withColumns({"wy": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_at": F.row_number().over(along)}).drop("n")
    totals = sums.where("_at = 1").groupBy("y").agg(F.sum("wy").alias("r_total"), F.sum(F.col("wy") * F.col("wy")).alias("r_squares"), F.max("wy").alias("r_top"), F.count(F.lit(1)).cast("double").alias("r_n"))
    right = sums.drop("_at").join(F.broadcast(totals) if groups <= FEW_GROUPS else totals, "y").select(F.col("part").alias("_part"), F.col("sub").alias("_sub"), F.col("y").alias("group"), "term", "wy", *RIGHT)
    names = [*LEFT, *RIGHT, *SUMS]
    found = chunks.groupBy("part", "sub").cogroup(right.groupBy("_part", "_sub")).applyInArrow(chunk_sums, f"x {kinds['x']}, y {kinds['y']}, " + ", ".join(f"{k} double" for k in names))
    return from_sums(found)


def codes(*columns):
    """Arrow columns as numbers, equal values having one number in all of them, and the different values."""
    import numpy as np
    import pyarrow as pa

    coded = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    return np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary


def words_of(docs):
    """The words of docs(words), as one column, and how many each row has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.split_pattern(docs["words"], " ")
    return pa.chunked_array([c.flatten() for c in words.chunks], docs["words"].type), pc.list_value_length(words).to_numpy()


def chunk_counts(docs):
    """(part, sub, y, term, n) of a chunk docs(part, sub, x, y, words)."""
    import numpy as np
    import pyarrow as pa

    flat, sizes = words_of(docs)
    ((term,), terms), ((group,), groups) = codes(flat), codes(docs["y"])
    keys, n = np.unique(np.repeat(group, sizes) * len(terms) + term, return_counts=True)
    one = lambda name: pa.array(np.full(len(keys), docs[name][0].as_py()))
    return pa.table({"part": one("part"), "sub": one("sub"), "y": groups.take(pa.array(keys // len(terms))), "term": terms.take(pa.array(keys % len(terms))), "n": n.astype(float)})


def chunk_sums(docs, right):
    """(x, y, *LEFT, *RIGHT, *SUMS) of a chunk: docs(x, y, words) and right(group, term, wy, *RIGHT), which has every term of every group in docs."""
    import numpy as np
    import pyarrow as pa

    flat, sizes = words_of(docs)
    (term, term_r), terms = codes(flat, right["term"])
    (group, group_r), groups = codes(docs["y"], right["group"])
    ((row_x,), _) = codes(docs["x"])
    # Rows of one x and y are one document.
    n_terms, n_groups = len(terms), len(groups)
    pairs, first, doc = np.unique(row_x * n_groups + group, return_index=True, return_inverse=True)
    group, n = group[first], len(pairs)
    counted = np.repeat(doc, sizes) * n_terms + term
    counted, wx = np.unique(counted, return_counts=True)
    d, t, wx = counted // n_terms, counted % n_terms, wx.astype(float)
    keys = group_r * n_terms + term_r
    order = np.argsort(keys)
    wy = right["wy"].to_numpy()[order[np.searchsorted(keys, group[d] * n_terms + t, sorter=order)]]
    begins = np.searchsorted(d, np.arange(n))
    left = {"l_total": np.add.reduceat(wx, begins), "l_squares": np.add.reduceat(wx * wx, begins), "l_top": np.maximum.reduceat(wx, begins), "l_n": np.bincount(d, minlength=n).astype(float)}
    r = np.zeros((n_groups, len(RIGHT)))
    for k, name in enumerate(RIGHT):
        r[group_r, k] = right[name].to_numpy()
    r = dict(zip(RIGHT, r[group].T, strict=True))
    bx, by, q1, q2 = wx / left["l_top"][d], wy / r["r_top"][d], wx / left["l_total"][d], wy / r["r_total"][d]
    mid = (q1 + q2) / 2
    each = {
        "_sxy": wx * wy, "_smin": np.minimum(wx, wy), "_nb": np.ones(len(wx)), "_m1": wx, "_m2": wy, "_a": np.minimum(bx, by), "_bx": bx, "_cy": by,
        "_can": np.abs(wx - wy) / (wx + wy), "_rob": np.abs(q1 - q2), "_js": q1 * np.log2(q1 / mid) + q2 * np.log2(q2 / mid),
    }
    out = {"x": docs["x"].take(pa.array(first)), "y": docs["y"].take(pa.array(first))} | left | r | {k: np.add.reduceat(each[k], begins) for k in SUMS}
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in out.items()})


def sparse_statistics_of(spark, sf_dir: str) -> DataFrame:
    """Statistics of each document's term frequencies with the summed vector of its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_statistics(docs.select(F.col("doc_id").alias("x"), F.col("source").alias("y"), "text"))


def sparse_query(measure: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return sparse_similarity(measure, sparse_statistics_of(spark, sf_dir)).select(F.col("x").alias("doc_id"), F.round("similarity", 6).alias("similarity"))

    return run


def sparse_sql(measure: str) -> str:
    m = MEASURES[measure]
    kl = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0 END"
    s = {
        "n": "count(*)", "sx": "sum(x)", "sy": "sum(y)", "sxx": "sum(x * x)", "syy": "sum(y * y)", "sxy": "sum(x * y)", "smin": "sum(least(x, y))", "smax": "sum(greatest(x, y))", "sabs": "sum(abs(x - y))", "sdd": "sum((x - y) * (x - y))",
        "n1": "count(*) FILTER (WHERE x <> 0)", "n2": "count(*) FILTER (WHERE y <> 0)", "nb": "count(*) FILTER (WHERE x <> 0 AND y <> 0)", "m1": "coalesce(sum(x) FILTER (WHERE x <> 0 AND y <> 0), 0)", "m2": "coalesce(sum(y) FILTER (WHERE x <> 0 AND y <> 0), 0)",
        "mx": "max(x)", "my": "max(y)", "can": "sum(abs(x - y) / (x + y))", "rob": "sum(abs(p - q))", "js": f"sum({kl.format('p')} + {kl.format('q')})",
        "a": "coalesce(sum(least(x / greatest(tx, 1), y / greatest(ty, 1))) FILTER (WHERE x <> 0 AND y <> 0), 0)", "b": "coalesce(sum(x / greatest(tx, 1)) FILTER (WHERE y = 0), 0)", "c": "coalesce(sum(y / greatest(ty, 1)) FILTER (WHERE x = 0), 0)",
    }
    stats = ", ".join(f"({s[k]})::DOUBLE AS {k}" for k in needed(m.sparse_sql))
    return f"""
WITH {TERMS_SQL},
tv AS (SELECT doc_id, source, term, count(*)::DOUBLE AS w FROM words WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
k AS (SELECT source, term, sum(w) AS y FROM tv GROUP BY ALL),
ids AS (SELECT DISTINCT doc_id, source FROM tv),
o AS (SELECT ids.doc_id, coalesce(tv.w, 0) AS x, k.y FROM ids JOIN k USING (source) LEFT JOIN tv ON tv.doc_id = ids.doc_id AND tv.term = k.term),
t AS (SELECT doc_id, sum(x) AS sx, sum(y) AS sy, max(x) AS tx, max(y) AS ty FROM o GROUP BY doc_id),
w AS (SELECT o.doc_id, x, y, x / sx AS p, y / sy AS q, tx, ty FROM o JOIN t USING (doc_id)),
s AS (SELECT doc_id, {stats} FROM w GROUP BY doc_id)
SELECT doc_id, round(({m.sparse_sql})::DOUBLE, 6) AS similarity FROM s
"""


QUERIES = {f"sim_dense_{m}": dense_query(m) for m in MEASURES} | {f"sim_sparse_{m}": sparse_query(m) for m in MEASURES}
SQL = {f"sim_dense_{m}": dense_sql(m) for m in MEASURES} | {f"sim_sparse_{m}": sparse_sql(m) for m in MEASURES}
