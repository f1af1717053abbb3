"""Frequencies of phrases that the corpus doesn't hold, from those of their pieces, and probabilities within word classes.

All pieces of all phrases asked for are counted in one pass over the corpus, and the few counts meet their phrases in one join; a table of pieces for each
phrase then gives the estimate, for all phrases of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import bounded, ensure_checkpoints, spread
from .ngrams import DISCOUNT, _W, _grams, counts_of, ngram_counts, smoothed, word_arrays

#: What an unseen word counts as where no mass is kept for unseen words.
UNSEEN = 0.01


def estimates(f, total: float, discount: float):
    """The estimates of phrases from f[row, i, j], the counts of their pieces from word i to word j.

    A piece that occurs counts as it does. Two words are taken as independent. Of longer pieces the longest known beginning and end are
    looked for; where they overlap, every overlap of one word gives two estimates (the beginning's count times the end's share, and the
    other way round); else the missing parts are estimated first. The mean is taken, and its square root where independent words
    would be expected more than once, as their absence then says that they avoid each other.
    """
    import numpy as np

    rows, n = f.shape[0], f.shape[1]
    ratio = 1.0 + discount
    raw = f.copy()
    word = f[:, np.arange(n), np.arange(n)]
    word = np.where(word > 0, word / ratio, discount if discount > 0 else UNSEEN)
    f = f.copy()
    f[:, np.arange(n), np.arange(n)] = word
    at = np.arange(rows)
    out = {}
    for a in range(n):
        out[a, a] = np.where(raw[:, a, a] > 0, raw[:, a, a], discount)

    def overlap(t, k):
        """(sum, number) of the two estimates with word k in both parts; t[row, i, j] of one piece."""
        m = t.shape[1]
        # A piece that would end before it begins has no count.
        share = np.where(k <= m - 2, t[at, k, m - 2], 0.0)
        first = np.where(share > 0, t[at, 0, k] * t[at, k, m - 1] / np.where(share > 0, share, 1.0), 0.0)
        begin, back = t[at, 0, k], np.where(k >= 1, t[at, min(1, m - 1), k], 0.0)
        second = np.where(begin > 0, t[at, k, m - 1] * back / np.where(begin > 0, begin, 1.0), 0.0)
        return first + second, (first > 0).astype(int) + (second > 0)

    for size in range(2, n + 1):
        for a in range(n - size + 1):
            b = a + size - 1
            t = f[:, a : b + 1, a : b + 1].copy()
            if size == 2:
                e = t[:, 0, 0] / total * t[:, 1, 1]
                e = np.where(e > 1, np.sqrt(e), e)
            else:
                spans = np.arange(size)
                i = np.where(t[:, 0, :] > 0, spans, 0).max(1)
                j = np.where(t[:, :, size - 1] > 0, spans, size).min(1)
                e, factors = np.zeros(rows), np.zeros(rows, int)
                meets = (i >= j) & (i > 0)
                for k in range(1, size - 1):
                    s, c = overlap(t, np.full(rows, k))
                    use = meets & (j <= k) & (k <= i)
                    e, factors = e + np.where(use, s, 0), factors + np.where(use, c, 0)
                # Without an overlap the rest of each part is estimated as a phrase of its own.
                for r in np.flatnonzero(~meets):
                    if i[r] > 0:
                        t[r, i[r], size - 1] = out[a + i[r], b][r]
                    if j[r] + 1 < size:
                        t[r, 0, j[r]] = out[a, a + j[r]][r]
                for k in (i, np.minimum(j, size - 1)):
                    s, c = overlap(t, k)
                    e, factors = e + np.where(meets, 0, s), factors + np.where(meets, 0, 2 * c)
                expected = t[:, 0, 0] / ratio * np.prod([t[:, k, k] / (total * ratio) for k in range(1, size)], axis=0)
                e = np.where(factors > 0, e / np.maximum(factors, 1), discount)
                e = np.where((factors > 0) & (expected > 1), np.sqrt(e), e)
            out[a, b] = np.where(raw[:, a, b] > 0, raw[:, a, b], e)
    return out[0, n - 1]


def estimate_frequency(arrays: DataFrame, asked: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """asked(w1 .. wn) with ``n``, how often the phrase occurs, and ``estimate``, which is that count or, for a phrase that doesn't occur, what its pieces suggest.

    ``arrays`` holds the records' words. An empty corpus gives every phrase the discount.
    """
    import pyarrow as pa

    discount = min(max(discount, 0.0), 0.9999999)
    keys = [f"w{k + 1}" for k in range(order)]
    spans = [(i, j) for i in range(order) for j in range(i, order)]
    pieces = asked.select(*keys).distinct().select(*keys, F.posexplode(F.array(*[F.array(*keys[i : j + 1]) for i, j in spans])).alias("piece", "gram"))
    counts = counts_of(arrays, pieces.select("gram"), list(range(1, order + 1)))
    met = pieces.join(counts, "gram", "left").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.coalesce("n", F.lit(0)).cast("double").alias("n")))), lambda x: x["n"]).alias("f"))
    total = arrays.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("double").alias("total"))
    whole = spans.index((0, order - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(order).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(spans))
            f = np.zeros((batch.num_rows, order, order))
            for k, (i, j) in enumerate(spans):
                f[:, i, j] = flat[:, k]
            found = estimates(f, max(batch.column(order + 1)[0].as_py(), 1.0), discount)
            yield pa.RecordBatch.from_arrays([*batch.columns[:order], pa.array(flat[:, whole].astype(np.int64)), pa.array(found)], names=[*keys, "n", "estimate"])

    # The total is one row.
    return met.join(F.broadcast(total), F.lit(True)).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n long, estimate double")


def class_probability(arrays: DataFrame, tok: DataFrame, classes: DataFrame | Callable[[Column], Column], asked: DataFrame, order: int, modes: list[str], discount: float = DISCOUNT) -> DataFrame:
    """asked(w1 .. wn), words, with the probability of the last word by the classes of all: a column for each mode.

    classes: (word, class), each word in one class, or a rule that gives the class of a word as a column; words that the table lacks, and with a rule those that the corpus lacks,
    are classes of their own. The corpus is read as classes, by a rule in place and by a table through a join of all words; the probability of the last class after
    those before is shared out evenly among the different words of the class that the corpus holds.
    """
    from .ngrams import rebuild

    ensure_checkpoints(arrays.sparkSession)
    keys = [f"w{k + 1}" for k in range(order)]
    # The words are counted once, for the total, the sizes of classes and what the corpus lacks.
    vocabulary = tok.groupBy("word").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    own = vocabulary.select("word", classes(F.col("word")).alias("class")) if callable(classes) else classes.select("word", "class").distinct()
    named = lambda df, word, own=own: df.join(own.withColumnRenamed("word", word), word, "left").withColumn("class", F.coalesce("class", F.col(word)))
    if callable(classes):
        read, rule = arrays, lambda word: F.coalesce(classes(word), word)
    else:
        read, rule = rebuild(named(tok, "word", bounded(own)).select("rec", "pos", F.col("class").alias("word"))), None
    words = asked.select(*keys).distinct()
    # Of the words with a class only those asked for meet the phrases.
    known = own.join(bounded(words.select(F.explode(F.array(*keys)).alias("word")).distinct()), "word").checkpoint()
    for k, key in enumerate(keys):
        words = named(words, key, known).withColumnRenamed("class", f"c{k + 1}")
    words = words.checkpoint()
    sizes = named(vocabulary, "word").groupBy(F.col("class").alias(f"c{order}")).agg(F.count(F.lit(1)).alias("size"))
    total = vocabulary.agg(F.sum("n").cast("double").alias("total"))
    ps = raw_probabilities(read, words.select(*[F.col(f"c{k + 1}").alias(f"w{k + 1}") for k in range(order)]), order, discount, total, rule)
    ps = ps.select(*[F.col(f"w{k + 1}").alias(f"c{k + 1}") for k in range(order)], "ps")
    met = words.join(ps, [f"c{k + 1}" for k in range(order)]).join(sizes, f"c{order}", "left")
    shared = [F.get("ps", F.lit(k)) / F.coalesce("size", F.lit(1)) for k in range(order)]
    return met.select(*keys, *[smoothed(shared, m, discount).alias(m) for m in modes])


def raw_probabilities(arrays: DataFrame, asked: DataFrame, order: int, discount: float = DISCOUNT, total: DataFrame | None = None, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """asked(w1 .. wn) with ``ps``: the raw probabilities of the last word after none, one, ... of the words before it (null: that history doesn't occur).

    total(total), one row, is the number of words where it is known already; ``rule`` is as in ``counts_of``.
    """
    keys = [f"w{k + 1}" for k in range(order)]
    out = asked.select(*keys).distinct()
    total = arrays.agg(F.sum(F.size("words")).cast("double").alias("total")) if total is None else total
    # For each length the gram and, beyond one word, its history.
    wanted = [(n, h, keys[order - n : order - h]) for n in range(1, order + 1) for h in (0, 1) if n > h]
    pieces = out.select(*keys, F.posexplode(F.array(*[F.array(*own) for _, _, own in wanted])).alias("k", "gram"))
    counts = counts_of(arrays, pieces.select("gram"), list(range(1, order + 1)), rule=rule)
    met = pieces.join(counts, "gram", "left").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).cast("double")))).alias("c"))
    at = {(n, h): F.col("c")[k] for k, (n, h, _) in enumerate(wanted)}
    mass = F.col("total") * (1.0 + discount)
    ps = [F.when(at[1, 0] > 0, at[1, 0] / mass).otherwise(F.lit(discount))] + [F.when(at[n, 1] > 0, at[n, 0] / at[n, 1]) for n in range(2, order + 1)]
    return met.join(F.broadcast(total), F.lit(True)).select(*keys, F.array(*ps).alias("ps"))


def _phrases(spark, sf_dir, n):
    return ngram_counts(word_arrays(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), n).drop("n")


def q_estimate(spark, sf_dir):
    """All runs of four words of the benchmark, most of which the corpus lacks."""
    found = estimate_frequency(word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet")), _phrases(spark, sf_dir, 4), 4)
    return found.select("w1", "w2", "w3", "w4", "n", F.round("estimate", 8).alias("estimate"))


def q_classes(spark, sf_dir):
    """Trigrams of the benchmark by classes: words of the same first two letters and length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrays = spread(docs.select("text")).select(F.monotonically_increasing_id().alias("rec"), F.expr(r"regexp_extract_all(lower(text), '([\\p{L}]+)', 1)").alias("words"))
    tok = arrays.select("rec", F.posexplode("words").alias("pos", "word"))
    classes = lambda word: F.concat(F.lit("#"), F.substring(word, 1, 2), F.length(word))
    found = class_probability(arrays, tok, classes, _phrases(spark, sf_dir, 3), 3, ["backoff", "mean"])
    return found.select("w1", "w2", "w3", F.round("backoff", 10).alias("backoff"), F.round("mean", 10).alias("mean"))


def _estimate_sql(n: int) -> str:
    """Every piece from the shorter ones, each in a step of its own: known count f, estimate e, by first and last word."""
    d, r = DISCOUNT, 1.0 + DISCOUNT
    steps, cols = [], "a.*"
    for size in range(2, n + 1):
        made = []
        for a in range(n - size + 1):
            b, m = a + size - 1, size
            f = lambda i, j, a=a: f"g{a + i}{a + j}"
            if size == 2:
                p = f"({f(0, 0)} / t * {f(1, 1)})"
                e = f"CASE WHEN {p} > 1 THEN sqrt({p}) ELSE {p} END"
            else:

                def two(k, first, last, f=f, m=m):
                    """[sum, number] with word k in both parts; first: count of the beginning up to k, last: of the end from k."""
                    one = f"CASE WHEN {f(k, m - 2)} > 0 THEN {first} * {last} / {f(k, m - 2)} ELSE 0 END" if k <= m - 2 else "0"
                    other = f"CASE WHEN {first} > 0 THEN {last} * {f(1, k)} / {first} ELSE 0 END" if k >= 1 else "0"
                    return [one, other]

                cases = []
                for i in range(m - 1):
                    for j in range(1, m):
                        when = [f"{f(0, i)} > 0"] + [f"{f(0, x)} = 0" for x in range(i + 1, m)] + [f"{f(j, m - 1)} > 0"] + [f"{f(x, m - 1)} = 0" for x in range(1, j)]
                        if i >= j:
                            parts, weight = [p for k in range(j, i + 1) for p in two(k, f(0, k), f(k, m - 1))], 1
                        else:
                            first_i = f(0, i) if i != j else f"e{a}{a + j}"
                            parts = two(i, first_i, f"e{a + i}{b}" if i else f(0, m - 1)) + two(j, f"e{a}{a + j}" if j < m - 1 else f(0, m - 1), f(j, m - 1))
                            weight = 2
                        total, number = " + ".join(parts), f"({weight} * (" + " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in parts) + "))"
                        expected = f"{f(0, 0)} / {r} * " + " * ".join(f"({f(k, k)} / (t * {r}))" for k in range(1, m))
                        mean = f"(({total}) / nullif({number}, 0))"
                        cases.append(f"WHEN {' AND '.join(when)} THEN CASE WHEN {number} = 0 THEN {d} WHEN {expected} > 1 THEN sqrt({mean}) ELSE {mean} END")
                e = f"CASE {' '.join(cases)} END"
            made.append(f"(CASE WHEN {f(0, size - 1)} > 0 THEN {f(0, size - 1)} ELSE {e} END)::DOUBLE AS e{a}{b}")
        steps.append(f"s{size} AS MATERIALIZED (SELECT *, {', '.join(made)} FROM s{size - 1})")
    spans = [(i, j) for i in range(n) for j in range(i, n)]
    joins = " ".join(f"LEFT JOIN c{j - i + 1} x{i}{j} ON " + " AND ".join(f"x{i}{j}.w{k + 1} = a.w{i + k + 1}" for k in range(j - i + 1)) for i, j in spans)
    word = lambda x: f"CASE WHEN {x} > 0 THEN {x} / {r} ELSE {d} END"
    given = ", ".join((word(f"coalesce(x{i}{j}.c, 0)") if i == j else f"coalesce(x{i}{j}.c, 0)") + f"::DOUBLE AS g{i}{j}" for i, j in spans) + "".join(f", (CASE WHEN x{i}{i}.c > 0 THEN x{i}{i}.c ELSE {d} END)::DOUBLE AS e{i}{i}" for i in range(n))
    counts = ", ".join(f"c{k} AS (SELECT {', '.join(f'w{x + 1}' for x in range(k))}, count(*) AS c FROM {_grams('d', k)} GROUP BY ALL)" for k in range(1, n + 1))
    return f"WITH {_W}, a AS (SELECT DISTINCT * FROM {_grams('q', n)}), {counts}, s1 AS MATERIALIZED (SELECT {cols}, {given}, (SELECT sum(len(w))::DOUBLE FROM d) AS t FROM a {joins}), {', '.join(steps)} SELECT {', '.join(f'w{k + 1}' for k in range(n))}, g0{n - 1}::BIGINT AS n, round(e0{n - 1}, 8) AS estimate FROM s{n}"


def _class_sql() -> str:
    d, r = DISCOUNT, 1.0 + DISCOUNT
    k = lambda w: f"CASE WHEN {w} IN (SELECT word FROM v) THEN '#' || substr({w}, 1, 2) || length({w}) ELSE {w} END"
    return f"""
WITH {_W}, v AS (SELECT DISTINCT unnest(w) AS word FROM d), z AS (SELECT '#' || substr(word, 1, 2) || length(word) AS k, count(*) AS size FROM v GROUP BY 1), n AS (SELECT sum(len(w))::DOUBLE AS t FROM d),
a AS (SELECT *, {k('w1')} AS k1, {k('w2')} AS k2, {k('w3')} AS k3 FROM (SELECT DISTINCT * FROM {_grams('q', 3)})),
x AS (SELECT r, i, '#' || substr(w, 1, 2) || length(w) AS k FROM (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS r, w FROM d))),
t AS MATERIALIZED (SELECT k AS k1, lead(k, 1) OVER o AS k2, lead(k, 2) OVER o AS k3 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT k1, count(*) AS c FROM t GROUP BY 1), c2 AS (SELECT k1, k2, count(*) AS c FROM t WHERE k2 IS NOT NULL GROUP BY ALL), c3 AS (SELECT k1, k2, k3, count(*) AS c FROM t WHERE k3 IS NOT NULL GROUP BY ALL),
p AS (SELECT a.*, (CASE WHEN u.c > 0 THEN u.c / (t * {r}) ELSE {d} END) / coalesce(size, 1) AS p1, coalesce(b.c / hb.c, 0) / coalesce(size, 1) AS p2, coalesce(g.c / hg.c, 0) / coalesce(size, 1) AS p3
  FROM a LEFT JOIN z ON z.k = a.k3 LEFT JOIN c1 u ON u.k1 = a.k3 LEFT JOIN c2 b ON b.k1 = a.k2 AND b.k2 = a.k3 LEFT JOIN c1 hb ON hb.k1 = a.k2
  LEFT JOIN c3 g ON g.k1 = a.k1 AND g.k2 = a.k2 AND g.k3 = a.k3 LEFT JOIN c2 hg ON hg.k1 = a.k1 AND hg.k2 = a.k2, n)
SELECT w1, w2, w3, round((CASE WHEN p3 > 0 THEN p3 / {r} WHEN p2 > 0 THEN p2 / {r} WHEN p1 > 0 THEN p1 / {r} ELSE {d} END)::DOUBLE, 10) AS backoff,
  round(((CASE WHEN p1 = 0 THEN 0 WHEN p2 = 0 THEN p1 WHEN p3 = 0 THEN p1 + p2 ELSE p1 + p2 + p3 END) / 3.0)::DOUBLE, 10) AS mean FROM p
"""


QUERIES = {"freq_estimate": q_estimate, "lm_classes": q_classes}
SQL = {"freq_estimate": _estimate_sql(4), "lm_classes": _class_sql()}
