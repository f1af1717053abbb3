"""N-grams within records: counts, phrase and gap search, and a language model with the usual smoothing modes.

A record is an array of words, so n-grams are slices of it: they need no sort and no window, and counting them is one
aggregation with map-side combine. Searches take the phrases asked for as a table and meet the n-grams in an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import bounded, spread

#: Factor of the stupid back-off for each order given up.
ALPHA = 0.4
#: Bits, as a power of two, of the table by which places of rare n-grams are left out before a shuffle; it goes to all tasks, 64 in a row.
TABLE_BITS = 26
#: Mass kept for unseen words in the queries below.
DISCOUNT = 0.1
#: A word and the pair after it that the query of restricted matches looks for.
CONTEXT = ["to", "thanedble", "the"]
SMOOTHING = ("none", "backoff", "stupid_backoff", "max", "mean", "wtmean", "quadmean", "cubemean", "expmean", "simpkn")


def word_arrays(records: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep..., words): the runs of letters of each record, lower-cased."""
    records = spread(records.select(*(keep or []), text_col))
    return records.select(*(keep or []), F.expr(rf"regexp_extract_all(lower(`{text_col}`), '([\\p{{L}}]+)', 1)").alias("words"))


def positions(records: DataFrame, rec: str, text_col: str = "text") -> DataFrame:
    """tok(rec, pos, word): the positional form of the records."""
    return word_arrays(records, text_col, [rec]).select(F.col(rec).alias("rec"), F.posexplode("words").alias("pos", "word"))


def rebuild(tok: DataFrame) -> DataFrame:
    """(rec, words) back from tok(rec, pos, word)."""
    return tok.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))


def vocabulary(tok: DataFrame) -> DataFrame:
    """(word, id): ids from 1 in order of the words; 0 stands for unknown ones. Ids need a total order, so the distinct words are ranked range by range."""
    words = tok.select("word").distinct().withColumn("part", F.substring("word", 1, 2))
    sizes = words.groupBy("part").count()
    starts = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return words.join(starts, "part").select("word", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("word"))).alias("id"))


def ngrams(words: Column, n: int, gap: int = 0) -> Column:
    """Array of all n-grams (arrays of n words); with a gap, pairs of a word and the word ``gap`` words after the next."""
    step = gap + 1 if n == 2 else 1
    last = F.size(words) - (n - 1) * step
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array(*[F.element_at(words, i + k * step) for k in range(n)]))).otherwise(F.array().cast("array<array<string>>"))


def ngram_counts(arrays: DataFrame, n: int, least: int = 1, gap: int = 0) -> DataFrame:
    """(w1 .. wn, n): n-grams that occur at least ``least`` times."""
    each = arrays.select(F.explode(ngrams(F.col("words"), n, gap)).alias("g"))
    counted = each.groupBy(*[F.col("g")[k].alias(f"w{k + 1}") for k in range(n)]).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least) if least > 1 else counted


def counts_of(arrays: DataFrame, asked: DataFrame, orders: list[int], gap: int = 0, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """(gram, n): how often each of asked(gram), arrays of words of the given orders, occurs; with ``rule`` the corpus is read as what it makes of each word.

    All orders are made in one pass, and what isn't asked for is dropped before anything is shuffled: by a broadcast where the
    grams asked have been counted to be few, by a plain join otherwise. Words are zipped with those that follow, without functions over arrays, and grams meet as
    numbers of 96 bits (two hashes of their length and words), so that none are copied. Words aren't null, and what is asked with a null isn't found.
    """
    code = lambda *of: [F.xxhash64(*of), F.hash(*of)]
    places = {n: [k * (gap + 1 if n == 2 else 1) for k in range(n)] for n in orders}
    shifts = sorted({s for own in places.values() for s in own})
    zipped = arrays.select(*[F.slice("words", s + 1, F.size("words")).alias(f"_{s}") if s else F.col("words").alias("_0") for s in shifts]).select(F.inline(F.arrays_zip(*[f"_{s}" for s in shifts])))
    if rule is not None:
        zipped = zipped.select(*[rule(F.col(f"_{s}")).alias(f"_{s}") for s in shifts])
    made = [F.when(F.col(f"_{own[-1]}").isNotNull(), c) for n, own in places.items() for c in code(F.lit(n), *[f"_{s}" for s in own])]
    each = zipped.select(F.stack(F.lit(len(orders)), *made).alias("_a", "_b")).where("_a IS NOT NULL")
    known = asked.select("gram").distinct().where(~F.exists("gram", lambda w: w.isNull()))
    known = known.select("gram", *[c.alias(name) for c, name in zip(code(F.size("gram"), "gram"), ("_a", "_b"), strict=True)])
    met = each.join(bounded(known.select("_a", "_b")), ["_a", "_b"]).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    return known.join(met, ["_a", "_b"]).select("gram", "n")


def phrase_frequency(arrays: DataFrame, phrases: DataFrame, n: int, gap: int = 0) -> DataFrame:
    """phrases(w1 .. wn) with the number of their occurrences."""
    keys = [f"w{k + 1}" for k in range(n)]
    asked = phrases.distinct().withColumn("gram", F.array(*keys))
    return asked.join(counts_of(arrays, asked, [n], gap), "gram", "left").fillna(0, ["n"]).select(*keys, "n")


def phrase_locations(tok: DataFrame, phrase: list[str], gaps: list[int] | None = None) -> DataFrame:
    """(rec, start, end) of every occurrence of a phrase; gaps[k] words may stand between words k and k + 1."""
    out, at = tok.where(F.col("word") == phrase[0]).select("rec", F.col("pos").alias("start"), F.col("pos").alias("end")), 0
    for k, word in enumerate(phrase[1:]):
        step = 1 + (gaps[k] if gaps else 0)
        following = tok.where(F.col("word") == word).select("rec", (F.col("pos") - step).alias("end"))
        out = out.join(following, ["rec", "end"]).withColumn("end", F.col("end") + step)
    return out


def preceded_by(found: DataFrame, tok: DataFrame, words: list[str]) -> DataFrame:
    """Of matches (rec, start, end), those with one of ``words`` right before them in the record."""
    before = tok.where(F.col("word").isin(words)).select("rec", (F.col("pos") + 1).alias("start"))
    return found.join(before, ["rec", "start"], "left_semi").select(*found.columns)


def successors(arrays: DataFrame, n: int) -> DataFrame:
    """(w1, w2, n): how often w2 is the ``n``-th word after w1 in a record."""
    return ngram_counts(arrays, 2, gap=n - 1)


def class_sizes(tok: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, words, n): different words of each class, and their occurrences; words that ``classes`` (word, class) lacks are in none.

    Occurrences are counted by word before classes are joined, so a class that holds most words is summed from partial counts.
    """
    counts = tok.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(classes.select("word", "class").distinct(), "word").groupBy("class").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


def longest_match(arrays: DataFrame, key: list[str]) -> DataFrame:
    """(length, n): the longest beginning of ``key`` that occurs, and how often; one row, length 0 if none does."""
    found = None
    for n in range(1, len(key) + 1):
        hit = F.exists(ngrams(F.col("words"), n), lambda g: g == F.array(*map(F.lit, key[:n])))
        count = F.when(hit, F.size(F.filter(ngrams(F.col("words"), n), lambda g: g == F.array(*map(F.lit, key[:n]))))).otherwise(0)
        found = [*(found or []), F.sum(count).alias(f"n{n}")]
    totals = arrays.agg(*found)
    best = F.lit(0)
    for n in range(1, len(key) + 1):
        best = F.when(F.col(f"n{n}") > 0, F.lit(n)).otherwise(best)
    return totals.select(best.alias("length"), F.coalesce(F.element_at(F.array(F.lit(0), *[F.col(f"n{n}") for n in range(1, len(key) + 1)]), best + 1), F.lit(0)).alias("n"))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """(key, start, end) with overlapping and adjoining ranges merged (gaps and islands)."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    marked = marked.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def frequent_places(arrays: DataFrame, key: str, n: int, least: int) -> DataFrame:
    """(key, start) of every n-gram of arrays(key, words) that occurs at least ``least`` times in all.

    N-grams meet as numbers of 96 bits (two hashes), so no strings are shuffled: a billion different ones have two alike with chance below 1e-11.
    """
    last = F.size("words") - n + 1
    of = lambda i: [F.element_at("words", i + k) for k in range(n)]
    coded = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(*of(i)).alias("a"), F.hash(*of(i)).alias("b"))))
    at = arrays.select(key, F.posexplode(coded).alias("start", "_g")).select(key, "start", F.col("_g.a").alias("_a"), F.col("_g.b").alias("_b"))
    # First by 40 bits, which are the least to shuffle: what shares them less often is out, and places that share no bit with the rest never leave their task.
    slots = at.groupBy((F.col("_a").bitwiseAND((1 << 40) - 1)).alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 AS int))")
    row = lambda c: F.shiftright(F.col(c), 6).bitwiseAND((1 << TABLE_BITS - 6) - 1)
    table = slots.groupBy(row("_slot").alias("_row")).agg(F.bit_or(bit("_slot")).alias("_bits"))
    at = at.withColumn("_row", row("_a")).join(F.broadcast(table), "_row").where(F.col("_bits").bitwiseAND(bit("_a")) != 0).select(key, "start", "_a", "_b")
    common = at.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_a", "_b")
    return at.join(common.hint("shuffle_hash"), ["_a", "_b"]).select(key, "start")


def smoothed(ps: list[Column], mode: str, discount: float, alpha: float = ALPHA) -> Column:
    """The probability from raw ones of order 1..n (nulls are 0)."""
    ratio = F.lit(1.0 + discount)
    ps = [F.coalesce(p, F.lit(0.0)) for p in ps]
    if mode == "none":
        return ps[-1] / ratio
    if mode in ("backoff", "stupid_backoff"):
        out = F.lit(discount)
        for p in ps:
            shorter = F.lit(alpha) * out if mode == "stupid_backoff" else out
            out = F.when(p > 0, p / ratio).otherwise(shorter)
        return out
    if mode == "max":
        best, alive = F.lit(0.0), F.lit(True)
        for p in ps:
            alive = alive & (p > 0)
            best = F.when(alive, F.greatest(best, p)).otherwise(best)
        return F.when(best > 0, best / ratio).otherwise(F.lit(discount))
    weight = {"mean": lambda k: 1.0, "wtmean": float, "quadmean": lambda k: float(k * k), "cubemean": lambda k: float(k**3), "simpkn": lambda k: float(k**3), "expmean": lambda k: 2.0**k}[mode]
    total, alive = F.lit(0.0), F.lit(True)
    for k, p in enumerate(ps, 1):
        alive = alive & (p > 0)
        total = total + F.when(alive, p * weight(k)).otherwise(0.0)
    return total / sum(weight(k) for k in range(1, len(ps) + 1))


def parse_smoothing(name: str) -> tuple[str, float]:
    """Mode and alpha from a name such as ``STUPID_BACKOFF-0.3``."""
    key, _, value = name.strip().lower().partition("-")
    key = key.replace(" ", "_")
    if key not in SMOOTHING:
        raise ValueError(f"{name!r} is not a smoothing mode")
    return key, float(value) if value else ALPHA


def conditional_probability(arrays: DataFrame, asked: DataFrame, order: int, modes: list[str], discount: float = DISCOUNT, alpha: float = ALPHA) -> DataFrame:
    """asked(w1 .. wn) with the probability of the last word after the others, a column for each mode.

    The history of a shorter order is the end of the longer one. Counts of each order are aggregated once and looked up by equi-joins.
    """
    discount = min(max(discount, 0.0), 0.9999999)
    keys = [f"w{k + 1}" for k in range(order)]
    out = asked.select(*keys).distinct()
    total = arrays.agg(F.sum(F.size("words")).cast("double").alias("_total"))
    ends = {n: keys[order - n :] for n in range(1, order + 1)}
    # A history counts wherever it stands, at the end of a record too.
    wanted = [F.array(*own) for own in ends.values()] + [F.array(*own[:-1]) for n, own in ends.items() if n > 1]
    counts = counts_of(arrays, out.select(F.explode(F.array_distinct(F.array(*wanted))).alias("gram")), list(range(1, order + 1)))
    for n, own in ends.items():
        found = [(f"_c{n}", own)] + ([(f"_h{n}", own[:-1])] if n > 1 else [])
        for name, words in found:
            out = out.withColumn("gram", F.array(*words)).join(counts.withColumnRenamed("n", name), "gram", "left").drop("gram")
    out = out.join(total, F.lit(True))
    mass = F.col("_total") * (1.0 + discount)
    ps = [F.when(F.col("_c1") > 0, F.col("_c1") / mass).otherwise(F.lit(discount))] + [F.when(F.col(f"_h{n}") > 0, F.col(f"_c{n}") / F.col(f"_h{n}")) for n in range(2, order + 1)]
    return out.select(*keys, *[smoothed(ps, m, discount, alpha).alias(m) for m in modes])


def _docs(spark, sf_dir):
    return word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _asked(spark, sf_dir, n):
    arrays = word_arrays(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ngram_counts(arrays, n).drop("n")


def q_counts(n, least):
    return lambda spark, sf_dir: ngram_counts(_docs(spark, sf_dir), n, least)


def q_phrase(spark, sf_dir):
    return phrase_frequency(_docs(spark, sf_dir), _asked(spark, sf_dir, 3), 3)


def q_gap(spark, sf_dir):
    return phrase_frequency(_docs(spark, sf_dir), _asked(spark, sf_dir, 2), 2, gap=1)


def q_lm(mode):
    def run(spark, sf_dir):
        return conditional_probability(_docs(spark, sf_dir), _asked(spark, sf_dir, 3), 3, [mode]).select("w1", "w2", "w3", F.round(mode, 9).alias("p"))

    return run


def q_locations(spark, sf_dir):
    """Where the two most usual English words of the corpus stand together."""
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return phrase_locations(tok, ["of", "the"])


def q_preceded(spark, sf_dir):
    """Where a frequent pair of words stands after one of a few words."""
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return preceded_by(phrase_locations(tok, CONTEXT[1:]), tok, CONTEXT[:1])


def q_successors(spark, sf_dir):
    """Third words after those of the documents."""
    return successors(_docs(spark, sf_dir), 3)


def q_classes(spark, sf_dir):
    """Words by their length, as classes."""
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return class_sizes(tok, tok.select("word", F.length("word").alias("class")).distinct())


def q_vocabulary(spark, sf_dir):
    return vocabulary(positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))


def q_c_array(spark, sf_dir):
    """Running sum of word counts in word order: where each word's occurrences would begin in a sorted index."""
    tok = positions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    counts = tok.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.substring("word", 1, 2))
    parts = counts.groupBy("part").agg(F.sum("n").alias("s"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(parts, "part").select("word", "n", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("c"))


def q_history(spark, sf_dir):
    """Each user's events with the two before: the history a model would see."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", "event_type", F.lag("event_type", 1).over(order).alias("h1"), F.lag("event_type", 2).over(order).alias("h2"))


def q_delta(spark, sf_dir):
    """Histogram of the time between a user's events, in whole hours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    delta = F.floor((at - F.lag(at).over(order)) / 3_600_000_000)
    return events.select(delta.alias("hours")).where("hours IS NOT NULL").groupBy("hours").agg(F.count(F.lit(1)).alias("n"))


def q_ranges(spark, sf_dir):
    """Stretches of documents covered by their repeated trigrams, merged."""
    arrays = word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return merge_ranges(frequent_places(arrays, "doc_id", 3, 20).withColumn("end", F.col("start") + 2), "doc_id")


_W = r"d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents), q AS (SELECT regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark)"


def _grams(table: str, n: int, step: int = 1) -> str:
    cols = ", ".join(f"w[i + {k * step}] AS w{k + 1}" for k in range(n))
    return f"(SELECT {cols} FROM (SELECT w, unnest(range(1, len(w) - {(n - 1) * step} + 1)) AS i FROM {table}))"


def _count_sql(n, least):
    keys = ", ".join(f"w{k + 1}" for k in range(n))
    return f"WITH {_W} SELECT {keys}, count(*) AS n FROM {_grams('d', n)} GROUP BY {keys} HAVING count(*) >= {least}"


def _lm_sql(mode: str) -> str:
    d, r = DISCOUNT, 1.0 + DISCOUNT
    p = ["p1", "p2", "p3"]
    if mode == "none":
        e = f"p3 / {r}"
    elif mode == "backoff":
        e = f"CASE WHEN p3 > 0 THEN p3 / {r} WHEN p2 > 0 THEN p2 / {r} WHEN p1 > 0 THEN p1 / {r} ELSE {d} END"
    elif mode == "stupid_backoff":
        e = f"CASE WHEN p3 > 0 THEN p3 / {r} WHEN p2 > 0 THEN {ALPHA} * p2 / {r} WHEN p1 > 0 THEN {ALPHA} * {ALPHA} * p1 / {r} ELSE {ALPHA} * {ALPHA} * {ALPHA} * {d} END"
    elif mode == "max":
        e = f"CASE WHEN p1 = 0 THEN {d} WHEN p2 = 0 THEN p1 / {r} WHEN p3 = 0 THEN greatest(p1, p2) / {r} ELSE greatest(p1, p2, p3) / {r} END"
    else:
        w = {"mean": (1, 1, 1), "wtmean": (1, 2, 3), "quadmean": (1, 4, 9), "cubemean": (1, 8, 27), "simpkn": (1, 8, 27), "expmean": (2, 4, 8)}[mode]
        e = f"(CASE WHEN p1 = 0 THEN 0 WHEN p2 = 0 THEN p1 * {w[0]} WHEN p3 = 0 THEN p1 * {w[0]} + p2 * {w[1]} ELSE p1 * {w[0]} + p2 * {w[1]} + p3 * {w[2]} END) / {sum(w)}.0"
    return f"""
WITH {_W}, a AS (SELECT DISTINCT * FROM {_grams('q', 3)}), n AS (SELECT sum(len(w))::DOUBLE AS t FROM d),
t AS MATERIALIZED (SELECT w1, lead(w1, 1) OVER r AS w2, lead(w1, 2) OVER r AS w3 FROM (SELECT k, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS k, w FROM d)) WINDOW r AS (PARTITION BY k ORDER BY i)),
h AS (SELECT w1, w2 FROM a UNION SELECT w2, w3 FROM a),
c1 AS (SELECT w1, count(*) AS c FROM t GROUP BY ALL), c2 AS (SELECT w1, w2, count(*) AS c FROM t SEMI JOIN h USING (w1, w2) GROUP BY ALL), c3 AS (SELECT w1, w2, w3, count(*) AS c FROM t SEMI JOIN a USING (w1, w2, w3) GROUP BY ALL),
r AS (SELECT a.*, CASE WHEN u.c > 0 THEN u.c / (t * {r}) ELSE {d} END AS p1, coalesce(b.c / hb.c, 0) AS p2, coalesce(g.c / hg.c, 0) AS p3
  FROM a LEFT JOIN c1 u ON u.w1 = a.w3 LEFT JOIN c2 b ON b.w1 = a.w2 AND b.w2 = a.w3 LEFT JOIN c1 hb ON hb.w1 = a.w2
  LEFT JOIN c3 g ON g.w1 = a.w1 AND g.w2 = a.w2 AND g.w3 = a.w3 LEFT JOIN c2 hg ON hg.w1 = a.w1 AND hg.w2 = a.w2, n)
SELECT w1, w2, w3, round(({e})::DOUBLE, 9) AS p FROM r
"""


QUERIES = {
    "ngram_1_counts": q_counts(1, 1),
    "ngram_2_counts": q_counts(2, 2),
    "ngram_3_counts": q_counts(3, 2),
    "phrase_freq": q_phrase,
    "gap_search": q_gap,
    "phrase_locations": q_locations,
    "context_restriction": q_preceded,
    "nth_successor": q_successors,
    "class_sizes": q_classes,
    "vocabulary_ids": q_vocabulary,
    "running_cumsum": q_c_array,
    "history_lag": q_history,
    "delta_histogram": q_delta,
    "location_ranges": q_ranges,
} | {f"lm_{m}": q_lm(m) for m in SMOOTHING}
SQL = {
    "ngram_1_counts": _count_sql(1, 1),
    "ngram_2_counts": _count_sql(2, 2),
    "ngram_3_counts": _count_sql(3, 2),
    "phrase_freq": f"WITH {_W}, a AS (SELECT DISTINCT * FROM {_grams('q', 3)}), c AS (SELECT w1, w2, w3, count(*) AS n FROM {_grams('d', 3)} GROUP BY ALL) SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (w1, w2, w3)",
    "gap_search": f"WITH {_W}, a AS (SELECT DISTINCT * FROM {_grams('q', 2)}), c AS (SELECT w1, w2, count(*) AS n FROM {_grams('d', 2, 2)} GROUP BY ALL) SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (w1, w2)",
    "phrase_locations": f"WITH {_W} SELECT doc_id AS rec, (i - 1)::INT AS start, i::INT AS end FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) WHERE w[i] = 'of' AND w[i + 1] = 'the'",
    "context_restriction": f"WITH {_W} SELECT doc_id AS rec, (i - 1)::INT AS start, i::INT AS end FROM (SELECT doc_id, w, unnest(range(2, len(w))) AS i FROM d) WHERE w[i - 1] = '{CONTEXT[0]}' AND w[i] = '{CONTEXT[1]}' AND w[i + 1] = '{CONTEXT[2]}'",
    "nth_successor": f"WITH {_W} SELECT w1, w2, count(*) AS n FROM {_grams('d', 2, 3)} GROUP BY w1, w2",
    "class_sizes": f"WITH {_W} SELECT length(word)::INT AS class, count(DISTINCT word) AS words, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1",
    "vocabulary_ids": f"WITH {_W} SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(w) AS word FROM d)",
    "running_cumsum": f"WITH {_W}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word) SELECT word, n, (sum(n) OVER (ORDER BY word) - n)::BIGINT AS c FROM c",
    "history_lag": "SELECT event_id, user_id, event_type, lag(event_type, 1) OVER w AS h1, lag(event_type, 2) OVER w AS h2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "delta_histogram": "SELECT hours, count(*) AS n FROM (SELECT floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000)::BIGINT AS hours FROM events) WHERE hours IS NOT NULL GROUP BY hours",
    "location_ranges": f"WITH {_W}, t AS (SELECT doc_id, i - 1 AS s, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)), f AS (SELECT a, b, c FROM t GROUP BY ALL HAVING count(*) >= 20), m AS (SELECT doc_id, s, s + 2 AS e FROM t SEMI JOIN f USING (a, b, c)), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT doc_id, min(s)::INT AS start, max(e)::INT AS end FROM g GROUP BY doc_id, k",
} | {f"lm_{m}": _lm_sql(m) for m in SMOOTHING}
