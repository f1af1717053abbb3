"""The order of all suffixes of a corpus, the ranges that phrases take in it, and longest matches of many keys.

Suffixes are first ranked by ``HEAD`` words, then by doubling: pairs of a suffix's rank and that of the suffix h words on give ranks by 2 h words. Records with the
same words are ranked once, and chunks of records send their different heads, or pairs of ranks, as sorted and compressed runs and get places back: no word and no
position is a row of a shuffle. A suffix that differs from all others, or has ended, is settled and goes no further; the rounds are over when all are.
A suffix ends with its record, and the shorter one comes first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoints, ship
from ..sources.manifest import Manifest
from .ngrams import _W, counts_of, ngrams, rebuild, word_arrays

#: Words by which keys and records first meet in a longest match.
SEED = 3
#: Words of the heads by which suffixes are first ranked; two of them fill a long.
HEAD = 4
#: Bytes of a chunk of records, and heads or ranks in a part that is sorted at once, about.
CHUNK, PART = 1 << 22, 1 << 20
#: Heads of a chunk, and of all chunks, by which the borders of parts are set; they decide only how even the parts are.
SAMPLE, SAMPLES = 256, 200_000


def places(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, place) of (by..., n): one more than the sum of n of all rows before, in the order of ``by``. Rows are distinct by ``by``.

    Rows are sorted in ranges; a running sum in each range is added to the sums of the ranges before, of which there is one for each partition.
    """
    ranged = counted.repartitionByRange(*[F.col(c) for c in by]).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum("n").over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_range").select(*by, "n", (F.col("_start") + F.col("_inside") + 1).alias("place"))


def _pieces(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """The rows as tables of about ``most`` bytes of a text column, or of one row."""
    waiting, held = [], 0
    for batch in batches:
        part = np.cumsum(np.array(pc.binary_length(batch.column(column)), dtype=np.int64)) // most
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(part)], strict=True):
            waiting.append(batch.slice(low, high - low))
            held += pc.sum(pc.binary_length(waiting[-1].column(column))).as_py()
            if held >= most:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _packed(**columns) -> bytes:
    sink, t = pa.BufferOutputStream(), pa.table({k: pa.array(v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> dict:
    t = pa.ipc.open_stream(blob).read_all().combine_chunks()
    one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
    return {k: one(t[k]) if k == "head" else one(t[k]).to_numpy(zero_copy_only=False) for k in t.column_names}


def _cut(texts: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a text."""
    offsets = np.append(0, np.cumsum(ends - starts))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.frombuffer(texts, np.uint8)[at])])


class _Chunk:
    """Records whose words, each with a zero byte after it, stand one after another in ``texts``; ``bounds`` are the numbers of words before each record, and of all."""

    def __init__(self, texts: bytes, sizes: np.ndarray) -> None:
        self.texts = texts
        self.stops = np.flatnonzero(np.frombuffer(texts, np.uint8) == 0) + 1
        self.bounds = np.searchsorted(self.stops, np.append(0, np.cumsum(sizes)), side="right")
        self.end = np.repeat(self.bounds[1:], np.diff(self.bounds))

    def heads(self, at: np.ndarray) -> pa.Array:
        """The next ``HEAD`` words of suffixes, in bytes that are in order as the words are; what goes on has a zero byte at its end."""
        last = np.minimum(at + HEAD, self.end[at])
        return _cut(self.texts, np.append(0, self.stops)[at], self.stops[last - 1] - (self.end[at] <= at + HEAD))

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Two longs for each suffix that are in order as its head is within the chunk, and equal where the heads are."""
        words = pa.Array.from_buffers(pa.large_binary(), len(self.stops), [None, pa.py_buffer(np.append(0, self.stops).astype(np.int64)), pa.py_buffer(self.texts)]).dictionary_encode()
        places = np.empty(len(words.dictionary), np.int64)
        places[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(1, len(places) + 1)
        code, at = np.append(places[words.indices.to_numpy()], np.zeros(HEAD, np.int64)), np.arange(len(self.stops))
        a, b, c, d = (np.where(at + k < self.end, code[at + k], 0) for k in range(HEAD))
        return a << 31 | b, c << 32 | d << 1 | (at + HEAD < self.end)


def _classes(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, own): the order of pairs of longs, where in it each different one begins, and the number of each pair's own."""
    order = np.lexsort((low, high))
    changes = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    first = np.append(0, np.flatnonzero(changes) + 1) if len(order) else order
    own = np.empty(len(order), np.int64)
    own[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return order, first, own


def _added(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], first) if len(first) else values[:0]


def _chunks(most: int):
    """(key, text, n) to (chunk, keys, n, sizes, texts, words, sample)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for k, t in enumerate(_pieces(batches, 1, most)):
            texts, sizes = b"".join(t["text"].to_pylist()), np.array(pc.binary_length(t["text"]), dtype=np.int64)
            c = _Chunk(texts, sizes)
            some = np.random.default_rng(first + k).integers(0, len(c.stops), SAMPLE)
            row = [first + k, b"".join(t["key"].to_pylist()), np.array(t["n"], dtype=np.int64).tobytes(), sizes.tobytes(), texts, len(c.stops), c.heads(some).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(row, (pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.binary())), strict=True)], names=["chunk", "keys", "n", "sizes", "texts", "words", "sample"])

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a chunk is large."""
    return (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))


def _read(row: dict) -> tuple[_Chunk, np.ndarray]:
    """A chunk, and how often each record stands in the corpus."""
    return _Chunk(row["texts"], np.frombuffer(row["sizes"], np.int64)), np.frombuffer(row["n"], np.int64)


_RUN = "part long, chunk long, run binary"


def _runs(chunk: int, parts: list[int], runs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(runs, pa.binary())], names=["part", "chunk", "run"])


def _sent_heads(borders: list[bytes]):
    """Chunks to runs of their different heads, with how often each stands in the corpus (n) and in different records or places (m)."""

    def run(batches):
        from bisect import bisect_left

        for row in _rows(batches):
            c, n = _read(row)
            order, first, _ = _classes(*c.order())
            heads, n, m = c.heads(order[first]), _added(np.repeat(n, np.diff(c.bounds)), order, first), np.diff(np.append(first, len(order)))
            cuts = [0, *[bisect_left(heads, b, key=lambda x: x.as_py()) for b in borders], len(heads)]
            held = [p for p in range(len(borders) + 1) if cuts[p] < cuts[p + 1]]
            yield _runs(row["chunk"], held, [_packed(head=heads[cuts[p] : cuts[p + 1]], n=n[cuts[p] : cuts[p + 1]], m=m[cuts[p] : cuts[p + 1]]) for p in held])

    return run


def _answers(t: pa.Table, sizes: list[int], own: np.ndarray, places: np.ndarray, many: np.ndarray, total: int) -> pa.Table:
    """For each run the places of its heads or pairs, by differences, and whether others share them."""
    cuts = np.append(0, np.cumsum(sizes))
    runs = [_packed(place=np.diff(places[own[a:b]], prepend=0), many=many[own[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([t["part"], t["chunk"], pa.array(runs, pa.binary()), pa.array([total] * len(runs), pa.int64())], names=["part", "chunk", "run", "total"])


def _placed_heads(t: pa.Table) -> pa.Table:
    """The runs of a part to the places of their heads within the part."""
    found = [_unpacked(r) for r in t["run"].to_pylist()]
    coded = pa.concat_arrays([f["head"] for f in found]).dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    own = rank[coded.indices.to_numpy()]
    n, m = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    np.add.at(n, own, np.concatenate([f["n"] for f in found]))
    np.add.at(m, own, np.concatenate([f["m"] for f in found]))
    return _answers(t, [len(f["n"]) for f in found], own, np.cumsum(n) - n + 1, m > 1, int(n.sum()))


def _sent_pairs(h: int, part: int):
    """Chunks to runs of the different pairs of ranks of their open suffixes, h words apart; a part has all suffixes of a rank."""

    def run(batches):
        for row in _rows(batches):
            rank, next_, n = _pairs(row, h)
            order, first, _ = _classes(rank, next_)
            at = order[first]
            rank, next_, n, m = rank[at], next_[at], _added(n, order, first), np.diff(np.append(first, len(order)))
            cuts = np.append(np.flatnonzero(np.diff((rank - 1) // part, prepend=-1)), len(rank))
            pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield _runs(row["chunk"], [int(rank[a] - 1) // part for a, _ in pieces], [_packed(rank=np.diff(rank[a:b], prepend=0), next=next_[a:b], n=n[a:b], m=m[a:b]) for a, b in pieces])

    return run


def _placed_pairs(t: pa.Table) -> pa.Table:
    found = [_unpacked(r) for r in t["run"].to_pylist()]
    rank = np.concatenate([np.cumsum(f["rank"]) for f in found])
    order, first, own = _classes(rank, np.concatenate([f["next"] for f in found]))
    n, m = (_added(np.concatenate([f[c] for f in found]), order, first) for c in "nm")
    rank, before = rank[order[first]], np.cumsum(n) - n
    begin = np.flatnonzero(np.diff(rank, prepend=-1))
    places = rank + before - np.repeat(before[begin], np.diff(np.append(begin, len(rank))))
    return _answers(t, [len(f["n"]) for f in found], own, places, m > 1, int(n.sum()))


def _pairs(row: dict, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the open suffixes and of those h words on, and how often their records stand in the corpus."""
    s, n, bounds = _unpacked(row["rows"]), np.frombuffer(row["n"], np.int64), np.frombuffer(row["bounds"], np.int64)
    at = s["at"][s["open"]]
    return s["rank"][s["open"]], s["rank"][np.searchsorted(s["at"], at + h)], n[np.searchsorted(bounds, at, side="right") - 1]


_STATE = "chunk long, keys binary, n binary, bounds binary, rows binary, key binary, pos array<int>, rank array<long>"


def _kept(row: dict, bounds: np.ndarray, at: np.ndarray, rank: np.ndarray, new: np.ndarray, open_: np.ndarray, h: int) -> pa.Table:
    """What is known of suffixes ``at`` by h words: a row for the chunk with the open ones and all that their later rounds look up, and for each record a row with what is settled now, of the ``new`` ranks."""
    record = np.searchsorted(bounds, at, side="right") - 1
    done = np.flatnonzero(new & ~open_)
    full, begin = np.unique(record[done], return_index=True)
    offsets, keys = pa.array(np.append(begin, len(done)), pa.int32()), row["keys"]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, f)) for v, f in (((at - bounds[record])[done], pa.int32()), (rank[done], pa.int64()))]
    wanted, end, step, asked = at[open_], bounds[record[open_] + 1], h, [at[open_]]
    while len(wanted):
        inside = wanted + step < end
        wanted, end = wanted[inside], end[inside]
        asked.append(wanted + step)
        step *= 2
    held = np.isin(at, np.concatenate(asked))
    state = [[row["chunk"], keys, row["n"], bounds.astype(np.int64).tobytes(), _packed(at=at[held], rank=rank[held], open=open_[held])]] if open_.any() else []
    k = len(state)
    front = [pa.array([r[c] for r in state] + [None] * len(full), f) for c, f in enumerate((pa.int64(), *[pa.binary()] * 4))]
    back = [pa.concat_arrays([pa.nulls(k, v.type), v]) for v in (pa.array([keys[16 * r : 16 * r + 16] for r in full], pa.binary()), *lists)]
    return pa.table([*front, *back], names=["chunk", "keys", "n", "bounds", "rows", "key", "pos", "rank"])


def _given(t: pa.Table, starts: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places and whether others share them, in the order in which a chunk has sent its heads or pairs."""
    rows = sorted(t.select(["part", "run"]).to_pylist(), key=lambda r: r["part"])
    found = [(starts.get(r["part"], 0), _unpacked(r["run"])) for r in rows]
    return np.concatenate([np.cumsum(f["place"]) + s for s, f in found]), np.concatenate([f["many"] for _, f in found])


def _ranked_by_heads(starts: dict):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c, _ = _read(row)
        _, _, own = _classes(*c.order())
        places, many = _given(right, starts)
        at = np.arange(len(own))
        return _kept(row, c.bounds, at, places[own], np.ones(len(at), bool), many[own] & (c.end - at > HEAD), HEAD)

    return run


def _ranked_by_pairs(h: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        s, bounds = _unpacked(row["rows"]), np.frombuffer(row["bounds"], np.int64)
        _, _, own = _classes(*_pairs(row, h)[:2])
        places, many = _given(right, {})
        at, rank, new, open_ = s["at"], s["rank"].copy(), s["open"], s["open"].copy()
        rank[new] = places[own]
        open_[new] = many[own] & (bounds[np.searchsorted(bounds, at[new], side="right")] - at[new] > 2 * h)
        return _kept(row, bounds, at, rank, new, open_, 2 * h)

    return run


def suffix_order(arrays: DataFrame, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(rec, pos, rank) of arrays(rec, words): one more than the number of suffixes before; equal suffixes share their rank.

    Each row is a record, whatever its name; a record is ranked as a whole, so it must fit a task. Words aren't null and have no zero bytes. No words give no rows.
    """
    from ..sources.files import _folder

    spark = arrays.sparkSession
    ship(spark)
    tables = Manifest(spark, path := _folder(spark, "suffixes"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    named = arrays.where(F.size("words") > 0).select("rec", F.concat(F.array_join("words", "\0"), F.lit("\0")).cast("binary").alias("text"))
    named = named.select("rec", F.unhex(F.md5("text")).alias("key"), "text")
    alike = named.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    own = keep(alike.mapInArrow(_chunks(chunk), "chunk long, keys binary, n binary, sizes binary, texts binary, words long, sample array<binary>"), "chunks")
    chunks, words = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    some = F.slice("sample", 1, max(1, min(SAMPLE, SAMPLES // max(chunks, 1))))
    heads, parts = sorted(bytes(r[0]) for r in own.select(F.explode(some)).collect()), max(1, -(-words // part))
    borders = sorted({heads[len(heads) * k // parts] for k in range(1, parts)})
    sent = own.mapInArrow(_sent_heads(borders), _RUN)
    answers = keep(sent.groupBy("part").applyInArrow(_placed_heads, f"{_RUN}, total long"), "places")
    starts, before = {}, 0
    for k, total in sorted(tuple(r) for r in answers.groupBy("part").agg(F.max("total")).collect()):
        starts[k], before = before, before + total
    h = HEAD
    state = keep(own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ranked_by_heads(starts), _STATE), f"by_{h}")
    tables.delete("chunks")
    tables.delete("places")
    found = []
    while True:
        found.append(state.where("key IS NOT NULL").select("key", "pos", "rank"))
        rest = state.where("chunk IS NOT NULL").select("chunk", "keys", "n", "bounds", "rows")
        if rest.isEmpty():
            break
        answers = rest.mapInArrow(_sent_pairs(h, part), _RUN).groupBy("part").applyInArrow(_placed_pairs, f"{_RUN}, total long")
        state = keep(rest.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ranked_by_pairs(h), _STATE), f"by_{2 * h}")
        h *= 2
    return named.select("rec", "key").join(reduce(DataFrame.unionByName, found), "key").select("rec", F.inline(F.arrays_zip("pos", "rank")))


def suffix_ranks(tok: DataFrame) -> DataFrame:
    """``suffix_order`` of tok(rec, pos, word); positions of a record count from 0 without holes."""
    return suffix_order(rebuild(tok))


def phrase_ranges(arrays: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """(gram, first, last, n): the ranks that the suffixes which begin with each phrase(gram of n words) take; phrases that don't occur are left out.

    arrays: (rec, words). Those suffixes are all that lie between, and how many come before them is settled by the first n words of each, so
    suffixes are counted and sorted by these and not ranked any further. Shorter ones at the ends of records lack the last words (nulls, which come first).
    """
    ensure_checkpoints(arrays.sparkSession)
    keys = [f"_w{k + 1}" for k in range(n)]
    heads = F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(*[F.get("words", i + k).alias(key) for k, key in enumerate(keys)])))
    counted = arrays.select(F.explode(heads).alias("head")).select("head.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = phrases.select("gram").distinct().select("gram", *[F.get("gram", F.lit(k)).alias(key) for k, key in enumerate(keys)])
    return places(counted, keys).join(asked, keys).select("gram", F.col("place").alias("first"), (F.col("place") + F.col("n") - 1).alias("last"), "n")


def longest_matches(arrays: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(key, words) with ``length``, that of the longest beginning that occurs in arrays(words), and ``n``, how often it does; 0 and 0 if not even the first word occurs.

    Keys meet the records by their first ``SEED`` words, in one join; from there on the words are compared one by one, and only (key, length) pairs are counted.
    Shorter beginnings are looked up for the keys that have none of that length. Keys are told apart by their words; null and empty ones match nothing.
    """
    distinct = keys.select(F.col("words").alias("want")).where(F.size("want") > 0).distinct()
    long = distinct.where(F.size("want") >= SEED).withColumn("gram", F.slice("want", 1, SEED))
    each = arrays.select("words", F.posexplode(ngrams(F.col("words"), SEED)).alias("at", "gram")).join(long, "gram")
    # The first place in which the record differs from the key, or ends.
    same = F.zip_with(F.slice("words", F.col("at") + 1, F.size("want")), "want", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    counted = each.select("want", F.when(differs > 0, differs - 1).otherwise(F.size("want")).alias("length")).groupBy("want", "length").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("want").agg(F.max(F.struct("length", "n")).alias("best")).select("want", "best.*")
    rest = distinct.join(best.select("want"), "want", "left_anti")
    begun = rest.select("want", F.explode(F.array(*[F.slice("want", 1, k) for k in range(1, SEED)])).alias("gram")).distinct()
    short = begun.join(counts_of(arrays, begun, list(range(1, SEED))), "gram").groupBy("want").agg(F.max(F.struct(F.size("gram").alias("length"), "n")).alias("best")).select("want", "best.*")
    found = best.unionByName(short)
    return keys.join(found, keys["words"] == found["want"], "left").select(*keys.columns, F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.concat("conv_id", F.lit(":"), "turn").alias("rec"), "text")


def q_ranks(spark, sf_dir):
    """The order of all suffixes of what is said in the conversations."""
    return suffix_order(word_arrays(_turns(spark, sf_dir), keep=["rec"]))


def q_ranges(spark, sf_dir):
    """Where the pairs of words of the benchmark lie in that order."""
    turns = _turns(spark, sf_dir)
    asked = word_arrays(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.explode(ngrams(F.col("words"), 2)).alias("gram"))
    found = phrase_ranges(word_arrays(turns, keep=["rec"]), asked, 2)
    return found.select(F.get("gram", F.lit(0)).alias("w1"), F.get("gram", F.lit(1)).alias("w2"), "first", "last", "n")


def q_longest(spark, sf_dir):
    """How far the benchmark's items can be read in the documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return longest_matches(word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet")), word_arrays(items, keep=["item_id"])).select("item_id", "length", "n")


_T = r"c AS (SELECT conv_id || ':' || turn AS rec, regexp_extract_all(lower(text), '\p{L}+') AS w FROM conversations), s AS (SELECT rec, i - 1 AS pos, w[i:] AS tail FROM (SELECT rec, w, unnest(range(1, len(w) + 1)) AS i FROM c)), o AS (SELECT rec, pos::INT AS pos, rank() OVER (ORDER BY tail) AS rank, tail[1] AS w1, tail[2] AS w2 FROM s)"
QUERIES = {"suffix_ranks": q_ranks, "phrase_ranges": q_ranges, "longest_match": q_longest}
SQL = {
    "suffix_ranks": f"WITH {_T} SELECT rec, pos, rank FROM o",
    "phrase_ranges": rf"WITH {_T}, q AS (SELECT regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM benchmark), p AS (SELECT DISTINCT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM q)), x AS (SELECT *, row_number() OVER (ORDER BY rank) AS r FROM o) SELECT w1, w2, min(rank) AS first, max(r) AS last, count(*) AS n FROM x JOIN p USING (w1, w2) GROUP BY w1, w2",
    "longest_match": rf"WITH {_W}, k AS (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS k FROM benchmark), m AS (SELECT item_id, k, w[i:i + len(k) - 1] AS t FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN k ON k[1] = w[i]), l AS (SELECT item_id, coalesce(nullif(list_position([coalesce(z[1] = z[2], false) for z in list_zip(t, k)], false), 0) - 1, len(k))::INT AS length FROM m), g AS (SELECT item_id, length, count(*) AS n FROM l GROUP BY ALL) SELECT k.item_id, coalesce(max(length), 0) AS length, coalesce(arg_max(n, length), 0) AS n FROM k LEFT JOIN g USING (item_id) GROUP BY k.item_id",
}
