"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words (a shorter item is one window), a window into shingles. A
window that occurs in a document puts all its shingles there, so any one of them is a necessary token; shingles are
ordered by how often the whole corpus holds them, and a window is joined by its rarest ones only (its prefix: one, or more
where a part of the shingles may be missing). The place of the shingle in the window and in the document gives the
one place where the window can stand: it must lie within the document (length and position), and there the words are
compared as strings.

Documents are read twice, to count the shingles and to look for prefixes; both passes carry a bit table of fixed size made
from the benchmark's shingles, so what they carry doesn't grow with the benchmark and few words leave them. All
else is equi-joins of those few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import spread
from .store import Tables
from .words import Words, mix, pieces

#: Words in a window, and in a shingle of it.
WINDOW, SHINGLE = 10, 3
#: The bit table has 2 ** BITS bits (2 MB); two of them are set for each shingle.
BITS = 24
#: Keys that a worker counts before it sends them on.
COUNTED = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes as words hold them: digits, small letters (capitals folded) and all beyond ASCII; others part words.
_FOLD = np.full(256, 32, np.uint8)
for _low, _high, _to in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x61), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _FOLD[_low:_high] = np.arange(_to, _to + _high - _low)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with capitals folded and a space for each byte that parts words; null stays null."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(data))


def shingle_keys(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``size`` words begin that lie in one text, and their keys."""
    at = np.flatnonzero(np.arange(len(found.hash)) + size <= found.first[found.text + 1])
    key = np.full(len(at), size, np.uint64)
    for k in range(size):
        key = mix(key * _ODD + found.hash[at + k])
    return at, key


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return key & mask, (key >> np.uint64(64 - BITS)) & mask


def may_hold(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be in a bit table; of others a small part passes too."""
    out = np.ones(len(key), bool)
    for slot in _slots(key):
        out &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
    return out


def bit_table(keys: DataFrame) -> np.ndarray:
    """The bit table of a column ``key``: 2 ** BITS bits, whatever the number of keys, ORed together by Spark."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    set_ = keys.select("key").mapInArrow(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[set_.column("at").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return table


def _words_of(found: Words, at: np.ndarray) -> pa.Array:
    data = found.data.tobytes()
    return pa.array([data[s:e].decode() for s, e in zip(found.starts[at].tolist(), found.ends[at].tolist())], pa.string())


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """All numbers of the ranges one after another, and the ranges' offsets."""
    n = end - begin
    offsets = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(begin - offsets[:-1], n) + np.arange(offsets[-1]), pa.array(offsets.astype(np.int32))


def _word_lists(found: Words, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words of ranges, as lists; each word is cut out once."""
    at, offsets = _runs(begin, end)
    distinct, back = np.unique(at, return_inverse=True)
    return pa.ListArray.from_arrays(offsets, _words_of(found, distinct).take(pa.array(back)))


def _windows(window: int, shingle: int):
    """(item, words, keys) of every window of (item, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], 1, 1 << 18):
                found = Words(folded(part.column(1)))
                counts = np.diff(found.first)
                for width in np.unique(np.minimum(counts, window)):
                    if not width:
                        continue
                    # Items of at least ``window`` words have windows of that size; a shorter one is a window.
                    of = np.flatnonzero(np.minimum(counts, window) == width)
                    begin, _ = _runs(found.first[of], found.first[of] + counts[of] - width + 1)
                    size = min(shingle, int(width))
                    where, key = shingle_keys(found, size)
                    place = np.zeros(len(found.hash) + 1, np.int64)
                    place[where] = np.arange(len(where))
                    m = int(width) - size + 1
                    keys = key[place[begin][:, None] + np.arange(m)].ravel().view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * np.int32(m)), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found.text[begin])), _word_lists(found, begin, begin + width), lists], names=["item", "words", "keys"])

    return run


def _count(bits: np.ndarray, sizes: list[int]):
    """(key, n): how often texts hold each key that may be in the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for part in pieces(batches, 0):
            found = Words(folded(part.column(0)))
            for size in sizes:
                _, key = shingle_keys(found, size)
                held.append(key[may_hold(bits, key)])
            if sum(map(len, held)) > COUNTED:
                yield out()
        if held:
            yield out()

    return run


def _probe(bits: np.ndarray, sizes: list[int], window: int, form: pa.Schema):
    """For each text (row, id, n_words), and for each place of a shingle that may be in a prefix (row, key, at) with the words around it, from word ``base`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            found = Words(folded(part.column(2)))
            none = lambda n: [pa.nulls(n, f.type) for f in form]
            columns = none(part.num_rows)
            columns[0], columns[1], columns[2] = part.column(0), part.column(1), pa.array(np.diff(found.first))
            yield pa.RecordBatch.from_arrays(columns, schema=form)
            for size in sizes:
                at, key = shingle_keys(found, size)
                hit = may_hold(bits, key)
                at, key = at[hit], key[hit]
                for low in range(0, len(at), 10_000):
                    w, k = at[low : low + 10_000], key[low : low + 10_000]
                    first, last = found.first[found.text[w]], found.first[found.text[w] + 1]
                    begin, end = np.maximum(first, w - (window - size)), np.minimum(last, w + window)
                    columns = none(len(w))
                    columns[0], columns[2] = part.column(0).take(pa.array(found.text[w])), pa.array(last - first)
                    columns[3], columns[4], columns[5], columns[6] = pa.array(k.view(np.int64)), pa.array(w - first), pa.array(begin - first), _word_lists(found, begin, end)
                    yield pa.RecordBatch.from_arrays(columns, schema=form)

    return run


def _sizes(windows: DataFrame, shingle: int) -> list[int]:
    """Which sizes of shingle there are, ``shingle`` of them at most."""
    return sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0) -> DataFrame:
    """(id_col, n_words, n_hit, items): a row for each row of ``docs``; ``items`` are the ids (as strings, sorted) of the items with a window in it.

    A window occurs where at least ``containment`` of its shingles stand in the same places; with 1, where all its words do. A word is hit
    if it lies in any occurrence. Capitals of ASCII are folded, words are runs of digits, letters and all beyond ASCII. Null and empty texts,
    and texts of signs only, have no words and no windows; very long texts are read whole; items that share an id are one item, repeated
    windows count once, a null item id reads as the empty string; repeated documents have a row each; no items hit nothing; no documents give no rows; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, shingle = docs.sparkSession, min(shingle, window)
    tables = Tables(spark, "decontamination")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    made = tables.keep(named.mapInArrow(_windows(window, shingle), "item string, words array<string>, keys array<long>").distinct())
    windows = tables.keep(made.select("words", "keys").distinct().withColumn("wid", F.monotonically_increasing_id()))
    holds = tables.keep(made.join(windows.select("words", "wid"), "words").select("wid", "item"))
    sizes = _sizes(windows, shingle)
    keys = windows.select(F.explode("keys").alias("key")).distinct()
    counts = texts.select("text").mapInArrow(_count(bit_table(keys), sizes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # The prefix: so many of the rarest shingles that a window with enough of them in place has one of these.
    need = F.ceil(F.lit(containment) * F.size("keys")).cast("int")
    ranked = windows.select("wid", F.posexplode("keys").alias("offset", "key")).join(counts, "key", "left")
    ranked = ranked.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))).alias("ranked"))
    prefix = ranked.join(windows, "wid").select("wid", "words", need.alias("need"), F.explode(F.slice("ranked", 1, F.size("keys") - need + 1)).alias("token"))
    # Shingles that no document holds lead nowhere.
    prefix = tables.keep(prefix.where("token.n > 0").select("wid", "words", "need", F.col("token.key").alias("key"), F.col("token.offset").alias("offset")))
    form = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "key", "at", "base")), T.StructField("around", T.ArrayType(T.StringType()))])
    probed = tables.keep(texts.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(_probe(bit_table(prefix), _sizes(prefix, shingle), window, to_arrow_schema(form)), form))
    width = F.size("words")
    begin = F.col("at") - F.col("offset")
    met = probed.where("key IS NOT NULL").join(prefix, "key").where((begin >= 0) & (begin + width <= F.col("n_words")))
    met = met.select("row", "wid", begin.alias("begin"), width.alias("width"), "words", "need", F.slice("around", (begin - F.col("base") + 1).cast("int"), width).alias("there"))
    if containment >= 1:
        met = met.where(F.col("there") == F.col("words"))
    else:
        size = F.least(width, F.lit(shingle))
        in_place = F.filter(F.sequence(F.lit(1), width - size + 1), lambda k: F.slice("there", k, size) == F.slice("words", k, size))
        met = met.where(F.size(in_place) >= F.col("need"))
    hits = tables.keep(met.select("row", "wid", "begin", "width").distinct())
    # Occurrences by where they begin; each adds what reaches beyond all before it.
    spans = hits.groupBy("row", "begin").agg(F.max(F.col("begin") + F.col("width")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0))), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))
    found = hits.select("row", "wid").distinct().join(holds, "wid").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    met = probed.where("key IS NULL").select("row", "id", "n_words").join(hit, "row", "left").join(found, "row", "left")
    return met.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
o AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT r, k, n, item FROM o JOIN i USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
