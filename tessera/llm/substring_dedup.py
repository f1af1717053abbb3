"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a text. Its minimiser is the least hash among its runs of
``MINIMISER`` words; equal windows have equal minimisers, so consecutive windows that share one travel together, as
one string of words (a super-k-mer) to the bucket of that minimiser. Strings for one bucket are packed and compressed
together. In the bucket all windows are sorted by a rolling hash and equal neighbours compared as strings, which counts them exactly.

A task sends at most two copies of any super-k-mer: from the third on it is known that its windows are repeated. So
copies, however many, fill no bucket. What a task remembers of them is bounded; forgetting only sends more.

A run of words that a large part of the texts hold would draw all windows around it into one bucket. Such runs are found
first, by counts over one text in ``SAMPLED``, and are no minimisers: the least other run of a window is, or the window's own hash
where it has no other. That, and the number of buckets, decide only where windows meet; every window of every text is counted.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.session import spread
from .store import Tables
from .words import PIECE, Words, _SPACE, _power_tables, key_groups, mix, pieces

WINDOW = 35
MINIMISER = 4
#: Windows in one super-k-mer at most.
LONGEST = 512
#: Bytes of super-k-mers that a task remembers.
REMEMBERED = 64 << 20
#: Bytes of super-k-mers that a task gathers before it packs them, and that a bucket sorts at once.
GATHERED, SORTED = 8 << 20, 4 << 20
#: One text in so many is looked at for frequent runs; occurrences in all texts from which a run is one; and the most that are collected and sent to tasks (16 MB).
SAMPLED, FREQUENT, MOST_FREQUENT = 64, 20_000, 2_000_000
#: Bytes of texts for one partition of buckets, where the session's number of shuffle partitions would give more.
PARTITION = 128 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = np.random.default_rng(35).integers(1, 1 << 63, MINIMISER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = pa.schema([("key", pa.uint32()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())])


def _runs(w: Words) -> np.ndarray:
    """The hash of the run of ``MINIMISER`` words that starts at each word (at the end of a text it reaches into the next one)."""
    out = np.zeros(max(len(w.hash) - MINIMISER + 1, 0), np.uint64)
    for k in range(MINIMISER):
        out = out + w.hash[k : k + len(out)] * _MULTIPLIERS[k]
    return mix(out)


def _starts(w: Words, size: int) -> np.ndarray:
    """The words from which ``size`` words of the same text follow, themselves included."""
    number = np.arange(max(len(w.hash) - size + 1, 0))
    return np.flatnonzero(number - w.first[w.text[: len(number)]] < np.diff(w.first)[w.text[: len(number)]] - size + 1)


def _rolled(w: Words, at: np.ndarray) -> np.ndarray:
    """The hashes of the windows that start at the words ``at``."""
    power, inverse = _power_tables(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * power[: len(w.hash)], out=sums[1:])
    return mix((sums[at + WINDOW] - sums[at]) * inverse[at])


def _run_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (run, n, bytes): occurrences of runs of words, and a row without a run for all of them and the bytes of the texts."""
    for batch in pieces(batches, 0, 2 * PIECE):
        w = Words(batch.column(0))
        values, n = np.unique(_runs(w)[_starts(w, MINIMISER)], return_counts=True)
        runs = pa.concat_arrays([pa.array(values.view(np.int64)), pa.nulls(1, pa.int64())])
        sizes = np.zeros(len(values) + 1, np.int64)
        sizes[-1] = len(w.data)
        yield pa.RecordBatch.from_arrays([runs, pa.array(np.append(n, n.sum()).astype(np.int64)), pa.array(sizes)], names=["run", "n", "bytes"])


def frequent_runs(texts: DataFrame, tables: Tables, least: int = FREQUENT) -> tuple[np.ndarray, int]:
    """Sorted hashes of the runs of words that occur ``least`` times or more, ``MOST_FREQUENT`` at most, and the bytes of all texts; both estimated."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = some.mapInArrow(_run_counts, "run long, n long, bytes long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    counted = tables.keep(counted.where(F.col("run").isNull() | (F.col("n") * SAMPLED >= least)))
    whole = counted.where("run IS NULL").first()
    if whole is None:
        return np.empty(0, np.uint64), 0
    # Runs with more than this part of all occurrences are fewer than MOST_FREQUENT.
    found = counted.where(F.col("run").isNotNull() & (F.col("n") > whole.n / MOST_FREQUENT)).select("run").toArrow()["run"].to_numpy()
    tables.drop(counted)
    return np.sort(found.astype(np.int64).view(np.uint64)), whole.bytes * SAMPLED


def _super_kmers(texts: pa.Array, frequent: np.ndarray = np.empty(0, np.uint64)) -> tuple[Words, bytes, list[np.ndarray]]:
    """Words, the texts with one blank after each word, and for each super-k-mer: minimiser, text, first word, windows, first and last byte.

    The runs with the (sorted) hashes ``frequent`` are no minimisers.
    """
    w = Words(texts)
    at = _starts(w, WINDOW)
    if not len(at):
        return w, b"", [np.empty(0, np.int64)] * 6
    least, width = _runs(w), 1
    if len(frequent):
        least[frequent[np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)] == least] = _NONE
    while width < WINDOW - MINIMISER + 1:
        step = min(width, WINDOW - MINIMISER + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    keys = least[at]
    bare = np.flatnonzero(keys == _NONE)
    if len(bare):
        keys[bare] = _rolled(w, at[bare])
    new = np.ones(len(at), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(place % LONGEST == 0)
    windows = np.diff(np.append(begin, len(at)))
    first = at[begin]
    solid = ~_SPACE[w.data]
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    joined = np.where(solid, w.data, np.uint8(32))[kept].tobytes()
    moved = np.concatenate([[0], np.cumsum(kept)])
    return w, joined, [keys[begin], w.text[first], first - w.first[w.text[first]], windows, moved[w.starts[first]], moved[w.ends[first + windows + WINDOW - 2]]]


def _even_keys(partitions: int, each: int = 2) -> list[int]:
    """``each`` numbers for every partition that hash partitioning (Murmur3 with seed 42) sends there: as many buckets in each task."""
    rotate = lambda x, n: ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF
    found, number, missing = [[] for _ in range(partitions)], 0, partitions * each
    while missing:
        h = (rotate((number * 0xCC9E2D51) & 0xFFFFFFFF, 15) * 0x1B873593) & 0xFFFFFFFF
        h = (rotate(42 ^ h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 4
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
        h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 16
        own = found[(h - (1 << 32) if h >> 31 else h) % partitions]
        if len(own) < each:
            own.append(number)
            missing -= 1
        number += 1
    return [k for own in found for k in own]


def _deal(keys: list[int], frequent: np.ndarray):
    """(h1, h2, text) to (bucket, payload): each payload holds rows of ``_ROW``, compressed; ``keys`` are the buckets' numbers, ``frequent`` runs no minimisers."""
    buckets = len(keys)

    def payload(rows: list[tuple]) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
        with pa.ipc.new_stream(sink, _ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        gathered: dict[int, list[tuple]] = defaultdict(list)
        size = spread = held = 0

        def out():
            done = pa.RecordBatch.from_arrays([pa.array([keys[b] for b in gathered], pa.int32()), pa.array([payload(r) for r in gathered.values()], pa.binary())], names=["bucket", "payload"])
            gathered.clear()
            return done

        for batch in pieces(batches, 2, 2 * PIECE):
            h1, h2 = (batch.column(k).to_pylist() for k in (0, 1))
            _, joined, found = _super_kmers(batch.column(2), frequent)
            for key, text, start, windows, low, high in zip(*(x.tolist() for x in found)):
                words = joined[low:high]
                times = seen.get(words, 0)
                if times < 2:
                    if held > REMEMBERED:
                        seen.clear()
                        held = 0
                    if not times:
                        held += len(words) + 100
                    seen[words] = times + 1
                    size += high - low
                    gathered[key % buckets].append((key >> 32, h1[text], h2[text], start, windows, words))
                else:
                    # Known to be repeated: only where it is travels on, to buckets in turn.
                    spread += 1
                    gathered[spread % buckets].append((0, h1[text], h2[text], start, windows, None))
                size += 100
            if size > GATHERED:
                yield out()
                size = 0
        if gathered:
            yield out()

    return run


def _repeated(packed: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of super-k-mers, and for each word whether a window that starts there has an equal one."""
    w = Words(packed)
    marks = np.zeros(len(w.hash), bool)
    at = _starts(w, WINDOW)
    if not len(at):
        return w, marks
    rolled = _rolled(w, at)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    alike = same[1:] | same[:-1]
    places, opens = at[order[alike]], ~same[:-1][alike]
    data = w.data.tobytes()
    low, high = w.starts[places].tolist(), w.ends[places + WINDOW - 1].tolist()
    group: dict[bytes, int] = {}
    yes = []
    for place, new, a, b in zip(places.tolist(), opens.tolist(), low, high):
        if new:
            group = {}
        text = data[a:b]
        other = group.setdefault(text, place)
        if other != place:
            yes += (place, other)
    marks[yes] = True
    return w, marks


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, payload) to (h1, h2, low, high): word intervals that repeated windows cover."""
    form = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def bucket(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(parts).combine_chunks()
        known = rows.filter(rows["words"].is_null())
        if len(known):
            start = known["start"].to_numpy()
            yield pa.RecordBatch.from_arrays([known["h1"].combine_chunks(), known["h2"].combine_chunks(), pa.array(start, pa.int32()), pa.array(start + known["windows"].to_numpy() + WINDOW - 1, pa.int32())], schema=form)
        rows = rows.filter(rows["words"].is_valid()).sort_by("key")
        keys = rows["key"].to_numpy()
        sizes = np.cumsum(pa.compute.binary_length(rows["words"]).to_numpy().astype(np.int64))
        low = 0
        while low < len(rows):
            high = int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SORTED, "right"))
            high = int(np.searchsorted(keys, keys[min(high, len(rows) - 1)], "right")) if high < len(rows) else len(rows)
            part = rows.slice(low, high - low).combine_chunks()
            low = high
            packed = part["words"].combine_chunks()
            w, marks = _repeated((packed if isinstance(packed, pa.Array) else packed.chunk(0)).cast(pa.string()))
            hit = np.flatnonzero(marks)
            if not len(hit):
                continue
            row = w.text[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            row = row[first]
            start = part["start"].to_numpy()[row] + hit[first] - w.first[row]
            yield pa.RecordBatch.from_arrays([pa.array(part["h1"].to_numpy()[row]), pa.array(part["h2"].to_numpy()[row]), pa.array(start, pa.int32()), pa.array(start + hit[last] - hit[first] + WINDOW, pa.int32())], schema=form)

    for t in key_groups(batches, 1):
        number = t["bucket"].to_numpy()
        parts: list[pa.Table] = []
        for k, p in enumerate(t["payload"]):
            if k and number[k] != number[k - 1]:
                yield from bucket(parts)
                parts = []
            parts.append(pa.ipc.open_stream(p.as_buffer()).read_all())
        if parts:
            yield from bucket(parts)


def _remove(digests: bool):
    """(id, text, lows, highs) to (id, n_words, n_removed, kept text or its digest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, lows, highs in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode("utf-8").split()
                total.append(len(words))
                if lows.is_valid:
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, lows.values.to_numpy(), 1)
                    np.add.at(change, highs.values.to_numpy(), -1)
                    words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                removed.append(total[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digests else out.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def _names(id_col: str, text: Column) -> list[Column]:
    """128 bits that name a row by its id and text: repeated rows share them, and lose the same words."""
    return [F.xxhash64(F.col(id_col), text).alias("h1"), F.xxhash64(F.lit("second"), text, F.col(id_col)).alias("h2")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row; kept is the text of the words that stay, joined by blanks, or with ``digests`` its SHA-256.

    Runs of words that occur ``frequent`` times or more are no minimisers, which changes no result. Null texts have no words; texts shorter than a window lose none; a repeated row's windows start elsewhere too, so it loses all of them.
    Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs, size = frequent_runs(docs.select(text.alias("text")), tables, frequent)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    dealt = docs.select(*_names(id_col, text), text.alias("text")).mapInArrow(_deal(_even_keys(partitions), runs), "bucket int, payload binary")
    spans = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "h1 long, h2 long, low int, high int")
    # A text repeated a million times has each of its intervals once.
    spans = tables.keep(spans.distinct().groupBy("h1", "h2").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")))
    rows = docs.select(*_names(id_col, text), F.col(id_col).alias("id"), text.alias("text"))
    met = rows.join(spans, ["h1", "h2"], "left").select("id", "text", "lows", "highs")
    form = StructType([StructField("id", docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return met.mapInArrow(_remove(digests), form).withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), digests=True).withColumnRenamed("kept", "kept_sha256")
