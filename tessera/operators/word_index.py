"""An index of a corpus by word ids, kept in a folder: built once, loaded and counted many times without its words.

A version of the index is a folder with the vocabulary (word, id, n), the records (rec, ids) and the postings (id, rec, pos), the last two split by
a bucket of the id or record, and a header of one row: format, bucket count, and the numbers of records, words and tokens. A version is written beside the
others and counts from the moment its name stands in the log (``sources.manifest``), so readers see whole versions only. N-grams are counted as
packed ids: a long for one or two words, two longs for up to four, never strings; what goes through the shuffle are sorted, compressed runs of them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoints, ship
from ..sources.manifest import Manifest
from .ngrams import _count_sql, vocabulary, word_arrays

FORMAT = 1
#: Ids take so many bits of a packed long, so two fit; 0 stands for none.
ID_BITS = 31
#: Tokens whose different words, or n-grams, are told apart before they are sent; n-grams that are added up at once; tokens of a bucket that are sorted at once, on average.
CHUNK, PART, GROUP = 1 << 20, 1 << 22, 1 << 20


@dataclass(frozen=True)
class WordIndex:
    header: dict
    vocabulary: DataFrame
    records: DataFrame
    postings: DataFrame


def _gathered(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The batches as tables of about ``CHUNK`` entries of a list column."""
    waiting, held = [], 0
    for b in batches:
        if b.num_rows:
            waiting.append(b)
            held += len(b.column(column).flatten())
        if held >= CHUNK:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of a combined list column one after another, and the bounds of its rows."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    return one.flatten(), np.append(0, np.cumsum(one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec, words) to (rec, chunk, words, counts, ids): for each chunk of records a row with its different words and their counts, and each record with its words as places in that row. Empty records are left out."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 33
    for chunk, t in enumerate(_gathered(batches, 1)):
        flat, bounds = _lists(t.column(1))
        coded = flat.dictionary_encode()
        counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        full = np.flatnonzero(np.diff(bounds))
        recs = t.column(0).combine_chunks()
        recs = recs.chunk(0) if isinstance(recs, pa.ChunkedArray) else recs
        n, kept = len(full), np.append(bounds[full], bounds[-1]).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(1, recs.type), recs.take(pa.array(full))]), pa.array(np.full(n + 1, first + chunk), pa.int64()), pa.concat_arrays([one(coded.dictionary), pa.nulls(n, pa.list_(coded.dictionary.type))]),
                pa.concat_arrays([one(pa.array(counts, pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]), pa.concat_arrays([pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(kept), coded.indices)]),
            ],
            names=["rec", "chunk", "words", "counts", "ids"],
        )


def _sorted_by_bucket(buckets: int, salt: int):
    """(rec, ids) to (bucket, salt, tokens): for each chunk of records the (id, rec, pos) of a bucket in order of the ids, as a compressed Arrow stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId()
        for chunk, t in enumerate(_gathered(batches, 1)):
            flat, bounds = _lists(t.column(1))
            ids = flat.to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(t)), np.diff(bounds))
            order = np.lexsort((ids, ids % buckets))
            tokens = pa.table({"id": pa.array(ids[order], pa.int32()), "rec": t.column(0).take(pa.array(rows[order])), "pos": pa.array((np.arange(len(ids)) - bounds[rows])[order], pa.int32())}).combine_chunks()
            cuts = np.searchsorted((ids % buckets)[order], np.arange(buckets + 1))
            held, out = np.flatnonzero(np.diff(cuts)), []
            for b in held:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, tokens.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(tokens.slice(cuts[b], cuts[b + 1] - cuts[b]))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.full(len(held), (first + chunk) % salt), pa.int32()), pa.array(out, pa.binary())], names=["bucket", "salt", "tokens"])

    return run


def _postings(t: pa.Table) -> pa.Table:
    """One group of such rows to its tokens, in order of the ids."""
    found = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in t.column("tokens").to_pylist()])
    found = found.take(pa.array(np.argsort(found.column("id").to_numpy(), kind="stable")))
    return found.append_column("bucket", pa.array(np.full(len(found), t.column("bucket")[0].as_py()), pa.int32()))


def build_index(records: DataFrame, path: str, rec: str, text_col: str = "text", buckets: int = 64) -> int:
    """Writes an index of ``records`` as a new version in ``path`` and gives the version's number.

    Records with equal or null keys stay apart, as they are read, but share the name in ``rec``. More than 2 ** 31 - 1 different words raise.
    Words get their ids by way of the different words of each chunk of records, and postings are sent as sorted, compressed runs, so no shuffle holds a row for each token.
    """
    spark = records.sparkSession
    ship(spark)
    ensure_checkpoints(spark)
    log = Manifest(spark, path)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    arrays = word_arrays(records, text_col, [rec]).select(F.col(rec).alias("rec"), "words")
    kind = arrays.schema["rec"].dataType.simpleString()
    arrays.mapInArrow(_local, f"rec {kind}, chunk long, words array<string>, counts array<long>, ids array<int>").write.parquet(f"{folder}/words")
    local = spark.read.parquet(f"{folder}/words")
    dictionaries = local.where("words IS NOT NULL")
    counts = dictionaries.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    vocabulary(dictionaries.select(F.explode("words").alias("word"))).join(counts, "word").select("word", "id", "n").write.parquet(f"{folder}/vocabulary")
    known = spark.read.parquet(f"{folder}/vocabulary")
    words = known.count()
    if words >= 1 << ID_BITS:
        raise ValueError("more words than ids")
    named = dictionaries.select("chunk", F.posexplode("words").alias("at", "word")).join(known.select("word", F.col("id").cast("int").alias("id")), "word")
    codes = named.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("codes"))
    coded = local.where("ids IS NOT NULL").select("rec", "chunk", "ids").join(codes.hint("shuffle_hash"), "chunk")
    coded.select("rec", F.transform("ids", lambda i: F.get("codes", i)).alias("ids")).write.parquet(f"{folder}/records")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    # A bucket is dealt to several groups, as one word may fill most of it.
    salt = max(1, -(-total.first()["tokens"] // (buckets * GROUP)))
    sent = spark.read.parquet(f"{folder}/records").mapInArrow(_sorted_by_bucket(buckets, salt), "bucket int, salt int, tokens binary")
    sent.groupBy("bucket", "salt").applyInArrow(_postings, f"id int, rec {kind}, pos int, bucket int").write.partitionBy("bucket").parquet(f"{folder}/postings")
    sizes = records.agg(F.count(F.lit(1)).alias("records")).join(total, F.lit(True))
    sizes.select(F.lit(FORMAT).alias("format"), F.lit(buckets).alias("buckets"), "records", F.lit(words).alias("words"), "tokens").coalesce(1).write.parquet(f"{folder}/header")
    return log.publish({"kind": "word index", "folder": folder})


def load_index(spark: SparkSession, path: str, version: int | None = None) -> WordIndex:
    """The index of a version, the last one if none is named. Raises if there is none or its format is another one."""
    entry = Manifest(spark, path).entry(version)
    header = spark.read.parquet(f"{entry['folder']}/header").first().asDict()
    if header["format"] != FORMAT:
        raise ValueError(f"index format {header['format']}, not {FORMAT}")
    read = lambda t: spark.read.parquet(f"{entry['folder']}/{t}")
    return WordIndex(header, read("vocabulary"), read("records"), read("postings"))


def _grams(flat: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """The n-grams within rows of ids as columns of longs, two ids in each."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(flat)) + n <= ends)
    one = lambda k: flat[at + k].astype(np.int64)
    return [one(k) << ID_BITS | one(k + 1) if k + 1 < n else one(k) for k in range(0, n, 2)]


def _counted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows, sorted, and how often each stands there (or the sums of ``counts``)."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, np.zeros(0, np.int64)
    changes = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    bounds = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(order)]])
    sums = np.diff(bounds) if counts is None else np.add.reduceat(counts[order], bounds[:-1])
    return [c[bounds[:-1]] for c in columns], sums


def _pack(columns: list[np.ndarray]) -> bytes:
    """Longs, the first ones rising, by differences and planes of bytes, compressed."""
    planes = np.stack([np.diff(columns[0], prepend=0), *columns[1:]]).astype("<i8")
    return zlib.compress(planes.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), 1)


def _unpack(blob: bytes, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(width, 8, -1)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return [np.cumsum(columns[0]), *columns[1:]]


def _share(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The part of each n-gram, from all of its ids."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(parts)).astype(np.int64)


def count_ids(index: WordIndex, n: int, least: int = 1) -> DataFrame:
    """(i1 .. in, n): the n-grams, as ids, that occur at least ``least`` times.

    Each chunk of records counts its own n-grams and sends them sorted and compressed, a row for each chunk and part; a part, of about ``PART`` n-grams at most, is added up at once.
    """
    width, parts = (n + 1) // 2, max(1, -(-index.header["tokens"] // PART))
    mask = (1 << ID_BITS) - 1

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, 0):
            flat, bounds = _lists(t.column(0))
            columns, counts = _counted(_grams(flat.to_numpy(zero_copy_only=False), bounds, n))
            part = _share(columns, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            held = np.flatnonzero(np.diff(cuts))
            rows = [_pack([c[order[cuts[p] : cuts[p + 1]]] for c in (*columns, counts)]) for p in held]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(rows, pa.binary())], names=["part", "grams"])

    def added(t: pa.Table) -> pa.Table:
        found = [_unpack(blob, width + 1) for blob in t.column("grams").to_pylist()]
        found = [np.concatenate(c) for c in zip(*found)]
        columns, counts = _counted(found[:-1], found[-1])
        kept = counts >= least
        columns, counts = [c[kept] for c in columns], counts[kept]
        ids = [columns[k // 2] >> ID_BITS if k % 2 == 0 and k + 1 < n else columns[k // 2] & mask for k in range(n)]
        return pa.table([*[pa.array(i, pa.int32()) for i in ids], pa.array(counts, pa.int64())], names=[*[f"i{k + 1}" for k in range(n)], "n"])

    ship(index.records.sparkSession)
    sent = index.records.select("ids").mapInArrow(chunks, "part int, grams binary")
    return sent.groupBy("part").applyInArrow(added, ", ".join(f"i{k + 1} int" for k in range(n)) + ", n long")


def spell(index: WordIndex, coded: DataFrame, n: int) -> DataFrame:
    """(w1 .. wn, n) of counted ids: the vocabulary is joined to what is left after counting."""
    for k in range(n):
        coded = coded.join(index.vocabulary.select(F.col("id").cast("int").alias(f"i{k + 1}"), F.col("word").alias(f"w{k + 1}")), f"i{k + 1}")
    return coded.select(*[f"w{k + 1}" for k in range(n)], "n")


def occurrences(index: WordIndex, words: list[str]) -> DataFrame:
    """(word, rec, pos) of a few words: only the buckets of their ids are read."""
    ids = index.vocabulary.where(F.col("word").isin(words)).select("word", F.col("id").cast("int").alias("id"))
    found = [(r["word"], r["id"]) for r in ids.collect()]
    wanted = index.postings.where(F.col("bucket").isin(sorted({i % index.header["buckets"] for _, i in found})) & F.col("id").isin([i for _, i in found]))
    return wanted.join(ids, "id").select("word", "rec", "pos")


def _built(spark, sf_dir) -> WordIndex:
    from ..streaming.incremental import _folder

    path = _folder(spark, "index")
    build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "doc_id")
    return load_index(spark, path)


def q_counts(n, least):
    def run(spark, sf_dir):
        index = _built(spark, sf_dir)
        return spell(index, count_ids(index, n, least), n)

    return run


def q_occurrences(spark, sf_dir):
    """Where two words stand, read from their buckets."""
    return occurrences(_built(spark, sf_dir), ["the", "of"])


QUERIES = {"index_2_counts": q_counts(2, 2), "index_3_counts": q_counts(3, 2), "index_occurrences": q_occurrences}
SQL = {
    "index_2_counts": _count_sql(2, 2),
    "index_3_counts": _count_sql(3, 2),
    "index_occurrences": r"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents) SELECT w[i] AS word, doc_id AS rec, (i - 1)::INT AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN ('the', 'of')",
}
