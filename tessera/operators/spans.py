"""Span lattices: spans(doc, start, end, score, weight, text, meta), positions counted over non-blank characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import bounded, spread

#: Bytes of texts that are split into words at once, and pairs of words that go out at once.
SPLIT, PAIRS = 1 << 22, 1 << 16
OPS = ("add", "max", "min", "product", "average", "none")


def build(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A span for each word between blanks, score and weight 1."""
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    exploded = docs.select(F.col(id_col).alias("doc"), F.posexplode(words).alias("pos", "text"))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int")
    out = exploded.withColumn("start", at).withColumn("end", (F.col("start") + F.length("text") - 1).cast("int"))
    return out.select("doc", "start", "end", F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"), "text", F.create_map().cast("map<string,string>").alias("meta"))


def from_json(specs: DataFrame, doc_col: str, spec_col: str) -> DataFrame:
    """Spans from JSON arrays of {start, end, score, weight, text, meta}; score and weight are 1 where missing."""
    kind = "array<struct<start:int,end:int,score:double,weight:double,text:string,meta:map<string,string>>>"
    s = specs.select(F.col(doc_col).alias("doc"), F.inline(F.from_json(spec_col, kind)))
    return s.withColumns({"score": F.coalesce("score", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(1.0))})


def _combined(op: str, c: str) -> Column:
    return {
        "add": F.sum(c), "max": F.max(c), "min": F.min(c), "average": F.avg(c), "none": F.first(c),
        "product": F.when(F.min(F.abs(c)) == 0, 0.0).otherwise(F.exp(F.sum(F.log(F.abs(c)))) * F.when(F.sum((F.col(c) < 0).cast("int")) % 2 == 1, -1.0).otherwise(1.0)),
    }[op]


def combine(spans: DataFrame, score: str = "add", weight: str = "max") -> DataFrame:
    """One span for equal (doc, start, end, text); scores and weights by the operations."""
    return spans.groupBy("doc", "start", "end", "text").agg(_combined(score, "score").alias("score"), _combined(weight, "weight").alias("weight"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.map_entries("meta"))))).alias("meta"))


def merge_adjacent(left: DataFrame, right: DataFrame, score: str = "add") -> DataFrame:
    """Spans of ``left`` followed at once by spans of ``right`` as longer spans: an equi-join on (doc, end + 1)."""
    r = right.select("doc", F.col("start").alias("_at"), F.col("end").alias("_end"), F.col("score").alias("_score"), F.col("weight").alias("_weight"), F.col("text").alias("_text"))
    met = left.withColumn("_at", F.col("end") + 1).join(r, ["doc", "_at"])
    value = {"add": F.col("score") + F.col("_score"), "max": F.greatest("score", "_score"), "min": F.least("score", "_score"), "product": F.col("score") * F.col("_score"), "average": (F.col("score") + F.col("_score")) / 2, "none": F.col("score")}[score]
    return met.select("doc", "start", F.col("_end").alias("end"), value.alias("score"), F.greatest("weight", "_weight").alias("weight"), F.concat_ws(" ", "text", "_text").alias("text"), "meta")


def _neighbours(split: int, most: int):
    """Texts (doc, text) to (doc, start, end, text), the pairs of words that follow one another, in batches of ``most`` at most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
            part = np.cumsum(sizes) // split
            for low, high in zip(cuts := np.flatnonzero(np.diff(part, prepend=-1)), [*cuts[1:], len(part)], strict=True):
                words = pc.ascii_split_whitespace(batch.column(1).slice(low, high - low))
                rows = np.repeat(np.arange(low, high), np.array(pc.fill_null(pc.list_value_length(words), 0)))
                flat = words.flatten()
                some = pc.not_equal(flat, "")
                flat, rows = flat.filter(some), rows[np.array(some)]
                # Characters of all words before, over the whole piece; a text's own begin where its first word does.
                ends = np.cumsum(np.array(pc.utf8_length(flat), dtype=np.int64))
                starts = np.concatenate([[0], ends])[:-1]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                before = np.repeat(starts[first], np.diff(np.append(first, len(rows))))
                pairs = np.flatnonzero(rows[1:] == rows[:-1])
                for k in range(0, len(pairs), most):
                    at = pairs[k : k + most]
                    text = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), " ")
                    place = [pa.array((x - before[at]).astype(np.int32)) for x in (starts[at], ends[at + 1] - 1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), *place, text], names=["doc", "start", "end", "text"])

    return run


def merge_words(docs: DataFrame, id_col: str, text_col: str, split: int = SPLIT, most: int = PAIRS) -> DataFrame:
    """(doc, start, end, score, text): what ``merge_adjacent`` makes of the spans of ``build`` by adding scores, without a join: neighbours stand in one text, so no word leaves its row.

    Texts that share an id are one lattice: words of the same number follow those of the number before, whichever text they are from, and what
    stands before a word is counted over all the texts, the other words of its own number with it. Only these texts are shuffled. Null ids take no part.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    shared = bounded(own.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc"))
    form = T.StructType([own.schema["doc"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
    pairs = spread(own).join(shared, "doc", "left_anti").select("doc", "text").mapInArrow(_neighbours(split, most), form)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    s = own.join(shared, "doc", "left_semi").select("doc", F.posexplode(words).alias("k", "text"))
    so_far = Window.partitionBy("doc").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("start", (F.sum(F.length("text")).over(so_far) - F.length("text")).cast("int"))
    r = s.select("doc", (F.col("k") - 1).alias("k"), (F.col("start") + F.length("text") - 1).alias("end"), F.col("text").alias("_text"))
    met = s.join(r, ["doc", "k"]).select("doc", "start", "end", F.concat_ws(" ", "text", "_text").alias("text"))
    return pairs.unionByName(met).select("doc", "start", "end", F.lit(2.0).alias("score"), "text")


def order() -> list[Column]:
    """Start, longer ones first, better scores and weights first."""
    return [F.col("start"), F.desc("end"), F.desc("score"), F.desc("weight")]


def set_meta(spans: DataFrame, key: str, value: Column) -> DataFrame:
    kept = F.map_filter("meta", lambda k, v: k != key)
    return spans.withColumn("meta", F.map_concat(kept, F.create_map(F.lit(key), value)))


def clear_meta(spans: DataFrame, key: str | None = None) -> DataFrame:
    """Spans without a key's metadata, or without any."""
    return spans.withColumn("meta", F.map_filter("meta", lambda k, v: (k != key) if key is not None else F.lit(False)))


def copy_meta(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``target`` with the metadata (of some keys, or all) of the spans of ``source`` at the same place; what is copied replaces what is there. Several spans at one place
    give one value of a key, the greatest.
    """
    entries = source.select("doc", "start", "end", F.explode("meta").alias("k", "v"))
    entries = entries if keys is None else entries.where(F.col("k").isin(keys))
    found = entries.groupBy("doc", "start", "end", "k").agg(F.max("v").alias("v")).groupBy("doc", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_more"))
    met = target.join(found, ["doc", "start", "end"], "left")
    kept = F.map_filter("meta", lambda k, v: ~F.array_contains(F.map_keys("_more"), k))
    return met.withColumn("meta", F.when(F.col("_more").isNull(), F.col("meta")).otherwise(F.map_concat(kept, "_more"))).select(*target.columns)


def text_of(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(doc, first, last) with ``text``, the words of the spans that lie in or reach into the range, in order, and ``words``, their number; ranges that none reaches have an empty text.

    Spans are those of words; longer ones beside them would repeat what they cover.
    """
    wanted = ranges.select("doc", "first", "last").distinct()
    met = spans.join(wanted, "doc").where((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")))
    found = met.groupBy("doc", "first", "last").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_s"))
    on = ["doc", "first", "last"]
    return ranges.join(found, on, "left").select(*ranges.columns, F.coalesce(F.array_join(F.transform("_s", lambda s: s["text"]), " "), F.lit("")).alias("text"), F.coalesce(F.size("_s"), F.lit(0)).alias("words"))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents whose lattices cover the same characters."""
    end = lambda df, n: df.groupBy("doc").agg(F.max("end").alias(n))
    return end(a, "a").join(end(b, "b"), "doc").select("doc", (F.col("a") == F.col("b")).alias("compatible"))


def _spans(spark, sf_dir):
    return build(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def q_build(spark, sf_dir):
    return _spans(spark, sf_dir).select("doc", "start", "end", "text")


def q_combine(spark, sf_dir):
    s = _spans(spark, sf_dir)
    grouped = s.withColumn("start", F.lit(0)).withColumn("end", F.lit(0))
    return combine(grouped, "add", "product").select("doc", "text", "score", "weight")


def q_merge(spark, sf_dir):
    return merge_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def q_texts(spark, sf_dir):
    """What each document says from its tenth character to its sixtieth, and around its hundredth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranges = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.lit(9).alias("first"), F.lit(59).alias("last")), F.struct(F.lit(99).alias("first"), F.lit(99).alias("last")))).alias("r")).select("doc", "r.*")
    return text_of(_spans(spark, sf_dir), ranges)


_B = r"WITH w AS (SELECT doc_id AS doc, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), p AS (SELECT doc, unnest(w) AS text, generate_subscripts(w, 1) AS k FROM w), s AS (SELECT doc, k, text, (sum(length(text)) OVER (PARTITION BY doc ORDER BY k) - length(text))::INT AS start FROM p)"
QUERIES = {"span_build": q_build, "span_combine": q_combine, "span_merge": q_merge, "span_texts": q_texts}
SQL = {
    "span_texts": f"{_B}, r AS (SELECT doc_id AS doc, unnest([9, 99]) AS first, unnest([59, 99]) AS last FROM documents) SELECT r.doc, first, last, coalesce(string_agg(s.text, ' ' ORDER BY s.start), '') AS text, count(s.text)::INT AS words FROM r LEFT JOIN s ON s.doc = r.doc AND s.start <= last AND s.start + length(s.text) - 1 >= first GROUP BY r.doc, first, last",
    "span_build": f"{_B} SELECT doc, start, (start + length(text) - 1)::INT AS end, text FROM s",
    "span_combine": f"{_B} SELECT doc, text, count(*)::DOUBLE AS score, 1.0::DOUBLE AS weight FROM s GROUP BY ALL",
    "span_merge": f"{_B} SELECT a.doc, a.start, (b.start + length(b.text) - 1)::INT AS end, 2.0::DOUBLE AS score, a.text || ' ' || b.text AS text FROM s a JOIN s b ON a.doc = b.doc AND b.k = a.k + 1",
}
