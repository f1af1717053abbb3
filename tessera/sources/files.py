"""Readers and writers: lines, objects as JSON, frames, TF-IDF text files, step and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An object as JSON: frames with slots, facets and values.
FRAME_JSON = "struct<frame:string,slots:map<string,map<string,array<string>>>>"
#: Lines of a threshold list at most.
MOST_STEPS = 100_000


def lines(spark: SparkSession, path: str, glob: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A row for each line (or part up to ``delimiter``) of text files; compressed files by their ending, splits by Spark."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, **({"lineSep": delimiter} if delimiter else {}))


def canonical_lines(spark: SparkSession, path: str, glob: str | None = None, delimiter: str | None = None, upper: bool = False) -> DataFrame:
    """(value): the lines of ``lines`` in canonical form, tokens with one blank between; empty ones stay empty."""
    from ..functions.text import canonicalize

    return lines(spark, path, glob, delimiter).select(canonicalize(F.col("value"), upper).alias("value"))


def byte_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The lines that begin in [start, end) of each file: a line that begins before ``start`` belongs to an earlier range.

    For whole tables use ``lines``: Spark splits files by itself. This reads a range that something else names, one file a row.
    """
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("t"))
    each = text.select("path", F.posexplode(F.split("t", "\n")).alias("k", "raw"))
    at = F.sum(F.length("raw") + 1).over(Window.partitionBy("path").orderBy("k")) - F.length("raw") - 1
    found = each.withColumn("at", at).where((F.col("at") >= start) & (F.col("at") < end))
    return found.select("path", "at", F.decode(F.encode("raw", "ISO-8859-1"), "UTF-8").alias("value")).where("value != ''")


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length, modificationTime) of the files that fit; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Many small files as one table (path, text), to be kept as Parquet."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def decode_lines(content: Column, encoding: str) -> Column:
    """Lines of binary contents in one of the encodings the JVM knows: latin-1, latin-2, utf-8, utf-16, EUC."""
    names = {"latin-1": "ISO-8859-1", "latin-2": "ISO-8859-2", "utf-8": "UTF-8", "unicode": "UTF-16", "euc": "EUC-JP", "raw": "ISO-8859-1"}
    return F.split(F.decode(content, names.get(encoding.lower(), encoding)), r"\r?\n")


def replace_table(df: DataFrame, path: str, codec: str = "snappy") -> int:
    """The table as a new version in place of what is there; gives the version's number. Readers (``read_table``) see the old or the new one, whole.

    The rows are written beside the versions before and count from the entry in the log on (``manifest``), so a writer that dies changes nothing.
    """
    import uuid

    from .manifest import Manifest

    folder = f"data/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(f"{path}/{folder}")
    return Manifest(df.sparkSession, path).publish({"kind": "table", "folder": folder})


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table that ``replace_table`` wrote, the last one if none is named."""
    from .manifest import Manifest

    return spark.read.parquet(f"{path}/{Manifest(spark, path).entry(version)['folder']}")


def valid(text: Column) -> Column:
    """Whether a text can be read as an object, without building it."""
    return F.try_parse_json(text).isNotNull()


def object_type(text: Column) -> Column:
    """Type of an object in JSON: string, integer, float, list, struct, boolean, nil; null if it can't be read."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind == "VOID", "nil").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "struct").when(kind.isin("BIGINT"), "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
    )


def export_frames(fillers: DataFrame) -> DataFrame:
    """(frame, text): each frame as a JSON object {frame, slots: {slot: {facet: [values in order]}}}."""
    values = fillers.groupBy("frame", "slot", "facet").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v"))
    facets = values.groupBy("frame", "slot").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("facet", "v")))).alias("f"))
    slots = facets.groupBy("frame").agg(F.collect_list(F.struct("slot", "f")).alias("s"))
    return slots.select("frame", F.to_json(F.struct("frame", F.map_from_entries("s").alias("slots"))).alias("text"))


def import_frames(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """fillers(frame, slot, facet, pos, value) from JSON objects as ``export_frames`` writes them; unreadable ones are left out."""
    o = texts.select(F.from_json(text_col, FRAME_JSON).alias("o")).where("o.frame IS NOT NULL")
    slots = o.select("o.frame", F.explode("o.slots").alias("slot", "facets"))
    return slots.select("frame", "slot", F.explode("facets").alias("facet", "values")).select("frame", "slot", "facet", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def save_tfidf(stats: DataFrame, n_docs: int, path: str) -> None:
    """Text files with a line ``!!! documents vocabulary`` and lines ``term tf df``."""
    size = stats.count()
    head = stats.sparkSession.createDataFrame([(f"!!! {n_docs} {size}",)], "value string")
    head.unionByName(stats.select(F.concat_ws(" ", "term", "tf", "df").alias("value"))).write.mode("overwrite").text(path)


def load_tfidf(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(term_stats, documents)."""
    text = spark.read.text(path)
    head = text.where("value LIKE '!!! %'").select(F.split("value", " ")[1].cast("long")).first()
    parts = F.split("value", " ")
    stats = text.where("value NOT LIKE '!!! %' AND value != ''").select(parts[0].alias("term"), parts[1].cast("long").alias("tf"), parts[2].cast("long").alias("df"))
    return stats, head[0] if head else 0


def load_steps(spark: SparkSession, path: str) -> list[tuple[int, float]]:
    """(count, threshold) pairs, one in brackets on each line. They are few by nature; more than ``MOST_STEPS`` lines raise."""
    found = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r"\(\s*(\d+)\s+[-0-9.eE+]+\s*\)"), F.lit(1)).alias("c"), F.regexp_extract_all("value", F.lit(r"\(\s*\d+\s+([-0-9.eE+]+)\s*\)"), F.lit(1)).alias("t"))
    rows = found.limit(MOST_STEPS + 1).collect()
    if len(rows) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} lines of thresholds in {path}")
    return sorted((int(c), float(t)) for r in rows for c, t in zip(r["c"], r["t"]))


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """(text): a word or phrase on each line, as abbreviation lists have them."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text != '' AND NOT text LIKE ';%'").distinct()


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from ..plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:8]}"


def q_frames(spark, sf_dir):
    """Frames of the tables exported to text, written, read and imported again."""
    from ..operators.frames import nations

    path = _folder(spark, "frames")
    export_frames(nations(spark, sf_dir)).select("text").write.text(path, compression="gzip")
    return import_frames(lines(spark, path).withColumnRenamed("value", "text"))


def q_tfidf_file(spark, sf_dir):
    from ..operators.term_vectors import document_vectors, term_stats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = _folder(spark, "tfidf")
    save_tfidf(term_stats(document_vectors(docs)), docs.count(), path)
    return load_tfidf(spark, path)[0]


def q_objects(spark, sf_dir):
    """Properties of the events as objects: whether they can be read, and of what type they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", valid(F.col("props")).alias("valid"), object_type(F.col("props")).alias("type"))


def q_sniff(spark, sf_dir):
    from ..functions.scalars import sniff_encoding

    """Each document in five encodings, by what is made of it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ways = {"utf-8": F.encode("text", "UTF-8"), "marked": F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), "big": F.encode("text", "UTF-16BE"), "little": F.encode("text", "UTF-16LE"), "marked big": F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))}
    each = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("way"), v.alias("content")) for k, v in ways.items()])).alias("e")).select("e.*")
    return each.select("way", sniff_encoding(F.col("content")).alias("kind")).groupBy("way", "kind").agg(F.count(F.lit(1)).alias("n"))


from ..operators.frames import _F as _FRAMES  # noqa: E402

QUERIES = {"frame_roundtrip": q_frames, "tfidf_file_roundtrip": q_tfidf_file, "object_types": q_objects, "file_sniff": q_sniff}
SQL = {
    "frame_roundtrip": f"{_FRAMES} SELECT frame, slot, 'VALUE' AS facet, 0::BIGINT AS pos, value FROM f",
    "tfidf_file_roundtrip": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY term",
    "object_types": "SELECT event_id, json_valid(props) AS valid, CASE WHEN json_valid(props) THEN 'struct' END AS type FROM events",
    "file_sniff": r"""WITH k AS (SELECT 'utf-8' AS way, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'latin-1' ELSE 'ascii' END AS kind FROM documents UNION ALL SELECT 'marked', 'utf-8' FROM documents UNION ALL SELECT 'marked big', 'utf-16be' FROM documents
UNION ALL SELECT 'big', CASE WHEN text = '' THEN 'ascii' ELSE 'utf-16be' END FROM documents UNION ALL SELECT 'little', CASE WHEN text = '' THEN 'ascii' ELSE 'utf-16le' END FROM documents) SELECT way, kind, count(*) AS n FROM k GROUP BY ALL""",
}
