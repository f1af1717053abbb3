"""Functions of a user's own over n-grams, as table functions whose columns are chosen when a query is analysed, and over spans, in Arrow batches.

A function visits the n-grams of a record one after the other, gives rows for them and may stop early; or it sees spans in order, document by document, and lets them go, changes them or
puts others in their place. Both run where the data is, in the tasks of a query; between calls nothing is held but what the function itself keeps for a record or document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from ..plans.session import ship
from .ngrams import _W, word_arrays
from .spans import build


class STOP:
    """What a visitor gives to end its record; the class itself, which is the same one in every process."""


def ngram_function(visit: Callable[[list[str], dict], object]):
    """A table function (words, n, columns) for ``visit``(gram, state): it gives None, a tuple for a row, a list of them, or ``STOP``.

    ``columns`` is a schema as JSON, fixed for a query; ``state`` is a dict of the record's own. Null words have no n-grams, nor has a record shorter than n.
    """

    class Visit:
        @staticmethod
        def analyze(words: AnalyzeArgument, n: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            if not n.isConstantExpression or not columns.isConstantExpression or n.value < 1:
                raise ValueError("n and columns must be constants, n at least 1")
            return AnalyzeResult(StructType.fromJson(json.loads(columns.value)))

        def eval(self, words: list[str], n: int, columns: str):
            state: dict = {}
            for k in range(len(words or ()) - n + 1):
                given = visit(words[k : k + n], state)
                if given is STOP:
                    return
                if given is not None:
                    yield from given if isinstance(given, list) else [given]

    return udtf(Visit)


def visit_ngrams(arrays: DataFrame, n: int, columns: str, visit: Callable[[list[str], dict], object]) -> DataFrame:
    """The rows that ``visit`` gives for the n-grams of arrays(words), beside the record's other columns."""
    ship(arrays.sparkSession)
    return arrays.lateralJoin(ngram_function(visit)(F.col("words").outer(), F.lit(n), F.lit(StructType.fromDDL(columns).json()))).drop("words")


def rewrite_spans(spans: DataFrame, rewrite: Callable[[dict], Iterable[dict] | dict | bool | None]) -> DataFrame:
    """``spans`` after ``rewrite``(span) has seen each of them, in order of document, start and longest first: it gives True (the span stays), None or False (it goes), another span, or several.

    Spans go to Python in Arrow batches and come back as columns.
    """
    ship(spans.sparkSession)
    names = spans.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for values in zip(*(_plain(c) for c in b.columns)):
                given = rewrite(dict(zip(names, values)))
                for span in [values] if given is True else () if not given else [given] if isinstance(given, dict) else given:
                    for column, value in zip(out, span if span is values else [span[c] for c in names]):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([_column(v, f.type) for v, f in zip(out, b.schema)], schema=b.schema)

    return spans.repartition("doc").sortWithinPartitions("doc", "start", F.desc("end"), "text").mapInArrow(run, spans.schema)


def _plain(column: pa.Array) -> list:
    """Values as a user's function sees them: maps are dicts."""
    values = column.to_pylist()
    return [None if v is None else dict(v) for v in values] if pa.types.is_map(column.type) else values


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else list(v.items()) for v in values] if pa.types.is_map(kind) else values, kind)


def _alliterates(gram: list[str], state: dict):
    """Pairs of words with one beginning; a record ends after its third."""
    if state.get("n", 0) == 3:
        return STOP
    if gram[0][:1] == gram[1][:1] and gram[0] != gram[1]:
        state["n"] = state.get("n", 0) + 1
        return gram[0], gram[1], len(gram[0]) + len(gram[1])
    return None


def _shortened(span: dict):
    """Short words go, long ones are cut in two, others stay."""
    n = len(span["text"])
    if n < 4:
        return False
    if n < 12:
        return True
    return [span | {"end": span["start"] + 5, "text": span["text"][:6]}, span | {"start": span["start"] + 6, "text": span["text"][6:]}]


def q_ngrams(spark, sf_dir):
    """The first three alliterating pairs of each document."""
    arrays = word_arrays(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return visit_ngrams(arrays, 2, "w1 string, w2 string, letters int", _alliterates).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("w1").alias("w1"), F.sum("letters").alias("letters"))


def q_spans(spark, sf_dir):
    """The spans of the documents, rewritten."""
    found = rewrite_spans(build(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("doc", "start", "end", "text"), _shortened)
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start") + 1).alias("letters"), F.max("text").alias("last"))


QUERIES = {"ngram_visitor": q_ngrams, "span_rewriter": q_spans}
SQL = {
    "ngram_visitor": f"WITH {_W}, g AS (SELECT doc_id, i, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g WHERE w1[1] = w2[1] AND w1 <> w2) SELECT doc_id, count(*) AS n, max(w1) AS w1, sum(length(w1) + length(w2))::BIGINT AS letters FROM a WHERE k <= 3 GROUP BY doc_id",
    "span_rewriter": r"""WITH p AS (SELECT doc_id AS doc, unnest(w) AS text, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)), s AS (SELECT doc, text, (sum(length(text)) OVER (PARTITION BY doc ORDER BY k) - length(text)) AS start FROM p),
r AS (SELECT doc, start, start + length(text) - 1 AS end, text FROM s WHERE length(text) BETWEEN 4 AND 11 UNION ALL SELECT doc, start, start + 5, text[1:6] FROM s WHERE length(text) > 11 UNION ALL SELECT doc, start + 6, start + length(text) - 1, text[7:] FROM s WHERE length(text) > 11)
SELECT doc, count(*) AS n, sum(start)::BIGINT AS starts, sum("end" - start + 1)::BIGINT AS letters, max(text) AS last FROM r GROUP BY doc""",
}
