"""Chat formatting by columnar byte assembly.

A turn becomes ``### <role>: <text></turn>`` and a line feed. In texts "\\", "#" and "<" get a backslash
before them (in roles ":" too), so no marker can appear inside a text, and dropping each backslash that
stands before a character gives the text back.

Batches arrive sorted by conversation and turn. For all turns of a batch at once numpy computes the
lengths of the segments (marker, role, marker, text, marker), their cumulative offsets and the scatter
indices, and copies everything into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
#: The role whose texts carry the loss.
ASSISTANT = "assistant"
#: Bytes of text that are formatted at once.
PIECE = 1 << 26
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def _assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Formatted conversations of rows that are sorted; each conversation is whole."""
    role, text = pc.fill_null(role, ""), pc.fill_null(text, "")
    loss = pc.equal(role, ASSISTANT).to_numpy(zero_copy_only=False)
    role = pc.replace_substring_regex(role, r"([\\#<:])", r"\\\1")
    text = pc.replace_substring_regex(text, r"([\\#<])", r"\\\1")
    n = len(text)
    role_data, role_at = _bytes_of(role)
    text_data, text_at = _bytes_of(text)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(MIDDLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, 4]), np.uint8)
    for k, mark in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        moved = np.repeat(starts[:, k] - at[:-1], lengths[:, k])
        out[moved + np.arange(at[0], at[-1])] = data[at[0] : at[-1]]
    keys = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    bounds = np.append(starts[first, 0], len(out))
    # Code points before each byte.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    of_turn = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    base = points[bounds[:-1]]
    begin, end = points[starts[:, 3]] - base[of_turn], points[ends[:, 3]] - base[of_turn]
    counts = np.append(0, np.cumsum(np.bincount(of_turn[loss], minlength=len(first))))
    # A column stays below 2 GB unless one conversation is larger, which no cell could hold.
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(x[loss], pa.int64())) for x in (begin, end)]
    turns = np.diff(np.append(first, n))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(turns, pa.int64()), formatted, *lists], names=["conv", "n_turns", "formatted", "loss_starts", "loss_ends"])


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []

    def whole(tables):
        """Formatted conversations, so many at once that their texts have about ``PIECE`` bytes; a longer one comes alone."""
        t = pa.concat_tables(tables)
        keys = pa.chunked_array(t["conv"]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(t))
        sizes = np.concatenate([[0], np.cumsum(sum(pc.fill_null(pc.binary_length(t[c]), 0).to_numpy().astype(np.int64) for c in ("role", "text")))])[first]
        low = 0
        while low < len(first) - 1:
            high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + PIECE, "right")) - 1)
            cols = [c.combine_chunks() for c in t.slice(first[low], first[high] - first[low]).columns]
            yield _assemble(*[c if isinstance(c, pa.Array) else c.chunk(0) for c in cols])
            low = high

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = t["conv"].combine_chunks()
        keys = (keys if isinstance(keys, pa.Array) else keys.chunk(0)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        held = waiting and waiting[-1]["conv"][-1].as_py() == t["conv"][0].as_py()
        if waiting and not held:
            yield from whole(waiting)
            waiting = []
        if last:
            yield from whole([*waiting, t.slice(0, last)])
            waiting = []
        waiting.append(t.slice(last))
    if waiting:
        yield from whole(waiting)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, n_turns, formatted, loss_starts, loss_ends): one row per conversation.

    Turns go by number, null first, equal ones by role and text; repeated rows stay. Null texts and roles are
    empty; rows with a null conversation are one conversation. The loss spans (code points) hold the texts of assistant
    turns. No rows give no rows; other columns are ignored. A conversation is one cell, so it must fit a task; very long texts are formatted whole, and few conversations with long ones at once.
    """
    ship(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "_turn", "role", "text").select("conv", "role", "text")
    kind = turns.schema[conv_col].dataType
    longs = T.ArrayType(T.LongType())
    form = T.StructType([T.StructField("conv", kind), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_starts", longs), T.StructField("loss_ends", longs)])
    return dealt.mapInArrow(_format, form).withColumnRenamed("conv", conv_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        turns, loss, n, chars, n_turns = [], [], [], [], []
        for formatted, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))):
            found = parse(formatted)
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest())
            under = "".join(unescape(formatted[s:e]) for s, e in zip(starts, ends))
            loss.append(hashlib.sha256(under.encode()).hexdigest())
            n.append(len(under))
            chars.append(len(formatted))
            n_turns.append(len(found))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_turns, pa.int64()), pa.array(turns, pa.string()), pa.array(n, pa.int64()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return format_conversations(turns.unionByName(more)).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SQL = r"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
c AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + length(text) + len(regexp_extract_all(text, '[\\#<]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
