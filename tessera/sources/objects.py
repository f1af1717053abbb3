"""Objects in list syntax as tables: reading, printing, frames.

An object is a list ``(a b)``, a string in quotes, a number (``12``, ``1.5``, ``3/4``), a symbol (upper-cased, or as it is between bars), a structure ``#S(NAME :FIELD value)``, an
array ``#A(...)``, a sparse array ``#SpArr(index value ...)``, a queue ``#Q(...)``, a hash table ``#H(key value ...)``, a bit vector ``#*0101``, or a frame ``[NAME [SLOT [FACET value ...]]]``; ``'x`` is
(QUOTE x), and a semicolon begins a comment. Further syntax comes with readers for its first characters.

Files are read as lines, so Spark splits them where it likes. What stands before a split decides whether its first line begins inside a list, a string or a
symbol; each split is therefore first read as if it began in each of the three states, the outcomes (one small row for each split) are chained along a file, and a
second pass, which knows its beginning, joins the lines of each object. Only what a split begins and ends with is gathered by an aggregation, wherever the splits are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoints, ship

#: Blocks of files whose beginnings are sent to all tasks at most.
BLOCKS = 200_000
#: States in which a line can begin: outside of strings and bars, in a string, between bars.
PLAIN, STRING, BARS = range(3)
_MARK = re.compile(r'["|;]|[(\[]|[)\]]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r"""(\s+|;[^\n]*)|("(?:[^"\\]|\\.)*")|(\|[^|]*\|)|(\#(?:S|A|Q|H|SpArr)\()|(\#\*[01]*)|([()\[\]'])|([^\s()\[\]"|;']+)""", re.S)
_KINDS = {"#S(": "struct", "#A(": "array", "#Q(": "queue", "#H(": "hash", "#SpArr(": "sparse"}
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?\Z|[-+]?\.\d+(?:[eE][-+]?\d+)?\Z")


def scan(line: str, state: int) -> tuple[int, int, int]:
    """(state at the end, change of depth, lowest depth on the way) of a line that begins in a state."""
    depth = lowest = at = 0
    while True:
        if state == STRING:
            m = _STRING_END.match(line, at)
            if not m:
                return STRING, depth, lowest
            at, state = m.end(), PLAIN
        elif state == BARS:
            end = line.find("|", at)
            if end < 0:
                return BARS, depth, lowest
            at, state = end + 1, PLAIN
        m = _MARK.search(line, at)
        if not m or m[0] == ";":
            return PLAIN, depth, lowest
        at = m.end()
        if m[0] == '"':
            state = STRING
        elif m[0] == "|":
            state = BARS
        else:
            depth += 1 if m[0] in "([" else -1
            lowest = min(lowest, depth)


class Unreadable(ValueError):
    pass


def parse(text: str, readers: dict[str, Callable] | None = None) -> list:
    """All objects of a text, as JSON values: strings, numbers and lists as they are, everything else as {type: content}. ``readers`` maps a first character to a
    function of (text, position) that gives (JSON value, position after it). Nesting may be as deep as it likes.
    """
    stack, at = [("top", [])], 0

    def put(value):
        while stack[-1][0] == "quote":
            stack.pop()
            value = [{"symbol": "QUOTE"}, value]
        stack[-1][1].append(value)

    while at < len(text):
        if readers and text[at] in readers:
            value, at = readers[text[at]](text, at)
            put(value)
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"at {at}: {text[at : at + 20]!r}")
        at = m.end()
        blank, string, bars, opening, bits, sign, word = m.groups()
        if blank is not None:
            continue
        if string is not None:
            put(re.sub(r"(?s)\\(.)", r"\1", string[1:-1]))
        elif bars is not None:
            put({"symbol": bars[1:-1]})
        elif opening is not None:
            stack.append((_KINDS[opening], []))
        elif bits is not None:
            put({"bits": bits[2:]})
        elif sign == "'":
            stack.append(("quote", []))
        elif sign in ("(", "["):
            stack.append(("list" if sign == "(" else "frame", []))
        elif sign is not None:
            kind, items = stack.pop()
            if kind in ("top", "quote") or (kind == "frame") != (sign == "]"):
                raise Unreadable(f"{sign} at {m.start()}")
            put(_built(kind, items, any(k == "frame" for k, _ in stack)))
        else:
            put(_word(word))
    if len(stack) > 1:
        raise Unreadable(f"open {stack[-1][0]}")
    return stack[0][1]


def _word(word: str):
    if _NUMBER.match(word):
        return float(word) if re.search(r"[.eE]", word) else int(word)
    m = re.fullmatch(r"([-+]?\d+)/(\d+)", word)
    if m:
        return {"rational": [int(m[1]), int(m[2])]}
    return [] if word.upper() == "NIL" else {"symbol": word.upper()}


def _built(kind: str, items: list, inside: bool):
    if kind == "list":
        return items
    if kind in ("array", "queue"):
        return {kind: items}
    if kind in ("hash", "sparse"):
        if len(items) % 2:
            raise Unreadable(f"odd {kind}")
        return {kind: [items[k : k + 2] for k in range(0, len(items), 2)]}
    if kind == "struct":
        fields = items[1::2]
        if not items or len(items) % 2 == 0 or any(not isinstance(f, dict) or not f.get("symbol", "").startswith(":") for f in fields):
            raise Unreadable("malformed structure")
        return {"struct": items[0], "fields": [[f["symbol"][1:], v] for f, v in zip(fields, items[2::2])]}
    return {"part" if inside else "frame": items}


def kind_of(value) -> str:
    """The type of an object."""
    if isinstance(value, dict):
        return next(iter(value))
    return {str: "string", int: "integer", float: "float", list: "list"}[type(value)]


def show(value) -> str:
    """The text of an object, from which it is read again."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):
            out.append(v[0])
            continue
        if isinstance(v, str):
            out.append('"' + re.sub(r'(["\\])', r"\\\1", v) + '"')
        elif isinstance(v, (int, float)):
            out.append(repr(v))
        elif isinstance(v, dict) and "symbol" in v:
            plain = v["symbol"] == v["symbol"].upper() and re.fullmatch(r"[^\s()\[\]\"|;'#]+", v["symbol"]) and _word(v["symbol"]) == v
            out.append(v["symbol"] if plain else f"|{v['symbol']}|")
        elif isinstance(v, dict) and "rational" in v:
            out.append("%d/%d" % tuple(v["rational"]))
        elif isinstance(v, dict) and "bits" in v:
            out.append("#*" + v["bits"])
        else:
            kind = kind_of(v)
            items = v if kind == "list" else [v["struct"], *[x for f, y in v["fields"] for x in ({"symbol": ":" + f}, y)]] if kind == "struct" else v[kind]
            if kind in ("hash", "sparse"):
                items = [x for pair in items for x in pair]
            begin, end = ("[", "]") if kind in ("frame", "part") else ("(" if kind == "list" else next(o for o, k in _KINDS.items() if k == kind), ")")
            out.append(begin)
            parts = [(end,)]
            for k, x in enumerate(reversed(items)):
                parts += [x] if k == len(items) - 1 else [x, (" ",)]
            todo += parts
    return "".join(out)


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    """(first row, row after the last, (file, block)) of each block of a batch of lines (file, block, ...)."""
    import numpy as np

    files, blocks = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        yield low, high, (b.column(0)[low].as_py(), b.column(1)[low].as_py())


def _plain(lines: pa.Array) -> tuple[list, list]:
    """Of each line, whether it is free of quotes, bars and comments, so that it changes no state, and by how much its brackets then change the depth."""
    import pyarrow.compute as pc

    count = lambda marks: pc.add(*[pc.count_substring(lines, m) for m in marks])
    return pc.invert(pc.match_substring_regex(lines, '["|;]')), pc.subtract(count("(["), count(")]"))


def _outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, k, value), in order, to (file, block, states, depths): how each block ends, by the state in which it begins."""
    import numpy as np

    now, held = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([[s for s, _ in held]], pa.list_(pa.int32())), pa.array([[d for _, d in held]], pa.list_(pa.int64()))], names=["file", "block", "states", "depths"])

    for b in batches:
        if not b.num_rows:
            continue
        plain, change = (x.to_numpy(zero_copy_only=False) for x in _plain(b.column(3)))
        # Brackets of plain lines up to each line; only the other lines are read one by one.
        sums, others = np.append(0, np.cumsum(np.where(plain, change, 0))), np.flatnonzero(~plain)
        for low, high, key in _blocks(b):
            if key != now:
                if now:
                    yield out()
                now, held = key, [(s, 0) for s in range(3)]
            at = low
            for r in [*others[np.searchsorted(others, low) : np.searchsorted(others, high)].tolist(), high]:
                passed = int(sums[r] - sums[at])
                held = [(s, d + passed if s == PLAIN else d) for s, d in held]
                if r < high:
                    line = b.column(3)[r].as_py()
                    read = {s: scan(line, s) for s in {s for s, _ in held}}
                    held = [(read[s][0], d + read[s][1]) for s, d in held]
                at = r + 1 if r < high else r
    if now:
        yield out()


def _chained(blocks):
    """The outcomes of one file's blocks to (file, block, state, depth): how each begins."""
    import pandas as pd

    state, depth, rows = PLAIN, 0, []
    for r in blocks.sort_values("block").itertuples():
        rows.append((r.file, r.block, state, depth))
        state, depth = int(r.states[state]), depth + int(r.depths[state])
    return pd.DataFrame(rows, columns=["file", "block", "state", "depth"])


def _begins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, k, value, state, depth), in order, to (file, block, own, value, inner): the objects that begin in each block with the line where they do, and what goes before the first one (own is null).

    ``inner`` are objects after which another one begins in the block: they are whole.
    """
    now, own, text, rows = None, None, [], []

    def put(inner):
        if text:
            rows.append((*now, own, "\n".join(text), inner))

    def out():
        kinds = zip((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), ("file", "block", "own", "value", "inner"))
        return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (t, n) in enumerate(kinds)})

    for b in batches:
        if not b.num_rows:
            continue
        plain, change = (x.to_pylist() for x in _plain(b.column(3)))
        ks, lines = b.column(2).to_pylist(), b.column(3).to_pylist()
        for low, high, key in _blocks(b):
            if key != now:
                put(False)
                now, own, text, at, deep = key, None, [], b.column(4)[low].as_py(), b.column(5)[low].as_py()
            for r in range(low, high):
                if at == PLAIN and deep <= 0:
                    put(own is not None)
                    own, text, deep = ks[r], [], 0
                text.append(lines[r])
                if not plain[r]:
                    at, moved, _ = scan(lines[r], at)
                    deep += moved
                elif at == PLAIN:
                    deep += change[r]
        if rows:
            yield out()
            rows = []
    put(False)
    if rows:
        yield out()


def read_objects(spark: SparkSession, path: str, readers: dict[str, Callable] | None = None) -> DataFrame:
    """(file, line, number, type, value): every object of text files, in order of (file, line, number); ``value`` is JSON.

    ``line`` orders a file's lines, and an object has that of the line where the text read as one begins. What can't be read is one row of type ``unreadable`` with the text as a
    JSON string. Closing brackets too many end nothing. Empty files give no rows; an object, however many lines it has, is one cell.
    """
    ship(spark)
    ensure_checkpoints(spark)
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("k"), "value").checkpoint()
    # A block's lines stand in one partition, in order, as the reader gave them.
    outcomes = lines.mapInArrow(_outcomes, "file string, block long, states array<int>, depths array<long>")
    starts = outcomes.groupBy("file").applyInPandas(_chained, "file string, block long, state int, depth long")
    starts = starts.checkpoint()
    if starts.count() <= BLOCKS:
        # Each block's lines stay where they are, in order.
        begun = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        begun = lines.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "k")
    marked = begun.select("file", "block", "k", "value", "state", "depth").mapInArrow(_begins, "file string, block long, own long, value string, inner boolean")
    # Objects that may go on in later blocks, two rows of each block at most: what has no beginning belongs to the last one before it in the file.
    border = marked.where("NOT inner").select("file", "block", "own", "value").checkpoint()
    earlier = Window.partitionBy("file").orderBy("block", F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = border.withColumn("line", F.last("own", True).over(earlier))
    joined = placed.groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("own", F.lit(-1)).alias("own"), "value"))).alias("t"))
    whole = joined.select("file", "line", F.array_join(F.transform("t", lambda s: s["value"]), "\n").alias("text"))
    texts = marked.where("inner").select("file", F.col("own").alias("line"), F.col("value").alias("text")).unionByName(whole)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, number, kinds, values = [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                try:
                    found = [(kind_of(v), json.dumps(v, ensure_ascii=False)) for v in parse(text, readers)]
                except Unreadable:
                    found = [("unreadable", json.dumps(text, ensure_ascii=False))]
                for k, (kind, value) in enumerate(found):
                    at.append(row)
                    number.append(k)
                    kinds.append(kind)
                    values.append(value)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(number, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["file", "line", "number", "type", "value"])

    return texts.mapInArrow(run, "file string, line long, number int, type string, value string")


def print_objects(objects: DataFrame, value_col: str = "value") -> DataFrame:
    """(text): each object of a column of JSON values, as it is read again."""
    ship(objects.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else show(json.loads(v)) for v in b.column(0).to_pylist()], pa.string())], names=["text"])

    return objects.select(value_col).mapInArrow(run, "text string")


def frame_objects(fillers: DataFrame) -> DataFrame:
    """(value): fillers (frame, slot, facet, pos, value) as frames, a JSON value for each; fillers are strings."""
    symbol = lambda c: F.struct(F.col(c).alias("symbol"))
    text = lambda c: F.to_json(symbol(c))
    part = lambda head, items: F.concat(F.lit('{"part":['), text(head), F.lit(","), F.array_join(items, ","), F.lit("]}"))
    quoted = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: F.regexp_extract(F.to_json(F.struct(s["value"].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    facets = fillers.groupBy("frame", "slot", "facet").agg(quoted.alias("q")).select("frame", "slot", "facet", part("facet", F.col("q")).alias("f"))
    slots = facets.groupBy("frame", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet", "f"))), lambda s: s["f"]).alias("q")).select("frame", "slot", part("slot", F.col("q")).alias("f"))
    frames = slots.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "f"))), lambda s: s["f"]).alias("q"))
    return frames.select(F.concat(F.lit('{"frame":['), text("frame"), F.lit(","), F.array_join("q", ","), F.lit("]}")).alias("value"))


def object_fillers(objects: DataFrame) -> DataFrame:
    """fillers (frame, slot, facet, pos, value) of the frames among objects (value); FrameKit's (MAKE-FRAME name (slot (facet filler ...)) ...) is a frame too. Other objects are left out."""
    ship(objects.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda x: x.get("symbol") if isinstance(x, dict) else x if isinstance(x, str) else None
        inner = lambda x: x["part"] if isinstance(x, dict) and "part" in x else x if isinstance(x, list) else []
        for b in batches:
            rows = []
            for v in map(json.loads, filter(None, b.column(0).to_pylist())):
                if isinstance(v, list) and v and name(v[0]) in ("MAKE-FRAME", "MAKE-FRAME-OLD"):
                    v = {"frame": v[1:]}
                if not isinstance(v, dict) or not v.get("frame"):
                    continue
                for slot in map(inner, v["frame"][1:]):
                    for facet in map(inner, slot[1:]):
                        for pos, filler in enumerate(facet[1:]):
                            rows.append((name(v["frame"][0]), name(slot[0]), name(facet[0]), pos, filler if isinstance(filler, str) else show(filler)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["frame", "slot", "facet", "pos", "value"])

    return objects.select("value").mapInArrow(run, "frame string, slot string, facet string, pos long, value string")


def _written(spark, objects: DataFrame) -> str:
    from .files import _folder

    path = _folder(spark, "objects")
    print_objects(objects).write.text(path)
    return path


def q_roundtrip(spark, sf_dir):
    """Orders as structures of their items: printed, written, read and taken apart again."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bits = F.concat(F.lit('{"bits":"'), F.lpad(F.bin(F.col("l_linenumber").cast("long")), 3, "0"), F.lit('"}'))
    one = F.concat(F.lit("["), F.col("l_partkey").cast("string"), F.lit(","), F.to_json(F.struct(F.col("l_returnflag").alias("symbol"))), F.lit(","), bits, F.lit("]"))
    orders = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("v")))), lambda s: s["v"]), ",").alias("v"))
    value = F.concat(F.lit('{"struct":{"symbol":"ORDER"},"fields":[["KEY",'), F.col("l_orderkey").cast("string"), F.lit('],["ITEMS",['), F.col("v"), F.lit("]]]}"))
    read = read_objects(spark, _written(spark, orders.select(value.alias("value"))))
    field = lambda k, kind: F.from_json(F.get_json_object("value", f"$.fields[{k}][1]"), kind)
    cut = read.where("type = 'struct'").select(F.get_json_object("value", "$.fields[0][1]").cast("long").alias("l_orderkey"), F.explode(field(1, "array<array<string>>")).alias("i"))
    return cut.select("l_orderkey", F.get("i", F.lit(0)).cast("long").alias("l_partkey"), F.get_json_object(F.get("i", F.lit(1)), "$.symbol").alias("l_returnflag"), F.get_json_object(F.get("i", F.lit(2)), "$.bits").alias("bits"))


def q_frames(spark, sf_dir):
    """The tables' frames in bracket syntax, written, read and imported."""
    from ..operators.frames import nations

    return object_fillers(read_objects(spark, _written(spark, frame_objects(nations(spark, sf_dir)))))


def q_types(spark, sf_dir):
    """Texts of events as objects of several types, by the type that is read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    texts = F.array(F.col("user_id").cast("string"), F.concat(F.col("user_id").cast("string"), F.lit("/7")), F.concat(F.col("event_id").cast("string"), F.lit(".5")), F.concat(F.lit("("), "event_type", F.lit(" ; a comment\n \"x\")")), F.concat(F.lit("#*"), F.bin("user_id")), F.concat(F.lit("|"), "event_type", F.lit("|")))
    from .files import _folder

    path = _folder(spark, "types")
    e.select(F.explode(texts).alias("value")).write.text(path)
    return read_objects(spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


from ..operators.frames import _F as _FRAMES  # noqa: E402

QUERIES = {"object_roundtrip": q_roundtrip, "object_frames": q_frames, "object_reader_types": q_types}
SQL = {
    "object_roundtrip": "SELECT l_orderkey, l_partkey, l_returnflag, lpad(bin(l_linenumber), 3, '0') AS bits FROM lineitem",
    "object_frames": f"{_FRAMES} SELECT frame, slot, 'VALUE' AS facet, 0::BIGINT AS pos, value FROM f",
    "object_reader_types": "SELECT type, (SELECT count(*) FROM events) AS n FROM (VALUES ('integer'), ('rational'), ('float'), ('list'), ('bits'), ('symbol')) t(type)",
}
