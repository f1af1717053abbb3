"""Conversation structure repair by depth-first branch-and-bound.

A conversation's roles shall read: a system turn or none, then pairs of user and assistant turns, or nothing at all.
Rows may be kept, given another role (user or assistant) or deleted, and empty turns may be inserted; of the cheapest
ways the one whose edits' initials come first in ASCII is taken. The search goes over nodes (rows done, place in the
pattern) with an explicit stack. A suffix bound, worked out from the last row backwards, says what the rest of the rows
costs at least from each place; an incumbent (cost, audit) and a table with the best prefix of each node cut
everything that can't be better, until the stack is empty and the incumbent is proved. Prefixes are links to
the node before, so two prefixes are compared along the part in which they differ.

Spark deals conversations out by id and sorts them by turn; a task reads one conversation after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship

USER, ASSISTANT = "user", "assistant"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: A row's first fault.
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Places in the pattern: nothing yet, after the system turn, after a user's, after an assistant's. The pattern may end in the first and the last.
START, SYSTEM, ASKED, ANSWERED = range(4)
_ENDS = (START, ANSWERED)
#: The place that a kept row with this initial leads to, from each place that allows it.
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The place after a turn of the role that must follow; it is an assistant's after a user's, else a user's.
_NEXT = (ASKED, ASKED, ANSWERED, ASKED)
_FAR = 1 << 60


def moves(place: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """(edit, cost, place after it) of what may be done with a row, by edit."""
    found = [("D", DELETE, place)]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (place, initial) in _KEEPS:
            found.append(("K", extra, _KEEPS[place, initial]))
        found.append(("R", REROLE + extra, _NEXT[place]))
    return found


def suffix_bounds(rows: list[tuple[str, int]]) -> list[tuple[int, ...]]:
    """For each number of rows done and each place: the least that the rest can cost, insertions included."""

    def inserted(costs: list[int]) -> tuple[int, ...]:
        # Two insertions reach every place that insertions reach.
        for _ in range(2):
            costs = [min(c, INSERT + costs[_NEXT[p]]) for p, c in enumerate(costs)]
        return tuple(costs)

    bounds = [inserted([0 if p in _ENDS else _FAR for p in range(4)])]
    for initial, fault in reversed(rows):
        bounds.append(inserted([min(cost + bounds[-1][after] for _, cost, after in moves(p, initial, fault)) for p in range(4)]))
    return bounds[::-1]


def repair(rows: list[tuple[str, int]], bounds: Callable[[list[tuple[str, int]]], list[tuple[int, ...]]] = suffix_bounds) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties to the ASCII-least audit, for rows of (role initial, first fault).

    ``bounds`` may be any function that never says too much; the result is the same, only the search differs.
    """
    least, n = bounds(rows), len(rows)
    # Nodes of the search tree: the node before, the edit that led here, and how many edits so far.
    before, letter, depth = [-1], [""], [0]

    def earlier(a: int, b: int) -> bool:
        """Whether the prefix of node a comes before that of b. At equal costs neither begins the other: the rest would be insertions, which cost."""
        last_a, last_b = "", ""
        while depth[a] > depth[b]:
            last_a, a = letter[a], before[a]
        while depth[b] > depth[a]:
            last_b, b = letter[b], before[b]
        while a != b:
            last_a, last_b, a, b = letter[a], letter[b], before[a], before[b]
        return last_a < last_b

    best, incumbent = _FAR, -1
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    stack = [(0, 0, START, 0)]
    while stack:
        node, done, place, cost = stack.pop()
        if cost + least[done][place] > best:
            continue
        other = seen.get((done, place))
        if other is not None and (other[0] < cost or (other[0] == cost and not earlier(node, other[1]))):
            continue
        seen[done, place] = (cost, node)
        if done == n and place in _ENDS and (cost < best or earlier(node, incumbent)):
            best, incumbent = cost, node
        ways = [("I", INSERT, _NEXT[place], done)]
        if done < n:
            ways += [(edit, more, after, done + 1) for edit, more, after in moves(place, *rows[done])]
        after = []
        for edit, more, to, at in ways:
            bound = cost + more + least[at][to]
            if bound <= best:
                after.append((bound, edit, more, to, at))
        # The most promising child comes off the stack first, among equals the one that is first in ASCII.
        for _, edit, more, to, at in sorted(after, reverse=True):
            before.append(node)
            letter.append(edit)
            depth.append(depth[node] + 1)
            stack.append((len(before) - 1, at, to, cost + more))
    audit = []
    while incumbent > 0:
        audit.append(letter[incumbent])
        incumbent = before[incumbent]
    return best, "".join(reversed(audit))


def apply_edits(audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    out, place, at = [], START, 0
    for edit in audit:
        if edit == "K":
            out.append((roles[at], texts[at]))
            place = _KEEPS[place, roles[at][:1]]
        elif edit in "RI":
            out.append((ASSISTANT if place == ASKED else USER, texts[at] if edit == "R" else ""))
            place = _NEXT[place]
        at += edit != "I"
    return out


def _judged(conv, turns: list, roles: list[str], texts: list[str], faults: list[int]) -> tuple:
    seen: set[tuple[str, str]] = set()
    for k, said in enumerate(zip(roles, texts)):
        if faults[k] != BLANK and said in seen:
            faults[k] = DUPLICATE
        seen.add(said)
    initials = [r[:1] for r in roles]
    cost, audit = repair(list(zip(initials, faults)))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    fixed = apply_edits(audit, roles, texts)
    return conv, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, [{"role": r, "text": t} for r, t in fixed]


#: Results that are sent on at once: rows, and code points of their texts.
_ROWS, _CHARS = 1000, 1 << 22


def _repaired(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        now, held = None, None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            for conv, turn, role, text, fault in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held is None or conv != now:
                    if held is not None:
                        out.append(_judged(now, *held))
                        chars += sum(len(t["text"]) for t in out[-1][-1])
                    now, held = conv, ([], [], [], [])
                    if len(out) >= _ROWS or chars >= _CHARS:
                        yield batch()
                        out, chars = [], 0
                for column, value in zip(held, (turn, role, text, fault)):
                    column.append(value)
        if held is not None:
            out.append(_judged(now, *held))
        if out:
            yield batch()

    return run


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each conversation that has rows.

    ``repaired`` holds (role, text) of every turn after the edits, which ``audit`` names (Keep, Rerole, Delete, Insert). Rows go by
    turn, null first, ties by role and text; repeated rows stay and count as duplicates. Null roles and texts are one space, so
    null and empty texts are blank; rows with a null conversation are one conversation; no rows give no rows; other columns are
    ignored, whatever their names. A conversation is sorted and repaired in one task and its result is one cell, so it must fit a task, however long its texts are; time grows in proportion to its rows.
    """
    ship(turns.sparkSession)
    bare = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    ending = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(F.length(ending) == 0, BLANK).when(ending.isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    dealt = bare.withColumn("fault", fault).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    said = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    form = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("audit", T.StringType()), T.StructField("repaired", said)])
    from pyspark.sql.pandas.types import to_arrow_schema

    return dealt.mapInArrow(_repaired(to_arrow_schema(form)), form).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns with five kinds of damage, by the CRC-32 of ``conversation:turn`` modulo 20: 0 drops the row, 1 empties the text, 2 takes its ``.!?`` out, 3 repeats the row, 4 makes the role user.

    A null is read as one space, the turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv_col), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    role = F.when(kind == 4, F.lit(USER)).otherwise(space(role_col))
    kept = turns.where(kind != 0).select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_again"))
    return kept.drop("_again")


def _digest(repaired: Column) -> Column:
    return F.sha2(F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(turns)).withColumn("repaired_sha256", _digest(F.col("repaired"))).drop("repaired").withColumnRenamed("conv_id", "conv")
    every = turns.select("conv_id").distinct()
    met = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    # The best (cost, audit) at each place, p0 to p3, row by row; a struct compares by cost, then audit.
    far = "{'c': 1000000000::BIGINT, 'a': ''}"
    plus = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"

    def inserted(source: str, names=("p0", "p1", "p2", "p3")) -> str:
        """Two rounds of insertions at each place."""
        for k in range(2):
            p2 = f"least(p2, {plus('p0', 3, 'I')}, {plus('p1', 3, 'I')}, {plus('p3', 3, 'I')})"
            source = f"(SELECT * REPLACE ({p2} AS p2, least(p3, {plus('p2', 3, 'I')}) AS p3) FROM {source})"
        return source

    free, cut = "CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE 0 END", "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    keep = lambda s, i: plus(s, f"CASE WHEN initial = '{i}' THEN 0 ELSE 1000000000 END + {free} + {cut}", "K")
    rerole = lambda s: plus(s, f"3 + {free} + {cut}", "R")
    drop = lambda s: plus(s, 4, "D")
    step = (
        f"SELECT * REPLACE (k + 1 AS k, {drop('p0')} AS p0, least({drop('p1')}, {keep('p0', 's')}) AS p1, "
        f"least({drop('p2')}, {keep('p0', 'u')}, {keep('p1', 'u')}, {keep('p3', 'u')}, {rerole('p0')}, {rerole('p1')}, {rerole('p3')}) AS p2, "
        f"least({drop('p3')}, {keep('p2', 'a')}, {rerole('p2')}) AS p3)"
    )
    first = f"SELECT conv, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS p0, {far} AS p1, {far} AS p2, {far} AS p3 FROM (SELECT DISTINCT conv FROM f)"
    stepped = f"({step} FROM (SELECT w.*, f.initial, f.fault FROM w JOIN f ON w.conv = f.conv AND f.k = w.k + 1))"
    bits = ", ".join(["-1"] * 8)
    return rf"""
WITH RECURSIVE o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, {bits}] for c in string_split(name, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS kind FROM o),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, again) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) AS met, left(role, 1) AS initial FROM r),
f AS (SELECT *, CASE WHEN cut = '' THEN 1 WHEN met > 1 THEN 2 WHEN right(cut, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, initial || lead(initial) OVER (PARTITION BY conv ORDER BY k) AS pair FROM g),
w AS (SELECT * FROM {inserted(f"({first})")} UNION ALL SELECT * EXCLUDE (initial, fault) FROM {inserted(stepped)}),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
b AS (SELECT n.*, least(w.p0, w.p3) AS best FROM n JOIN w ON n.conv = w.conv AND w.k = n.n),
e AS (SELECT conv, i, best.a[i] AS edit, len(replace(best.a[1:i], 'I', '')) AS k FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS i FROM b)),
a AS (SELECT e.conv, e.i, e.edit, CASE WHEN e.edit = 'K' THEN f.role ELSE '' END AS role, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text FROM e LEFT JOIN f ON e.conv = f.conv AND e.k = f.k AND e.edit <> 'I' WHERE e.edit <> 'D'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY i) - max(CASE WHEN edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS place FROM a),
s AS (SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS sha FROM t GROUP BY conv),
c AS (SELECT DISTINCT conv, conv_id FROM o)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM c LEFT JOIN b ON c.conv = b.conv LEFT JOIN s ON c.conv = s.conv
"""


SQL = _sql()
