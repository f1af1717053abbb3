"""Conversation repair against enumeration of edits and SQL."""

import itertools
import random
import re
import time
import zlib

import pytest

from tessera.llm import conversations
from tests.helpers import duck, rows_of

PATTERN = re.compile(r"(s?(ua)+)?")
FORM = "conv_id long, turn long, role string, text string"


def enumerated(rows, most=12):
    """The least (cost, audit) over all sequences of edits of at most ``most`` cost."""
    best = (most + 1, "")

    def go(at, cost, audit, roles):
        nonlocal best
        if cost > best[0] or cost > most:
            return
        if at == len(rows) and PATTERN.fullmatch(roles):
            best = min(best, (cost, audit))
        for role in "ua":
            go(at, cost + 3, audit + "I", roles + role)
        if at < len(rows):
            initial, fault = rows[at]
            go(at + 1, cost + 4, audit + "D", roles)
            if fault not in (conversations.BLANK, conversations.DUPLICATE):
                extra = 3 * (fault == conversations.TRUNCATED)
                go(at + 1, cost + extra, audit + "K", roles + initial)
                for role in "ua":
                    go(at + 1, cost + 3 + extra, audit + "R", roles + role)

    go(0, 0, "", "")
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_against_all_edits(n):
    kinds = list(itertools.product("suax", range(4)))
    every = itertools.product(kinds, repeat=n)
    for rows in random.Random(n).sample(list(every), 60) if n > 1 else every:
        rows = list(rows)
        assert conversations.repair(rows) == enumerated(rows), rows


def test_any_valid_bound_gives_the_same():
    rng = random.Random(8)
    none = lambda rows: [(0,) * 4] * (len(rows) + 1)
    weak = lambda rows: [tuple(min(b) for _ in b) for b in conversations.suffix_bounds(rows)]
    for _ in range(150):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7))]
        assert conversations.repair(rows) == conversations.repair(rows, weak) == conversations.repair(rows, none)


def test_long_conversations_take_time_in_proportion():
    rng, took = random.Random(9), []
    for n in (5_000, 40_000):
        rows = [(rng.choice("suuaa"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
        began = time.process_time()
        cost, audit = conversations.repair(rows)
        took.append(time.process_time() - began)
        assert sum(e != "I" for e in audit) == n and cost > 0
    assert took[1] < 30 * took[0] + 1


def test_odd_rows_against_sql(spark, sf_dir, tmp_path):
    rng = random.Random(10)
    rows = [(None, None, None, None), (None, 1, "user", None), (None, 1, None, "Hi."), (1, None, "system", "Be good."), (1, None, "user", "Hi"), (1, 3, "", "Hello!"), (1, 9, "assistant", ""), (2, 5, "User", "Hi."), (3, 1, "user", "x" * 300_000 + "."), (3, 2, "assistant", " \t\n")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Yes.", "No", "", None, "Why? ", "Yes."])) for c in range(10, 90) for t in range(rng.randint(0, 7))]
    rows += rows[-40:]  # repeated rows
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "Hi."))
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, FORM).repartition(3).write.parquet(path)
    df = conversations.op12_conversation_repair(spark, str(tmp_path))
    columns, want = duck(sf_dir, conversations.SQL, {"conversations": f"{path}/*.parquet"})
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    assert got == want and len(got) == len({r[0] for r in rows})
    assert [(r.audit, r.cost) for r in df.where(f"conv_id = {gone}").collect()] == [("", 0)]


def test_repaired_turns_and_other_columns(spark):
    rows = [(1, 1, "user", "Hi.", "x", 1), (1, 2, "user", "Still there?", "x", 1), (1, 3, "assistant", "Yes.", "x", 1), (1, 4, "assistant", "cut off", "x", 1)]
    df = spark.createDataFrame(rows, FORM + ", conv string, fault int")
    (r,) = conversations.repair_conversations(df).collect()
    assert (r.audit, r.cost, r.gaps, r.truncated, r.illegal) == ("KIKKD", 7, 0, 1, 2)
    assert [tuple(t) for t in r.repaired] == [("user", "Hi."), ("assistant", ""), ("user", "Still there?"), ("assistant", "Yes.")]
    assert conversations.repair_conversations(df.limit(0)).count() == 0
    assert PATTERN.fullmatch("".join(t.role[0] for t in r.repaired))
