"""Decontamination against SQL and brute force on odd texts and items."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination
from tessera.llm.words import Words
from tests.helpers import duck, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10, shingle=3, containment=1.0):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            iw = words_of(item_text)
            n = min(len(iw), window)
            for k in range(len(iw) - n + 1 if n else 0):
                win, s = iw[k : k + n], min(shingle, n)
                m = n - s + 1
                for at in range(len(w) - n + 1):
                    same = sum(w[at + x : at + x + s] == win[x : x + s] for x in range(m))
                    if same >= -(-m * containment // 1):
                        hit.update(range(at, at + n))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)


def run(spark, docs, items, **settings):
    found = decontamination.decontaminate(*frames(spark, docs, items), **settings)
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    make = lambda n: [rng.choice("alpha beta gamma delta épsilon zeta eta 42 x1 ünder".split()) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([0, 1, 2, 5, 9, 10, 11, 30, 40])))) for k in range(20)] + [(3, " ".join(make(15))), (None, " ".join(make(12))), (99, None), (98, "..."), (97, "ALPHA-Beta, gamma;delta"), (7, "solo")]
    docs = [(k, " ".join(make(rng.randint(0, 60)))) for k in range(25)]
    for k, (_, item) in enumerate(items):
        if item and len(item.split()) > 3:
            docs.append((100 + k, " ".join(make(5)) + ", " + item.upper().replace("É", "é") + "! " + " ".join(make(5)) + " " + " ".join(item.split()[1:12])))
    docs += [(200, None), (201, ""), (202, " . ,"), (203, "alpha beta"), (203, "alpha beta"), (None, "Solo"), (204, "x" * 50_000), (205, " ".join(make(3000)))]
    return docs, items


def test_against_brute_force(spark, texts):
    assert run(spark, *texts) == brute(*texts)


@pytest.mark.parametrize("settings", [{"window": 6, "shingle": 2}, {"window": 8, "shingle": 3, "containment": 0.5}, {"window": 2, "shingle": 5}])
def test_other_settings(spark, texts, settings):
    docs = [d for d in texts[0] if d[0] != 205]
    want = dict(settings, shingle=min(settings["shingle"], settings["window"]))
    assert run(spark, docs, texts[1], **settings) == brute(docs, texts[1], **want)


def test_query_against_sql_on_odd_rows(spark, sf_dir, texts, odd_docs, tmp_path):
    docs, items = frames(spark, *texts)
    docs.unionByName(odd_docs.select("doc_id", "text")).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = decontamination.op13_decontamination(spark, str(tmp_path))
    columns, want = duck(sf_dir, decontamination.SQL, {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "benchmark")})
    assert sorted(df.columns) == columns and rows_of(df.columns, df.collect()) == want


def test_empty_tables_and_clashing_columns(spark, texts):
    docs, items = frames(spark, *texts)
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    free = decontamination.decontaminate(docs, items.limit(0)).collect()
    assert len(free) == docs.count() and all(not r.n_hit and not r["items"] for r in free)
    more = docs.selectExpr("*", "1 AS row", "2 AS key", "3 AS wid", "4 AS id", "5 AS `a.b`")
    assert decontamination.decontaminate(more, items.selectExpr("*", "1 AS item", "2 AS words")).where("n_hit > 0").count() > 10


def test_words_and_bits():
    sample = ["Ab-cd é9_Z\x7fq", "", None, "x" * 10, " ü ü"]
    found = Words(decontamination.folded(pa.array(sample)))
    cut = [found.data[s:e].tobytes().decode() for s, e in zip(found.starts, found.ends)]
    assert cut == [w for t in sample for w in words_of(t)]
    bits = np.zeros(1 << (decontamination.BITS - 6), np.uint64)
    key = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for slot in decontamination._slots(key):
        np.bitwise_or.at(bits, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
    assert decontamination.may_hold(bits, key).all() and not decontamination.may_hold(bits, key + np.uint64(12345)).any()
