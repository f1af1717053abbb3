"""Stages and operators on columns of any name, many matches, repeated rows, and against versions written without them."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, exact_dedup, mixing, secrets, toxicity
from tessera.llm.store import Tables

CLASHING = ["a.b", "back`tick", "__toxicity_score", "__mix_copies", "__exact_own_n", "__near_own0", "row", "id", "hash", "own_n", "own_sha", "order", "at", "of", "known", "n", "many", "score", "position", "copies", "t1", "t2", "size"]


def test_columns_of_any_name(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)]).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in out.collect())
        assert out.count() > 0


def test_repeated_rows_share_their_plans(spark):
    """Rows equal in id, source and text, some in all columns too: as many copies as their plans say, each row taken about as often."""
    rows = [(1, "a b c d", "x", k % 2) for k in range(40)] + [(2, "e f", "x", 0), (None, "g", None, 1), (None, "g", None, 1)] + [(k, "w " * 30, "y", 0) for k in range(10, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    plan = mixing.plan_mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source] += sum(2 * c.words >= r["size"] for c in r.copies)
    out = mixing.mixed(docs)
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert got == +want and sum(got.values()) == sum(want.values())
    assert {r.extra for r in out.where("doc_id = 1").collect()} == {0, 1}
    once = Counter(map(tuple, out.collect()))
    assert once == Counter(map(tuple, mixing.mixed(docs.repartition(2)).collect()))
    assert exact_dedup.drop_exact_copies(docs).where("doc_id = 1").count() == 1


def test_mixing_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), hashlib.md5(f"{r.doc_id} {hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()) for r in docs.collect()]
    names = sorted({s for _, s, _, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _, _ in rows) else [])
    size = {s: sum(n for _, x, n, _ in rows if x == s) for s in names}
    weight, target, rest, open_ = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, {}, float(sum(size.values())), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        rest, open_ = rest - sum(3 * size[s] for s in over), open_ - over
    want = Counter()
    for s in names:
        before = 0
        for _, i, n in sorted((h, i, n) for i, x, n, h in rows if x == s):
            for e in range(3):
                words = max(min(round(target[s]) - before - e * size[s], n), 0)
                want[i] += words > 0 and 2 * words >= n
            before += n
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert got == +want


def test_names_depend_on_the_texts_alone(spark, odd_docs):
    def names(docs, **settings):
        ids, _ = exact_dedup.exact_identity(docs, block=7, **settings)
        return Counter((r.id, r.text_sha256, r.level, r["name"]) for r in ids.collect())

    short = odd_docs.where("length(text) < 1000 OR text IS NULL")
    assert names(short) == names(short.repartition(7)) == names(short.repartition(1))
    # With one hash for all blocks they go by content alone.
    clash = lambda b: F.lit(1).cast("long")
    assert names(short, route=clash) == names(short.repartition(6), route=clash)


def test_names_are_numbers_in_order(spark):
    got = exact_dedup.sorted_names(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(9), ["k", "v"], ["k"], Tables(spark, "t")).collect()
    assert all(r.k == r["name"] for r in got) and len(got) == 1000


# Secrets

@pytest.mark.parametrize("n", [100_000])
def test_many_matches_in_one_text(spark, n):
    words = [("0123456789abcdef" * 2 if k % 2 else "ÄKIA token=abcdef1") for k in range(n)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, "é " + text[:500]), (1, text)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.findings for r in secrets.scan_versions(docs)[0].collect()}
    assert time.time() - began < 60
    want = [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]{24,}", text)] + [(m.start(), m.end(), "assign") for m in re.finditer("token=[A-Za-z0-9+/_.=-]+", text)]
    assert sorted((s.start, s.end, s.kind) for s in found[1]) == sorted(want) and len(want) == n
    assert all((s.start, s.end, s.kind) for s in found[2]) and found[2][0].start == found[1][0].start + 2


# Chat

def test_few_conversations_with_long_texts_at_once(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}<{t}> " * (c % 5 * 40)) for c in range(30) for t in range(c % 4 + 1)] + [(None, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    form = lambda: sorted(map(str, chat.format_conversations(df).collect()))
    whole = form()
    batches = [b for b in __import__("pyarrow").Table.from_pylist([{"conv": c, "role": r, "text": t} for c, _, r, t in sorted(rows[:-1])]).to_batches(max_chunksize=7)]
    one = [r for b in chat._format(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(chat, "PIECE", 300)
    cut = list(chat._format(iter(batches)))
    assert [r for b in cut for r in b.to_pylist()] == one and len(cut) > 10 and len(whole) == 31


# Toxicity

def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_scores_against_edit_distances(spark, sf_dir):
    """Every score of the query worked out word by word from the same lexicon and weights, without trie or automaton."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    terms, weights, whole = toxicity.fit(docs, labels)
    every = [t for t in {*terms, *whole} if len(t) >= 5]
    known: dict[str, int] = {}

    def word(w):
        if w not in known:
            exact = w in set(whole) or any(w.startswith(t) for t in terms)
            known[w] = 1 if exact else 2 if any(abs(len(w) - len(t)) < 2 and edits(w, t) == 1 for t in every) else 0
        return known[w]

    def code(run):
        run = run.lower()
        parts = [m.span() for m in re.finditer(r"[^\W\d_]+", run)]
        found = {word(run[a:b]) for a, b in parts}
        if 1 not in found:
            found |= {word(run[a:d]) for (a, b), (c, d) in zip(parts, parts[1:]) if c == b + 1}
        return found

    def score(text):
        runs = text.split()
        codes = [code(r) for r in runs]
        counts, hits = [0] * 4, []
        for k, c in enumerate(codes):
            if not c & {1, 2}:
                continue
            hits.append(runs[k].lower())
            marks = toxicity._QUOTES
            before, after = runs[max(0, k - toxicity.WINDOW) : k], runs[k + 1 : k + 1 + toxicity.WINDOW]
            left = any(set(r) & marks for r in before) or runs[k][0] in marks
            right = any(set(r) & marks for r in after) or bool(set(runs[k][-2:]) & marks)
            quoted = left and (right or any(r.strip(",:").lower() in toxicity._SAYING for r in before))
            counts[(0 if 1 in c else 1) + 2 * quoted] += 1
        x = [*(math.log1p(c) for c in counts), math.log1p(100.0 * sum(counts[:2]) / max(len(runs), 1)), math.log1p(len(set(hits)))]
        z = weights[-1] + sum(a * b for a, b in zip(weights, x))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = toxicity.op4_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-9)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_a_task_gives_the_nearest_of_each_query_once(monkeypatch):
    """However many lists a query reads in a task, k rows of it leave the task, and they are those of brute force."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import ann

    monkeypatch.setattr(ann, "HELD", 40)
    rng, k = np.random.default_rng(3), 3
    vectors = rng.integers(-3, 4, (120, 4)).astype(float)
    rows = []
    for at in range(12):
        rows += [(at, 0, 0, q, vectors[q].tolist()) for q in range(0, 120, 20)]
        rows += [(at, 0, 1, i, vectors[i].tolist()) for i in range(120) if i % 12 == at or (i + 1) % 12 == at]
    batch = pa.RecordBatch.from_pydict({"list": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([0] * len(rows), pa.int32()), "kind": pa.array([r[2] for r in rows], pa.int32()), "id": pa.array([r[3] for r in rows], pa.int64()), "vector": pa.array([r[4] for r in rows])})
    got = [tuple(r.values()) for b in ann._best(4, k)([batch.slice(0, 100), batch.slice(100)]) for r in b.to_pylist()]
    want = []
    for q in range(0, 120, 20):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        want += [(q, i, d[i]) for i in sorted((i for i in range(120) if i != q), key=lambda i: (d[i], i))[:k]]
    assert sorted(got) == sorted(want)
