"""Forms that keep words in their chunks and rank no further than asked: the same results as the plain ones."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import clustering, estimates, member_clusters, similarity_queries, spans, suffixes
from tests.helpers import duck, rows_of


@pytest.mark.parametrize("chunk", [64, 1 << 24])
def test_texts_against_their_groups_in_chunks(spark, monkeypatch, chunk):
    rng = random.Random(7)
    rows = [(k, rng.choice("ppppppqr"), " ".join(rng.choice(["Ab", "b", "cé", "日本", "d-e", "f1g"]) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    rows += [(0, rows[0][1], "b; b"), (50, "lone", "Ünique"), (51, "p", None), (52, "q", " 12 ."), (53, None, "b"), (None, "p", "b")]
    texts = spark.createDataFrame(rows, "x long, y string, text string").repartition(3)
    monkeypatch.setattr(similarity_queries, "CHUNK", chunk)
    got = {(r.x, r.y): r.asDict() for r in similarity_queries.group_statistics(texts).collect()}
    # The plain form, from rows of single terms.
    tok = texts.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y", F.explode(F.expr(r"regexp_extract_all(lower(text), '([\\p{L}]+)', 1)")).alias("term"))
    tv = tok.groupBy("x", "y", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    want = similarity.sparse_statistics(tv.select("x", "y").distinct(), tv.select("x", "term", "weight"), tv.groupBy("y", "term").agg(F.sum("weight").alias("weight"))).collect()
    assert set(got) == {(r.x, r.y) for r in want} and {(0, rows[0][1]), (50, "lone")} <= set(got)
    for r in want:
        assert got[r.x, r.y] == pytest.approx(r.asDict()), r


def test_classes_by_a_rule_are_those_of_a_table(spark):
    rng = random.Random(8)
    words = ["aa", "ab", "abc", "b", "ba", "bab", "cc"]
    arrays = spark.createDataFrame([(k, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for k in range(12)] + [(90, None)], "rec long, words array<string>")
    tok = arrays.select("rec", F.posexplode("words").alias("pos", "word"))
    # "ax" has the rule's class of "aa", but the corpus lacks it.
    asked = spark.createDataFrame([tuple(rng.choice([*words, "ax"]) for _ in range(3)) for _ in range(80)], ["w1", "w2", "w3"])
    rule = lambda w: F.when(w != "cc", F.concat(F.substring(w, 1, 1), F.length(w)))
    table = spark.createDataFrame([(w, f"{w[0]}{len(w)}") for w in words if w != "cc"], "word string, class string")
    ask = lambda classes: {tuple(r)[:3]: tuple(r)[3:] for r in estimates.class_probability(arrays, tok, classes, asked, 3, ["backoff", "mean"]).collect()}
    got, want = ask(rule), ask(table)
    assert set(got) == set(want) == {tuple(r) for r in asked.collect()}
    assert all(got[k] == pytest.approx(want[k]) for k in want) and got


def test_phrase_ranges_need_no_order_beyond_the_phrase(spark):
    rng = random.Random(9)
    texts = [[rng.choice("aab") for _ in range(rng.randint(0, 30))] for _ in range(8)] + [[], None, ["a"], ["b", "a"]]
    tails = sorted(t[i:] for t in texts if t for i in range(len(t)))
    arrays = spark.createDataFrame(list(enumerate(texts)), "rec long, words array<string>")
    for n in (1, 2, 3):
        asked = [[rng.choice("abc") for _ in range(n)] for _ in range(20)]
        got = {tuple(r.gram): (r.first, r.last, r.n) for r in suffixes.phrase_ranges(arrays, spark.createDataFrame([(g,) for g in asked], "gram array<string>"), n).collect()}
        at = {tuple(g): [k + 1 for k, t in enumerate(tails) if t[:n] == g] for g in asked}
        assert got == {g: (k[0], k[-1], len(k)) for g, k in at.items() if k}


@pytest.mark.parametrize("split, most", [(8, 2), (spans.SPLIT, spans.PAIRS)])
def test_neighbouring_words_meet_within_their_text(spark, split, most):
    rng = random.Random(10)
    blanks = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " \n "]
    # The last two are no blanks here.
    words = ["a", "be", "\u00e9t\u00e9", "\u65e5\u672c", "\U0001f600", "e\u0301", "x.y", "\u00a0", "\x1c"]
    texts = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", " ", None, "one", " a b", "a b\n"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b c")], "d long, t string").repartition(3)
    merged = spans.merge_words(docs, "d", "t", split, most)
    s = spans.build(docs.where("d IS NOT NULL"), "d", "t")
    got, want = (sorted(map(tuple, df.select("doc", "start", "end", "score", "text").collect())) for df in (merged, spans.merge_adjacent(s, s)))
    assert got == want and len(got) > 300


def test_merged_words_are_not_shuffled(spark, sf_dir):
    df = spans.q_merge(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_texts_of_one_id_are_one_lattice(spark, sf_dir, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice([1, 2, 3, 4, 5, 5, 5, None]), " ".join(rng.choice(["a", "bb", "cc\n", "\u00e9"]) for _ in range(rng.randint(0, 9)))) for _ in range(20)] + [(9, "a b c"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = spans.q_merge(spark, str(tmp_path))
    columns, want = duck(sf_dir, spans.SQL["span_merge"], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
    assert sorted(df.columns) == columns and rows_of(df.columns, df.collect()) == want and len(want) > 50


@pytest.mark.parametrize("chunk, part", [(40, 5), (200, 30), (suffixes.CHUNK, suffixes.PART)])
def test_suffixes_are_ordered_in_chunks(spark, chunk, part):
    rng = random.Random(12)
    texts = [[rng.choice(["a", "aa", "b", "\u00e9", "\U0001f600"]) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    texts += [texts[0], texts[0], texts[1] + ["a"], texts[1][3:], ["b"] * 70, ["b"] * 69, ["b"], [], None, *[["a", "b", "a", "b"]] * 3, ["a", "b", "a", "b", "a"]]
    # Names may be repeated or missing: each row is a record.
    rows = [(rng.choice(["x", "y", None]), t) for t in texts]
    tails = sorted(t[i:] for t in texts if t for i in range(len(t)))
    want = sorted((str(k), i, bisect.bisect_left(tails, t[i:]) + 1) for k, t in rows if t for i in range(len(t)))
    found = suffixes.suffix_order(spark.createDataFrame(rows, "rec string, words array<string>").repartition(3), chunk, part)
    assert sorted((str(r.rec), r.pos, r.rank) for r in found.collect()) == want


def test_turns_of_one_name_are_apart(spark, sf_dir, tmp_path):
    rng = random.Random(13)
    rows = [(rng.choice([1, 2, None]), rng.choice([0, 1, None]), "u", " ".join(rng.choice(["a", "Bb", "c,"]) for _ in range(rng.randint(0, 9)))) for _ in range(30)] + [(3, 0, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = suffixes.q_ranks(spark, str(tmp_path))
    columns, want = duck(sf_dir, suffixes.SQL["suffix_ranks"], {"conversations": f"{tmp_path}/conversations.parquet/*.parquet"})
    assert sorted(df.columns) == columns and rows_of(df.columns, df.collect()) == want and len(want) > 50


@pytest.mark.parametrize("block, entries", [(7, 40), (None, 1 << 22)])
def test_neighbours_are_those_of_the_sql(spark, sf_dir, tmp_path, block, entries):
    rng = random.Random(14)
    some = lambda: [float(rng.choice([-2, -1, 0, 1, 2, 3])) for _ in range(3)]
    vs = [some() for _ in range(250)]
    # Copies, scaled ones, ones without a direction and ones whose squares are out of range; few directions, so many ties.
    vs += [vs[0]] * 40 + [[3 * x for x in vs[k]] for k in range(30)] + [[0.0] * 3] * 2 + [[1e30, 1e30, 0.0], [1e-30, 0.0, 1e-30]]
    rng.shuffle(vs)
    rows = list(enumerate(vs)) + [(None, some()), (400, None)]
    spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = clustering._vectors(spark, str(tmp_path))
    for name, k in (("knn_topk", 10), ("nearest_neighbor", 1)):
        found = member_clusters.knn(v, v.where("id % 100 = 0"), k, block=block, entries=entries).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))
        columns, want = duck(sf_dir, clustering.SQL[name], {"embeddings": f"{tmp_path}/embeddings.parquet/*.parquet"})
        # A null vector is like nothing in SQL and takes no part here.
        want = [r for r in want if "400" not in (r[0], r[1])]
        assert sorted(found.columns) == columns and rows_of(found.columns, found.collect()) == want and len(want) == 4 * k


def test_pairs_of_vectors_are_no_rows(spark, sf_dir):
    df = clustering.q_knn(10)(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_vectors_that_cannot_be_compared_come_last(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [1.0, None]), (5, []), (6, [0.0, 1.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in member_clusters.knn(v, v.where("id IN (2, 5)"), 6, block=2).collect())
    assert [(q, k, i) for q, k, i, _ in got] == [(2, 1, 1), (2, 2, 1), (2, 3, 6), (2, 4, 3), (2, 5, 4), (2, 6, 5), *[(5, k + 1, i) for k, i in enumerate([1, 1, 2, 3, 4, 6])]]
    assert [s is None for *_, s in got] == [False] * 3 + [True] * 9
