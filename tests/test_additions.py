"""Estimates, interval joins, suffix order, the index on disk, published versions and transactions, clusters by members and in streams."""

import bisect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import estimates, intervals, member_clusters, ngrams, suffixes, word_index
from tessera.sources import files
from tessera.sources.manifest import Conflict, Manifest
from tessera.sources.transactions import FrameStore
from tessera.streaming import clusters
from tests.helpers import duck, rows_of


def words_of(spark, texts):
    return spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "rec long, words array<string>")


def tok_of(arrays):
    return arrays.select("rec", F.posexplode("words").alias("pos", "word"))


# Estimates

def counted(texts, gram):
    return sum(t.split()[k : k + len(gram)] == list(gram) for t in texts for k in range(len(t.split())))


def estimated(texts, key, discount):
    """Word by word after the rules, one phrase at a time."""
    total, ratio = sum(len(t.split()) for t in texts), 1 + discount
    n = len(key)
    if counted(texts, key):
        return counted(texts, key)
    if n == 1:
        return discount
    f = {(i, j): counted(texts, key[i : j + 1]) for i in range(n) for j in range(i + 1, n)}
    for i in range(n):
        c = counted(texts, key[i : i + 1])
        f[i, i] = c / ratio if c else (discount or estimates.UNSEEN)
    if n == 2:
        e = f[0, 0] / total * f[1, 1]
        return e**0.5 if e > 1 else e
    i = max(k for k in range(n) if f[0, k] > 0)
    j = min(k for k in range(n) if f[k, n - 1] > 0)
    parts, weight = [], 1

    def both(k):
        share, begin = f.get((k, n - 2), 0), f[0, k]
        parts.append(f[0, k] * f[k, n - 1] / share if share else 0)
        parts.append(f[k, n - 1] * f.get((1, k), 0) / begin if begin else 0)

    if i >= j and i > 0:
        for k in range(j, i + 1):
            both(k)
    else:
        if i > 0:
            f[i, n - 1] = estimated(texts, key[i:], discount)
        if j + 1 < n:
            f[0, j] = estimated(texts, key[: j + 1], discount)
        both(i)
        both(j)
        weight = 2
    factors = weight * sum(p > 0 for p in parts)
    if not factors:
        return discount
    e, expected = sum(parts) / factors, f[0, 0] / ratio
    for k in range(1, n):
        expected *= f[k, k] / (total * ratio)
    return e**0.5 if expected > 1 else e


@pytest.mark.parametrize(("order", "discount"), [(3, 0.1), (5, 0.1), (5, 0.0)])
def test_estimates_of_unseen_phrases(spark, order, discount):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("aabbcde") for _ in range(30)) for _ in range(6)]
    asked = [tuple(rng.choice("abcdex") for _ in range(order)) for _ in range(60)]
    keys = [f"w{k + 1}" for k in range(order)]
    got = estimates.estimate_frequency(words_of(spark, texts), spark.createDataFrame(asked, keys), order, discount).collect()
    assert len(got) == len(set(asked))
    for r in got:
        key = tuple(r[k] for k in keys)
        assert r.n == counted(texts, key) and r.estimate == pytest.approx(estimated(texts, key, discount)), key


def test_estimates_without_a_corpus(spark):
    empty = words_of(spark, ["x"]).limit(0)
    got = estimates.estimate_frequency(empty, spark.createDataFrame([("a", "b", "c")], ["w1", "w2", "w3"]), 3).first()
    assert got.n == 0 and got.estimate >= 0


def test_classes_share_their_probability(spark):
    arrays = words_of(spark, ["the cat saw the dog", "the dog saw a cat"])
    classes = spark.createDataFrame([("cat", "ANIMAL"), ("dog", "ANIMAL")], ["word", "class"])
    asked = spark.createDataFrame([("the", "cat"), ("the", "dog"), ("saw", "the"), ("the", "cow")], ["w1", "w2"])
    got = {(r.w1, r.w2): r.none for r in estimates.class_probability(arrays, tok_of(arrays), classes, asked, 2, ["none"], 0.0).collect()}
    # After "the" an animal stands each time; the class has two words.
    assert got == {("the", "cat"): 0.5, ("the", "dog"): 0.5, ("saw", "the"): 0.5, ("the", "cow"): 0.0}


# Intervals

@pytest.fixture(scope="module")
def pieces(spark):
    rng = random.Random(3)
    points = [(rng.choice("abc"), rng.randint(-50, 3000)) for _ in range(300)] + [(None, 5), ("a", None), ("z", 1)] + [("a", 7)] * 3
    ranges = [(rng.choice("abc"), s, s + rng.choice([0, 1, 2, 8, 9, 64, 65, 1000])) for s in (rng.randint(-40, 2500) for _ in range(80))] + [(None, 1, 9), ("a", 9, 3), ("b", 0, 2800), ("a", 5, 8), ("a", 5, 8)]
    make = lambda rows, form: spark.createDataFrame(rows, form).repartition(3)
    return points, ranges, make(points, "rec string, at long"), make(ranges, "rec string, start long, end long")


def test_containing_ranges(pieces):
    points, ranges, p, r = pieces
    held = lambda k, a: [(s, e) for c, s, e in ranges if k is not None and a is not None and c == k and s <= a <= e]
    want = sorted((str(k), str(a), s, e) for k, a in points for s, e in held(k, a))
    got = lambda df: sorted((str(x.rec), str(x.at), x.start, x.end) for x in df.collect())
    assert got(intervals.containing(p, r, "rec")) == want
    # In a left join points in no range come once, with nulls.
    assert sorted(map(str, got(intervals.containing(p, r, "rec", how="left")))) == sorted(map(str, want + [(str(k), str(a), None, None) for k, a in points if not held(k, a)]))
    semi = [(str(x.rec), str(x.at)) for x in intervals.containing(p, r, "rec", how="left_semi").collect()]
    anti = [(str(x.rec), str(x.at)) for x in intervals.containing(p, r, "rec", how="left_anti").collect()]
    assert sorted(semi) == sorted((str(k), str(a)) for k, a in points if held(k, a)) and sorted(semi + anti) == sorted((str(k), str(a)) for k, a in points)
    assert intervals.containing(p, r.limit(0), "rec").count() == 0 and intervals.containing(p, r.limit(0), "rec", how="left_anti").count() == len(points)


def test_places_of_frequent_ngrams(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    arrays = words_of(spark, texts)
    grams = [(k, i, tuple(t.split()[i : i + 3])) for k, t in enumerate(texts) for i in range(len(t.split()) - 2)]
    often = Counter(g for _, _, g in grams)
    found = ngrams.frequent_places(arrays, "rec", 3, 5)
    assert sorted((r.rec, r.start) for r in found.collect()) == sorted((k, i) for k, i, g in grams if often[g] >= 5)
    # What is dealt out and joined is numbers.
    assert not any("array" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


@pytest.mark.parametrize("name", ["range_containing", "range_covered", "range_preceding", "location_ranges"])
def test_ranges_with_documents_without_an_id(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.expr("CASE WHEN doc_id <> 3 AND doc_id % 7 <> 3 THEN doc_id END")).where("doc_id IS NOT NULL OR n_chars > 200").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    place = f"{tmp_path}/documents.parquet/*.parquet"
    module = ngrams if name == "location_ranges" else intervals
    columns, want = duck(sf_dir, module.SQL[name], {"documents": place})
    assert rows_of(columns, module.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == want


@pytest.mark.parametrize("bits", [2, 6, 20])
def test_preceding_ranges(pieces, bits):
    points, ranges, p, r = pieces

    def last(k, a):
        found = [(s, e) for c, s, e in ranges if k is not None and a is not None and c == k and s < a]
        return max(found) if found else (None, None)

    got = sorted((str(x.rec), str(x.at), str(x.start), str(x.end)) for x in intervals.preceding(p, r, "rec", bits=bits).collect())
    assert got == sorted((str(k), str(a), *map(str, last(k, a))) for k, a in points)


def test_inserted_ranges_are_merged(spark):
    old = spark.createDataFrame([("a", 0, 3), ("a", 10, 12), ("b", 1, 2)], "rec string, start int, end int")
    new = spark.createDataFrame([("a", 4, 6), ("c", 7, 7)], "rec string, start int, end int")
    assert sorted(tuple(r) for r in intervals.insert_ranges(old, new, "rec").collect()) == [("a", 0, 6), ("a", 10, 12), ("b", 1, 2), ("c", 7, 7)]


# Suffixes

def test_suffix_ranks(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aab") for _ in range(rng.randint(0, 40))) for _ in range(8)]
    texts += [texts[0], texts[0] + " a", "b " * 30, "b " * 29, ""]
    tails = {(k, i): t.split()[i:] for k, t in enumerate(texts) for i in range(len(t.split()))}
    order = sorted(tails.values())
    got = {(r.rec, r.pos): r.rank for r in suffixes.suffix_ranks(tok_of(words_of(spark, texts))).collect()}
    assert got == {k: bisect.bisect_left(order, t) + 1 for k, t in tails.items()}
    assert suffixes.suffix_ranks(tok_of(words_of(spark, [""]))).count() == 0


def test_longest_matches(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("aabbcd") for _ in range(25)) for _ in range(10)]
    keys = [[rng.choice("abcde") for _ in range(rng.randint(1, 9))] for _ in range(60)] + [texts[3].split(), texts[3].split() + ["x"], [], None, ["z"], texts[3].split()]

    def longest(key):
        for n in range(len(key or []), 0, -1):
            if c := counted(texts, key[:n]):
                return n, c
        return 0, 0

    got = sorted((r.key, r.length, r.n) for r in suffixes.longest_matches(words_of(spark, texts), spark.createDataFrame(list(enumerate(keys)), "key long, words array<string>")).collect())
    assert got == [(k, *longest(key)) for k, key in enumerate(keys)]


# Index and manifest

def test_index_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (2, ""), (None, "a b c")], "id long, text string")
    assert word_index.build_index(docs, path, "id", buckets=4) == 1
    assert word_index.build_index(docs.where("id = 1"), path, "id", buckets=4) == 2
    first, last = word_index.load_index(spark, path, 1), word_index.load_index(spark, path)
    assert (first.header["records"], first.header["words"], first.header["tokens"], last.header["tokens"]) == (4, 3, 9, 4)
    got = {(r.w1, r.w2): r.n for r in word_index.spell(first, word_index.count_ids(first, 2), 2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 2, ("b", "c"): 1}
    assert {(r.w1, r.w2, r.w3): r.n for r in word_index.spell(last, word_index.count_ids(last, 3), 3).collect()} == {("a", "b", "a"): 1, ("b", "a", "b"): 1}
    assert sorted((str(r.rec), r.pos) for r in word_index.occurrences(first, ["c", "nowhere"]).collect()) == [("None", 2)]
    with pytest.raises(LookupError):
        word_index.load_index(spark, path, 3)


def test_index_of_many_chunks_and_parts(spark, tmp_path, monkeypatch):
    """Chunks with words of their own, parts that are added up apart, postings of a bucket in several groups."""
    monkeypatch.setattr(word_index, "PART", 50)
    monkeypatch.setattr(word_index, "GROUP", 60)
    rng, path = random.Random(11), f"file://{tmp_path}/index"
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xy") * (k // 100) for _ in range(rng.randrange(9))) for k in range(300)] + [None, "", "12 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    word_index.build_index(docs, path, "id", buckets=3)
    index = word_index.load_index(spark, path)
    words = [(t or "").split() if not (t or "").startswith("12") else [] for t in texts]
    assert (index.header["records"], index.header["tokens"]) == (len(texts), sum(map(len, words)))
    name = {r.id: r.word for r in index.vocabulary.collect()}
    assert sorted((r.rec, [name[i] for i in r.ids]) for r in index.records.collect()) == [(k, w) for k, w in enumerate(words) if w]
    assert sorted((r.rec, r.pos, name[r.id]) for r in index.postings.collect()) == [(k, p, x) for k, w in enumerate(words) for p, x in enumerate(w)]
    for n in range(1, 6):
        want = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
        for least in (1, 2):
            counted = word_index.count_ids(index, n, least)
            got = {tuple(name[r[k]] for k in range(n)): r.n for r in counted.collect()}
            assert got == {g: c for g, c in want.items() if c >= least}
    # Before, a row for each n-gram went through the shuffle.
    assert word_index.count_ids(index, 2).where("n > 0")._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    log = Manifest(spark, f"file://{tmp_path}/m")
    assert log.last() == 0 and log.publish({"k": "é"}, 0) == 1
    with pytest.raises(Conflict):
        log.publish({"k": 2}, 0)
    assert log.entry() == {"k": "é"} and log.names("log") == ["000000000001"]
    assert log.publish({"k": 3}) == 2 and log.versions() == [1, 2]


def test_replaced_tables_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.replace_table(spark.range(3), path)
    before = files.read_table(spark, path)
    files.replace_table(spark.range(5), path)
    assert (before.count(), files.read_table(spark, path).count(), files.read_table(spark, path, 1).count()) == (3, 5, 3)


# Transactions

def frames_of(spark, *rows):
    return spark.createDataFrame([(f, s, "VALUE", 0, v) for f, s, v in rows], "frame string, slot string, facet string, pos int, value string")


def state(store, version=None):
    return sorted((r.frame, r.slot, r.value) for r in store.fillers(version).collect())


def test_transactions(spark, tmp_path):
    store = FrameStore(spark, f"file://{tmp_path}/frames")
    assert state(store) == [] and store.begin().commit() == 0
    assert store.begin().put(frames_of(spark, ("A", "COLOR", "red"), ("B", "COLOR", "blue"))).commit() == 1
    # Later changes of a transaction count; nothing is seen before its commit.
    t = store.begin().put(frames_of(spark, ("A", "COLOR", "green"))).delete(spark.createDataFrame([("B",)], "frame string")).put(frames_of(spark, ("B", "SIZE", "big")))
    assert state(store) == [("A", "COLOR", "red"), ("B", "COLOR", "blue")]
    assert t.commit() == 2 and state(store) == [("A", "COLOR", "green"), ("B", "SIZE", "big")] and len(state(store, 1)) == 2
    with pytest.raises(RuntimeError):
        t.put(frames_of(spark, ("C", "COLOR", "red")))
    # Side by side on different frames both go through; on the same frame the second one doesn't.
    one, two, three = store.begin(), store.begin(), store.begin()
    one.put(frames_of(spark, ("C", "N", "1"))).commit()
    two.put(frames_of(spark, ("D", "N", "2"))).commit()
    three.put(frames_of(spark, ("C", "N", "3")))
    with pytest.raises(Conflict):
        three.commit()
    assert [x for x in state(store) if x[1] == "N"] == [("C", "N", "1"), ("D", "N", "2")]
    known = {r.frame: r.known for r in store.is_frame(spark.createDataFrame([("A",), ("X",)], "frame string")).collect()}
    assert known == {"A": True, "X": False}
    before = state(store)
    store.begin().delete(spark.createDataFrame([("A",), ("D",)], "frame string")).commit()
    assert state(store) == [x for x in before if x[0] not in "AD"]
    last = store.compact()
    assert state(store) == state(store, last - 1) and state(store, last - 2) == before


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    store = FrameStore(spark, f"file://{tmp_path}/frames")
    store.begin().put(frames_of(spark, ("A", "N", "1"))).commit()
    store.begin().put(frames_of(spark, ("A", "N", "2")))  # dies between staging and commit
    (tmp_path / "frames/log/_half").write_text('{"kind"')  # dies while it writes its entry
    again = FrameStore(spark, f"file://{tmp_path}/frames")
    assert state(again) == [("A", "N", "1")] and again.log.versions() == [1]
    gone = again.recover()
    assert len(gone) == 2 and state(again) == [("A", "N", "1")]
    assert len(again.log.names("data")) == 1 and again.begin().put(frames_of(spark, ("A", "N", "3"))).commit() == 2


# Clusters

def test_similarity_to_members(spark):
    rng = np.random.default_rng(6)
    vectors, members = rng.random((25, 6)), rng.random((33, 6))
    names = [f"c{k % 4}" for k in range(33)]
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(vectors)], "id long, v array<double>")
    m = spark.createDataFrame([(k, names[k], [float(x) for x in row]) for k, row in enumerate(members)] + [(99, None, [1.0] * 6)], "member long, cluster string, v array<double>")
    s = np.abs(vectors[:, None, :] - members[None, :, :]).sum(2)
    like = {r["id"]: r["similarity"] for r in member_clusters.dense_similarity(v.withColumn("y", F.lit([float(x) for x in members[0]])), "manhattan", "v", "y", normalise=True).select("id", "similarity").collect()}
    for rep, how in (("nearest", max), ("furthest", min), ("average", lambda x: sum(x) / len(x)), ("rms", lambda x: (sum(y * y for y in x) / len(x)) ** 0.5)):
        got = {(r.id, r.cluster): r.similarity for r in member_clusters.cluster_similarity(v, m, rep, "cosine", block=8).collect()}
        cos = vectors @ members.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(members, axis=1)
        assert len(got) == 100
        for (i, c), x in got.items():
            assert x == pytest.approx(how([cos[i, k] for k in range(33) if names[k] == c]))
    other = {(r.id, r.cluster): r.similarity for r in member_clusters.cluster_similarity(v, m.where("member = 0"), "average", "manhattan").collect()}
    assert len(like) == 25 and all(other[i, "c0"] == pytest.approx(x) for i, x in like.items()) and s.shape == (25, 33)


def test_conflicts(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.1])], "id long, v array<double>")
    centres = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    forbidden = spark.createDataFrame([(1, "a"), (3, "a"), (3, "b"), (4, "unknown")], "id long, cluster string")
    got = {r.id: r.cluster for r in member_clusters.nearest_without_conflict(v, centres, forbidden).collect()}
    assert got == {1: "b", 2: "a", 3: "b", 4: "a"}
    pairs = spark.createDataFrame([(1, 2), (2, 1), (4, 3), (5, 5)], "id long, other long")
    assigned = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, cluster string")
    assert [tuple(r) for r in member_clusters.pair_conflicts(pairs, assigned).collect()] == [(2, "a")]
    seeds = spark.createDataFrame([(1, "a"), (2, None)], "id long, seed string")
    assert [tuple(r) for r in member_clusters.seed_conflicts(seeds, ["a", "b"]).collect()] == [(1, "b")]


@pytest.mark.parametrize("cuts", [1, 4])
def test_streams_grow_the_same_clusters(spark, tmp_path, cuts):
    rng = np.random.default_rng(7)
    rows = [(f"k{int(rng.integers(3))}", k, [float(x) for x in rng.normal(size=4)]) for k in range(60)]
    form = "key string, id long, v array<double>"
    for c in range(cuts):
        part = rows[c * 60 // cuts : (c + 1) * 60 // cuts]
        spark.createDataFrame(part[::-1] + [(None, 1, [1.0] * 4), ("k1", None, None)], form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = clusters.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    out = clusters.cluster_stream(stream, 0.5, 5).writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start()
    out.awaitTermination()
    held = {}
    want = []
    for key, i, v in rows:
        k, s = held.setdefault(key, clusters.Growing(0.5, 5)).add(v)
        want.append((key, i, f"<CL_{k}>", round(s, 9)))
    assert sorted((r.key, r.id, r.cluster, round(r.similarity, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


@pytest.mark.parametrize("rep", ["average", "rms", "nearest", "furthest"])
def test_best_clusters_by_all_pairs(spark, rep):
    rng = random.Random(5)
    vs = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) + rng.random() / 8 for _ in range(4)] for _ in range(60)] + [None, [0.0] * 4]
    vs += [vs[0], [4 * x for x in vs[1]], [-x for x in vs[2]]]
    own = [(k, v) for k, v in enumerate(vs)]
    clusters = {k: "abc"[k % 3] for k in range(0, len(vs), 2)}

    def cosine(x, y):
        if x is None or y is None:
            return -1.0
        scale = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.dot(x, y) / scale) if scale else 0.0

    def alike(v, c):
        s = [cosine(v, vs[m]) for m in clusters if clusters[m] == c]
        return {"average": np.mean(s), "rms": np.sqrt(np.mean(np.square(s))), "nearest": max(max(s), 0), "furthest": min(min(s), 1)}[rep]

    form = "array<double>"
    vectors = spark.createDataFrame(own, f"id long, v {form}").repartition(3)
    members = spark.createDataFrame([(k, c, vs[k]) for k, c in clusters.items()], f"member long, cluster string, v {form}").repartition(3)
    every = {(r.id, r.cluster): r.similarity for r in member_clusters.cluster_similarity(vectors, members, rep, block=7).collect()}
    assert every == {(k, c): pytest.approx(alike(v, c), abs=1e-12) for k, v in own for c in "abc"}
    found = member_clusters.best_clusters(vectors, members, rep)
    best = {r.id: (r.cluster, r.similarity) for r in found.collect()}
    want = {k: min((-round(alike(v, c), 12), c) for c in "abc") for k, v in own}
    assert best == {k: (c, pytest.approx(-s, abs=1e-11)) for k, (s, c) in want.items()}
