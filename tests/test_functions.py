"""Hand fixtures and properties of the functions."""

import base64
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import lists, maps, scalars, similarity, text
from tessera.operators import clustering, frames, ngrams, spans, spelling, term_vectors
from tessera.plans.config import ClusterParameters, Settings
from tessera.sources import files


def dense(spark, name, x, y, **how):
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    return similarity.dense_similarity(df, name, "x", "y", **how).first()["similarity"]


def test_dense_by_hand(spark):
    x, y = [1.0, 0.0, 2.0], [1.0, 1.0, 0.0]
    assert dense(spark, "jaccard", x, y) == pytest.approx(1 / 3)
    assert dense(spark, "simpson", x, y) == pytest.approx(1 / 2)
    assert dense(spark, "cosine", x, y) == pytest.approx(1 / math.sqrt(10))
    assert dense(spark, "manhattan", x, y, normalise=False) == pytest.approx(1 - 3)
    assert dense(spark, "kulczynski2", x, y, normalise=False) == pytest.approx((1 / 3 + 1 / 2) / 2)
    # After division by the largest weight: a = min(0.5, 1), b = 1, c = 1.
    assert dense(spark, "mountford", x, y) == pytest.approx(2 * 0.5 / (2 + 0.5 + 0.5))
    assert dense(spark, "fager_mcgowan", x, y) == pytest.approx(0.5 / 1.5 - 0.5)


@pytest.mark.parametrize("name", [m for m in similarity.MEASURES if m not in ("kulczynski1", "similarityratio", "circleprod", "dice", "antidice", "mountford")])
def test_alike_and_symmetric(spark, name):
    x, y = [1.0, 0.5, 2.0, 0.0], [0.0, 1.0, 1.5, 0.0]
    assert dense(spark, name, x, x) == pytest.approx(1.0)
    assert dense(spark, name, x, y) == pytest.approx(dense(spark, name, y, x))


def test_empty_and_missing(spark):
    assert dense(spark, "cosine", [], []) == 1.0
    assert dense(spark, "jaccard", None, [1.0]) == -1.0


def test_sparse_like_dense_where_formulas_agree(spark):
    x, y = {"a": 1.0, "b": 0.5, "c": 2.0}, {"b": 1.0, "c": 1.5, "d": 1.0}
    left = spark.createDataFrame([("x", t, w) for t, w in x.items()], "x string, term string, weight double")
    right = spark.createDataFrame([("y", t, w) for t, w in y.items()], "y string, term string, weight double")
    stats = similarity.sparse_statistics(spark.createDataFrame([("x", "y")], "x string, y string"), left, right).cache()
    terms = sorted({*x, *y})
    dx, dy = [x.get(t, 0.0) for t in terms], [y.get(t, 0.0) for t in terms]
    for name in ("cosine", "jaccard", "simpson", "bin_dice", "bin_antidice", "extsimpson", "braun_blanquet", "kulczynski1", "ochiai", "braycurtis", "canberra", "czekanowski", "robinson", "drennan", "jensenshannon", "mountford", "tripartite", "similarityratio", "mcconnaughey", "lancewilliams"):
        got = similarity.sparse_similarity(name, stats).first()["similarity"]
        assert got == pytest.approx(dense(spark, name, dx, dy, normalise=False)), name


def test_measure_names():
    assert similarity.measure_name("cos") == "cosine"
    with pytest.raises(ValueError):
        similarity.measure_name("b")


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], kinds) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=8), st.lists(st.integers(0, 5), max_size=8))
def test_list_rules(spark, a, b):
    ca, cb = F.col("a"), F.col("b")
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    got = df.select(lists.difference(ca, cb), lists.intersection(ca, cb), lists.union(ca, cb), lists.equivalent(ca, cb), lists.contains_run(ca, cb), lists.bit_or(ca, cb)).first()
    assert got[0] == [x for x in a if x not in b]
    assert got[1] == [x for x in a if x in b]
    assert got[2] == [x for x in b if x not in a] + a
    assert got[3] == (len(a) == len(b) and set(a) == set(b))
    assert got[4] == any(a[k : k + len(b)] == b for k in range(len(a) - len(b) + 1))
    assert len(got[5]) == max(len(a), len(b))


def test_list_edits(spark):
    a = ("array<int>", [5, 6, 7, 6])
    assert one(spark, lists.position(F.col("a"), F.lit(6)), a=a) == 1
    assert one(spark, lists.last_position(F.col("a"), F.lit(6)), a=a) == 3
    assert one(spark, lists.subsequence(F.col("a"), F.lit(1), F.lit(2)), a=a) == [6, 7]
    assert one(spark, lists.insert_at(F.col("a"), F.lit(1), F.array(F.lit(9))), a=a) == [5, 9, 6, 7, 6]
    assert one(spark, lists.elide(F.col("a"), F.lit(1), F.lit(2)), a=a) == [5, 6]
    assert one(spark, lists.set_nth(F.col("a"), F.lit(0), F.lit(1)), a=a) == [1, 6, 7, 6]
    assert one(spark, lists.push_new(F.col("a"), F.lit(6)), a=a) == [5, 6, 7, 6]


def test_scalars(spark):
    t = lambda c, v: one(spark, c, t=("string", v))
    assert t(scalars.parse_radix(F.col("t")), "#xFF") == 255
    assert t(scalars.parse_radix(F.col("t")), "#36rZ") == 35
    assert t(scalars.parse_radix(F.col("t")), "-12") == -12
    assert t(scalars.parse_radix(F.col("t")), "abc") is None
    assert t(scalars.wildcard_match(F.col("t"), "a*c*"), "abbc*") and not t(scalars.wildcard_match(F.col("t"), "a*c*"), "abbc")
    assert t(scalars.regex_match(F.col("t"), "(cat,dog)s?"), "dogs") and not t(scalars.regex_match(F.col("t"), "(cat,dog)s?"), "hotdogs")
    assert t(scalars.regex_rewrite(F.col("t"), "([a-z]+)-([0-9]+)", "%2 %1 $"), "ab-12") == "12 ab $"
    assert t(scalars.url_decode(scalars.url_encode(F.col("t"))), "a b%~\\+c") == "a b%~\\+c"
    assert t(scalars.first_word(F.col("t")), "  one two ") == "one" and t(scalars.last_word(F.col("t")), "  one two ") == "two"
    assert t(scalars.common_prefix(F.col("t"), F.lit("abd")), "abc") == "ab"
    assert one(spark, scalars.sniff_encoding(F.col("b")), b=("binary", "hé".encode("utf-16"))) == "utf-16le"
    assert one(spark, scalars.sniff_encoding(F.col("b")), b=("binary", "he".encode("utf-16-be"))) == "utf-16be"


def test_tokens_and_sentences(spark):
    assert text.split_words("Don't pay 1,234.5 for a 12-ton e.g. well-known thing.") == ["Don't", "pay", "1,234.5", "for", "a", "12", "-", "ton", "e.g.", "well-known", "thing", "."]
    s = "Dr. Smith came. He left! J. Doe stayed: why? \n\nNew one. and so on"
    at = [0, *text.sentence_ends(s), len(s)]
    assert [s[a:b].strip() for a, b in zip(at, at[1:])] == ["Dr. Smith came.", "He left!", "J. Doe stayed: why?", "New one. and so on"]
    assert text.plain_text("<h1>A</h1><p>b &amp; c<br>d<li>e<!-- x --><img alt='pic'>").split("\n")[-1].endswith("e [pic]")


def test_html_links(spark):
    html = '<!-- <a href="no"> --><base href="http://h.org/d/p.html"><a href="x.html">1</a><A HREF=/y>2</A><a href=\'http://o.net/\'>3</a><a href="x.html">'
    df = spark.createDataFrame([(1, "http://z.com/", html)], "page_id long, url string, html string")
    assert {r[1] for r in text.html_links(df).collect()} == {"http://h.org/d/x.html", "http://h.org/y", "http://o.net/"}


def test_longest_match_and_vocabulary(spark):
    a = spark.createDataFrame([("x y z",), ("x y",), ("y z",)], "text string")
    arrays = ngrams.word_arrays(a)
    assert tuple(ngrams.longest_match(arrays, ["x", "y", "q"]).first()) == (2, 2)
    assert tuple(ngrams.longest_match(arrays, ["q"]).first()) == (0, 0)
    assert ngrams.parse_smoothing("STUPID_BACKOFF-0.3") == ("stupid_backoff", 0.3)
    tok = ngrams.positions(a.withColumn("r", F.monotonically_increasing_id()), "r")
    assert sorted(r.words for r in ngrams.rebuild(tok).collect()) == [["x", "y"], ["x", "y", "z"], ["y", "z"]]
    # No n-gram crosses a record.
    assert ngrams.ngram_counts(arrays, 2).agg(F.sum("n")).first()[0] == 4


def fillers(spark, rows):
    return spark.createDataFrame([(f, s, c, p, v) for f, s, c, p, v in rows], frames.FILLERS)


def test_zero_bytes_are_counted_to_the_end(spark):
    for kind in ("utf-16-le", "utf-16-be"):
        late = ("\u4e01" * 100 + "late").encode(kind)
        assert one(spark, scalars.sniff_encoding(F.col("b")), b=("binary", late)) == kind.replace("16-", "16")
    assert one(spark, scalars.sniff_encoding(F.col("b")), b=("binary", b"x" * 100 + b"\n")) == "ascii"


def test_clusters_beyond_the_bound_raise(spark, monkeypatch):
    from tessera.operators import clustering

    monkeypatch.setattr(clustering, "MOST_CENTROIDS", 3)
    v = spark.createDataFrame([(k, [float(k == j) for j in range(5)]) for k in range(5)], "id long, v array<double>")
    assert clustering.diversity_sample(v, 4).count() == 4
    with pytest.raises(ValueError):
        clustering.multipass(v, 0.9, 5).collect()


def test_no_mode_without_code():
    assert "user" not in frames.MODES and len(frames.MODES) == 8


def test_inheritance_modes(spark):
    from tessera.plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    V = "VALUE"
    f = fillers(
        spark,
        [("x", "INSTANCE-OF", V, 0, "a"), ("x", "IS-A", V, 0, "q"), ("a", "IS-A", V, 0, "b"), ("a", "IS-A", V, 1, "c"), ("b", "IS-A", V, 0, "d"), ("d", "IS-A", V, 0, "a"), ("d", "S", V, 0, "deep"), ("c", "S", V, 0, "near"), ("q", "S", V, 0, "isa"), ("x", "S", "INHERITS", 0, "q"), ("x", "PART-OF", V, 0, "w"), ("w", "S", V, 0, "whole")],
    )
    asked = spark.createDataFrame([("x",)], "frame string")
    got = {m: [r.value for r in frames.inherit(f, "S", mode=m, frames=asked).collect()] for m in ("none", "simple", "dfs", "bfs", "part_bfs", "part_dfs", "local_dfs", "local_bfs", "whatever")}
    assert got == {"none": [], "simple": ["deep"], "dfs": ["deep"], "bfs": ["near"], "part_bfs": ["whole"], "part_dfs": ["whole"], "local_dfs": ["isa"], "local_bfs": ["isa"], "whatever": ["deep"]}


def test_long_chains_are_walked_to_the_top(spark):
    from tessera.plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    n = 300
    links = [(f"{k}", slot, "VALUE", 0, f"{k + 1}") for k in range(n) for slot in ("IS-A", "PART-OF")]
    # A ring that leads nowhere, and one passed on the way.
    links += [("r", "IS-A", "VALUE", 0, "t"), ("t", "IS-A", "VALUE", 0, "r"), ("250", "IS-A", "VALUE", 1, "249")]
    f = fillers(spark, links + [(f"{n}", "S", "VALUE", 0, "top")])
    asked = spark.createDataFrame([("0",), ("r",), ("150",)], "frame string")
    for mode in ("simple", "dfs", "bfs", "part_bfs"):
        assert sorted((r.frame, r.source, r.value) for r in frames.inherit(f, "S", mode=mode, frames=asked).collect()) == [("0", f"{n}", "top"), ("150", f"{n}", "top")]
    chain = frames.closure(f.where("slot = 'PART-OF'").select(F.col("frame").alias("child"), F.col("value").alias("parent")))
    assert chain.count() == n * (n + 1) // 2 and chain.where("depth != int(ancestor) - int(child)").isEmpty()
    assert frames.part_of(f, spark.createDataFrame([("0", f"{n}")], "frame string, ancestor string")).first().part_of
    assert frames.collect_slots(f).where("frame = '0' AND slot = 'S'").first().source == f"{n}"


def test_frame_edits(spark):
    rel = frames.relations(spark)
    f = fillers(spark, [("a", "IS-A", "VALUE", 0, "b")])
    f = frames.with_inverses(f, rel)
    assert {(r.frame, r.slot, r.value) for r in f.collect()} == {("a", "IS-A", "b"), ("b", "SUBCLASSES", "a")}
    f = frames.add_fillers(f, spark.createDataFrame([("a", "COLOR", "VALUE", "red"), ("a", "COLOR", "VALUE", "red"), ("a", "COLOR", "VALUE", "blue")], "frame string, slot string, facet string, value string"))
    assert f.where("slot = 'COLOR'").count() == 2
    gone = frames.erase(f, spark.createDataFrame([("a", "IS-A")], "frame string, slot string"), rel)
    assert gone.where("slot != 'COLOR'").count() == 0
    assert frames.rename_frame(f, "b", "z").where("value = 'z' OR frame = 'z'").count() == 2
    v = frames.store(frames.store(None, f, 1), frames.rename_frame(f, "b", "z"), 2, ["b"])
    assert frames.as_of(v, 1).where("frame = 'b'").count() == 1 and frames.as_of(v).where("frame = 'b'").count() == 0
    assert frames.as_of(frames.abort(v, 2)).where("frame = 'b'").count() == 1


def test_edits_keep_positions_and_inverses(spark):
    rel = frames.relations(spark)
    f = frames.with_inverses(fillers(spark, [("a", "IS-A", "VALUE", 0, "p"), ("a", "IS-A", "VALUE", 1, "q"), ("b", "IS-A", "VALUE", 0, "q"), ("q", "S", "VALUE", 0, "found"), ("a", "NOTE", "VALUE", 0, "q")]), rel)
    look = lambda g, frame, slot: [r.value for r in g.where((F.col("frame") == frame) & (F.col("slot") == slot)).orderBy("pos").collect()]
    # The link made last stands in front.
    assert look(f, "q", "SUBCLASSES") == ["b", "a"]
    asked = spark.createDataFrame([("a",)], "frame string")
    assert frames.inherit(f, "S", mode="simple", frames=asked).count() == 0
    for gone in (frames.erase(f, spark.createDataFrame([("a", "IS-A", "p")], "frame string, slot string, value string"), rel), frames.pop_fillers(f, spark.createDataFrame([("a", "IS-A", "VALUE")], "frame string, slot string, facet string"), rel)):
        assert gone.where("frame = 'a' AND slot = 'IS-A'").first().pos == 0 and look(gone, "p", "SUBCLASSES") == []
        assert frames.inherit(gone, "S", mode="simple", frames=asked).first().value == "found"
    renamed = frames.rename_frame(f, "q", "z", rel)
    assert look(renamed, "a", "IS-A") == ["p", "z"] and look(renamed, "a", "NOTE") == ["q"] and look(renamed, "z", "S") == ["found"]
    swapped = frames.replace_filler(f, "a", "IS-A", "VALUE", "p", "r", rel)
    assert look(swapped, "a", "IS-A") == ["r", "q"] and look(swapped, "p", "SUBCLASSES") == [] and look(swapped, "r", "SUBCLASSES") == ["a"]
    other = frames.replace_facet(f, "a", "IS-A", "VALUE", ["x", "y"], rel)
    assert look(other, "a", "IS-A") == ["x", "y"] and look(other, "q", "SUBCLASSES") == ["b"] and look(other, "y", "SUBCLASSES") == ["a"]
    erased = frames.erase_frame(f, "q", rel)
    assert look(erased, "a", "IS-A") == ["p"] and look(erased, "b", "IS-A") == [] and look(erased, "a", "NOTE") == ["q"] and erased.where("frame = 'q'").count() == 0
    assert look(frames.copy_frame(f, "b", "c", rel), "q", "SUBCLASSES")[0] == "c"
    assert {r.frame for r in frames.frames_with_prefix(f, "Q").collect()} == {"q"}


def test_maps_and_vocabulary(spark):
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, maps.get(maps.put_new(m, "a", F.lit(9)), "a")) == 1 and one(spark, maps.get(maps.put_new(m, "b", F.lit(9)), "b")) == 9
    assert one(spark, maps.compare(F.lit(None).cast("int"), F.lit(1))) == -1 and one(spark, maps.compare(F.lit(2), F.lit(2))) == 0
    assert one(spark, maps.set_range(F.array(F.lit(0)), 2, 3)) == [0, 0, 1, 1]
    known = spark.createDataFrame([("b", 1), ("d", 2)], "word string, id long")
    grown = maps.extend_vocabulary(known, spark.createDataFrame([("c",), ("a",), ("b",), ("c",)], "word string"))
    assert {(r.word, r.id) for r in grown.collect()} == {("b", 1), ("d", 2), ("a", 3), ("c", 4)}
    assert {(r.word, r.id) for r in maps.word_ids(spark.createDataFrame([("d",), ("x",)], "word string"), known).collect()} == {("d", 2), ("x", 0)}
    assert [r.word for r in maps.words_of_ids(spark.createDataFrame([(0,), (2,)], "id long").orderBy("id"), known).orderBy("id").collect()] == [None, "d"]


def test_clustering_entry(spark):
    rows = [(k, [1.0, 0.01 * k]) for k in range(10)] + [(k, [0.01 * k, 1.0]) for k in range(10, 20)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for parameters in ("method=gac,threshold=0.8,clusters=5", "method=multi,threshold=0.8,clusters=5", "method=agglom,threshold=0.8,clusters=2", "method=kmeans,clusters=2,iterations=5", "method=kmeans_hclust,clusters=2"):
        groups = {}
        for r in clustering.cluster(v, parameters).collect():
            groups.setdefault(r.cluster, set()).add(int(r.id) < 10)
        assert len(groups) == 2 and all(len(g) == 1 for g in groups.values()), parameters
    with pytest.raises(ValueError):
        clustering.cluster(v, "method=growseed")
    with pytest.raises(NotImplementedError):
        clustering.cluster(v, "rep=nearest,method=agglomerative", v.select(F.lit("a").alias("key"), "v"))


def test_spelling_and_entities(spark):
    vocab = spark.createDataFrame([("the", 100), ("then", 10), ("he", 50), ("at", 5), ("cat", 7)], "word string, freq long")
    words = spark.createDataFrame([("teh",), ("thecat",)], "word string")
    got = {(r.word, r.candidate) for r in spelling.suggest(words, vocab).collect()}
    assert got == {("teh", "the"), ("thecat", "the cat")}
    e = one(spark, spelling.entities(F.col("t"), "<%t:%s>"), t=("string", "see <city:New York> and <name:Al>"))
    assert [(x["text"], x["type"]) for x in e] == [("New York", "city"), ("Al", "name")]


def test_spans(spark):
    s = spans.from_json(spark.createDataFrame([(1, '[{"start":0,"end":2,"score":2,"text":"abc"},{"start":3,"end":4,"text":"de"},{"start":0,"end":2,"score":3,"text":"abc","meta":{"k":"v"}}]')], "d long, j string"), "d", "j")
    c = spans.combine(s, "product", "max")
    assert c.where("text = 'abc'").first()["score"] == pytest.approx(6.0)
    m = spans.merge_adjacent(c, c, "add").first()
    assert (m["start"], m["end"], m["text"]) == (0, 4, "abc de")


def test_clustering(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9])], "id long, v array<double>")
    groups = lambda df: {frozenset(r[0]) for r in df.groupBy("cluster").agg(F.collect_set("id")).select("collect_set(id)").collect()}
    want = {frozenset({1, 2}), frozenset({3, 4})}
    assert groups(clustering.k_means(v, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], 5)) == want
    assert groups(clustering.agglomerative(v, 2, 0.9)) == want
    assert groups(clustering.incremental(v, 0.8, 10)) == want
    grown = clustering.grow_seeds(v, spark.createDataFrame([("a", [1.0, 0.0])], "key string, v array<double>"), 0.5)
    assert {r["id"]: r["cluster"] for r in grown.collect()} == {1: "a", 2: "a", 3: None, 4: None}
    p = ClusterParameters.parse("method=growseed,measure=jac,clusters=7,hard_limit=no")
    assert (p.method, p.measure, p.clusters, p.hard_limit) == ("growseed", "jaccard", 7, False)
    with pytest.raises(ValueError):
        ClusterParameters.parse("method=k")
    with pytest.raises(NotImplementedError):
        ClusterParameters.parse("method=tight")


def test_term_vectors(spark):
    a = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 2.0)], "key string, term string, weight double")
    b = spark.createDataFrame([("k", "y", 5.0)], "key string, term string, weight double")
    assert {r.term: r.weight for r in term_vectors.merged(a, b).collect()} == {"x": 1.0, "y": 7.0}
    assert {r.term: r.weight for r in term_vectors.merged(a, b, use_max=True).collect()} == {"x": 1.0, "y": 5.0}


def test_files(spark, tmp_path):
    (tmp_path / "steps").write_text("(1 0.5) (10 0.25)\n")
    assert files.load_steps(spark, str(tmp_path / "steps")) == [(1, 0.5), (10, 0.25)]
    (tmp_path / "lines").write_text("abc\ndef\nghi\n")
    assert [r.value for r in files.byte_range(spark, str(tmp_path / "lines"), 1, 8).orderBy("at").collect()] == ["def"]
    (tmp_path / "conf").write_text("; comment\n[spark]\nspark.sql.shuffle.partitions = 4\n[a]\nsize: 12\ninclude more\n")
    (tmp_path / "more").write_text("names = x y\n")
    s = Settings({"size": "integer", "names": "list"}).load(str(tmp_path / "conf"))
    assert s.get("size", "a") == 12 and s.get("names", "a") == ["x", "y"] and len(s.describe()) == 3


def test_base64_of_long_texts_is_one_line(spark):
    texts = ["", "a" * 57, "a" * 58, "\u00e9" * 200]
    got = {r.t: r.b for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", scalars.base64_line(F.col("t")).alias("b")).collect()}
    assert got == {x: base64.b64encode(x.encode()).decode() for x in texts}
