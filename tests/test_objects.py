"""The object reader and printer, iterators as table functions, match sets, feature maps."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import features
from tessera.operators import iterators, phrases
from tessera.operators.spans import build
from tessera.sources import objects

SYMBOL = st.text(st.characters(codec="utf-8", exclude_characters="|", exclude_categories=("Cs",)), min_size=1, max_size=8).map(lambda s: {"symbol": s})
ATOM = st.one_of(st.integers(-(10**20), 10**20), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(exclude_categories=("Cs",)), max_size=10), SYMBOL, st.text("01", max_size=9).map(lambda b: {"bits": b}), st.tuples(st.integers(-99, 99), st.integers(1, 99)).map(lambda p: {"rational": list(p)}))
VALUE = st.recursive(ATOM, lambda v: st.one_of(st.lists(v, max_size=4), *[st.lists(v, max_size=4).map(lambda x, k=k: {k: x}) for k in ("array", "queue")], *[st.lists(st.tuples(v, v).map(list), max_size=3).map(lambda x, k=k: {k: x}) for k in ("hash", "sparse")]), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUE, max_size=4))
def test_what_is_shown_is_read_again(values):
    assert objects.parse("\n".join(map(objects.show, values))) == values


def test_syntax():
    text = """(a "b \\" c" 12 -1.5 3/4 |x Y|) ; a comment ( "
    #S(POINT :X 1 :Y (2 3)) #*0101 #A(1 2) #H(a 1 b "c") #SpArr(1 2.0) #Q() 'q nil .5 1e3
    [F [IS-A [VALUE "x" 1]]]"""
    got = objects.parse(text)
    assert [objects.kind_of(v) for v in got] == ["list", "struct", "bits", "array", "hash", "sparse", "queue", "list", "list", "float", "float", "frame"]
    assert got[0] == [{"symbol": "A"}, 'b " c', 12, -1.5, {"rational": [3, 4]}, {"symbol": "x Y"}] and got[1]["fields"] == [["X", 1], ["Y", [2, 3]]]
    for wrong in ("(a", "a)", "[a)", '"open', "#S(A B)", "#H(1)"):
        with pytest.raises(objects.Unreadable):
            objects.parse(wrong)
    deep = "(" * 50_000 + ")" * 50_000
    assert objects.show(objects.parse(deep)[0]).startswith("((((")
    assert objects.parse("a $x$ b", {"$": lambda t, k: ({"math": t[k + 1 : t.index("$", k + 1)]}, t.index("$", k + 1) + 1)}) == [{"symbol": "A"}, {"math": "x"}, {"symbol": "B"}]


def test_objects_over_splits(spark, tmp_path):
    """However files are cut, the same objects are found: lists, strings and symbols over many lines, and comments that look like them."""
    rng = random.Random(1)
    texts, want = [], []
    for n in range(3):
        lines = []
        for k in range(60):
            value = rng.choice([[{"symbol": f"S{k}"}, ["a\n(b ; c", k]], "line\n\n| \" (\nend", {"symbol": "bar\n(\n; \""}, [[], [k, [k, [str(n) * 30]]]], k])
            shown = objects.show(value)
            lines.append(shown.replace(" ", "\n  ") if isinstance(value, list) and rng.random() < 0.5 and "b ;" not in shown else shown)
            if rng.random() < 0.2:
                lines.append('; (not "an |object')
            want.append(json.dumps(objects.parse(lines[-1] if not lines[-1].startswith(";") else lines[-2])[0], ensure_ascii=False))
        texts.append("\n".join(lines))
        (tmp_path / f"f{n}.txt").write_text(texts[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "700b", "150b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = objects.read_objects(spark, str(tmp_path)).collect()
            assert sorted(r.value for r in got) == sorted(want)
            assert len({(r.file, r.line, r.number) for r in got}) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_unreadable_and_empty_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("12\n(1 2))\nfoo\n(open")
    (tmp_path / "b.txt").write_text("")
    got = sorted((r.type, r.value) for r in objects.read_objects(spark, str(tmp_path)).collect())
    assert ("integer", "12") in got and ("symbol", '{"symbol": "FOO"}') in got and sum(t == "unreadable" for t, _ in got) == 2
    assert [r.text for r in objects.print_objects(spark.createDataFrame([("[1, \"x\"]",), (None,)], "value string")).collect()] == ['(1 "x")', None]


def test_frames_of_both_syntaxes(spark, tmp_path):
    (tmp_path / "f.txt").write_text('(MAKE-FRAME DOG (IS-A (VALUE ANIMAL "pet \\"x\\"")) (LEGS (VALUE 4)))\n[CAT [IS-A [VALUE "ANIMAL"]]]\n(OTHER THING)')
    got = objects.object_fillers(objects.read_objects(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in got) == [("CAT", "IS-A", "VALUE", 0, "ANIMAL"), ("DOG", "IS-A", "VALUE", 0, "ANIMAL"), ("DOG", "IS-A", "VALUE", 1, 'pet "x"'), ("DOG", "LEGS", "VALUE", 0, "4")]
    fillers = spark.createDataFrame([("F", "S", "V", 0, 'a "q" \\ é'), ("F", "S", "V", 1, "two\nlines"), ("F", "T", "W", 0, "")], "frame string, slot string, facet string, pos long, value string")
    objects.print_objects(objects.frame_objects(fillers)).write.text(str(tmp_path / "out"))
    again = objects.object_fillers(objects.read_objects(spark, str(tmp_path / "out"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, fillers.collect()))


# Table functions

def test_ngram_visitors(spark):
    arrays = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"]), (3, None), (4, ["c", "d", "e", "f"])], "id long, words array<string>")

    def visit(gram, state):
        state["n"] = state.get("n", 0) + 1
        return iterators.STOP if gram[0] == "e" else [(gram[0], state["n"]), (gram[1], -state["n"])] if gram[0] != "b" else None

    got = sorted((r.id, r.w, r.k) for r in iterators.visit_ngrams(arrays, 2, "w string, k int", visit).collect())
    assert got == sorted([(1, "a", 1), (1, "b", -1), (4, "c", 1), (4, "d", -1), (4, "d", 2), (4, "e", -2)])


def test_span_rewriters(spark):
    spans = build(spark.createDataFrame([(1, "one two three"), (2, "two")], "id long, t string"), "id", "t").select("doc", "start", "end", "text")

    def rewrite(s):
        return {"one": None, "two": True}.get(s["text"], [s | {"text": "x"}, s | {"text": "y"}])

    got = sorted((r.doc, r.start, r.text) for r in iterators.rewrite_spans(spans, rewrite).collect())
    assert got == [(1, 3, "two"), (1, 6, "x"), (1, 6, "y"), (2, 0, "two")]


def test_spans_go_to_a_rewriter_in_batches(spark):
    spans = build(spark.createDataFrame([(k, "ab cde f") for k in range(300)], "id long, t string"), "id", "t").withColumn("meta", F.create_map(F.lit("k"), F.col("text"))).withColumn("inner", F.struct("start", "text"))
    found = iterators.rewrite_spans(spans, lambda s: s | {"text": s["meta"]["k"] + s["inner"]["text"], "meta": {}} if s["start"] else s["end"] == 1)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema.names == spans.columns
    assert sorted((r.doc, r.start, r.text, r.meta, r.inner.text) for r in found.collect()) == [x for k in range(300) for x in ((k, 0, "ab", {"k": "ab"}, "ab"), (k, 2, "cdecde", {}, "cde"), (k, 5, "ff", {}, "f"))]


# Match sets and features

def test_match_lengths(spark):
    rng = random.Random(2)
    texts = {k: [rng.choice("abcd") for _ in range(rng.randint(0, 25))] for k in range(12)}
    tok = spark.createDataFrame([(k, i, w) for k, t in texts.items() for i, w in enumerate(t)], "rec long, pos int, word string")
    steps = [{"a", "b"}, {"a", "c"}, {"d", "a"}, {"b"}]
    candidates = spark.createDataFrame([(s, w) for s, ws in enumerate(steps) for w in ws] + [(0, "a"), (2, None), (5, "c")], "step int, word string")
    want = set()
    for k, t in texts.items():
        for i in range(len(t)):
            n = 0
            while n < 4 and i + n < len(t) and t[i + n] in steps[n]:
                n += 1
            if n:
                want.add((k, i, n))
    assert {tuple(r) for r in phrases.match_lengths(tok, candidates).collect()} == want
    begun = tok.where("word = 'a'").select("rec", F.col("pos").alias("start"), F.col("pos").alias("end"))
    longer, rest = phrases.extend_matches(begun, tok, spark.createDataFrame([("c",), ("d",), ("c",)], "word string"))
    both = {(k, i): t[i + 1 : i + 2] in (["c"], ["d"]) for k, t in texts.items() for i, w in enumerate(t) if w == "a"}
    assert {(r.rec, r.start) for r in longer.collect()} == {p for p, x in both.items() if x} and {(r.rec, r.start) for r in rest.collect()} == {p for p, x in both.items() if not x}
    assert all(r.end == r.start + 1 for r in longer.collect())


def test_feature_maps_keep_their_indices(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    first = features.extend_features(names("b", "a", "b", None))
    second = features.extend_features(names("c", "a", "0"), first)
    assert {r["name"]: r["index"] for r in second.collect()} == {"a": 0, "b": 1, "0": 2, "c": 3}
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "a", 1.0), (1, "zzz", 9.0), (2, "zzz", 1.0), (3, "b", 0.0), (3, "c", 4.0)], "id long, name string, value double")
    got = {r["id"]: r["vector"] for r in features.feature_vectors(rows, second).collect()}
    assert got == {1: {0: 3.0}, 2: {}, 3: {3: 4.0}}
    v = features.feature_vectors(rows, second)
    assert sorted(map(tuple, features.feature_names(v, second).collect())) == [(1, "a", 3.0), (3, "c", 4.0)]
    met = v.alias("x").crossJoin(v.alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), features.dot(F.col("x.vector"), features.scaled(F.col("y.vector"), 2.0)).alias("d"))
    assert {(r.a, r.b): r.d for r in met.collect() if r.d} == {(1, 1): 18.0, (3, 3): 32.0}


# Smaller additions

def test_span_metadata_and_texts(spark):
    from tessera.operators import spans

    words = build(spark.createDataFrame([(1, "one two three"), (2, "")], "id long, t string"), "id", "t")
    marked = spans.set_meta(spans.set_meta(words, "a", F.col("text")), "b", F.lit("x"))
    copied = spans.copy_meta(marked, spans.set_meta(words, "a", F.lit("old")), ["a"])
    assert {r.text: r.meta for r in copied.collect()} == {w: {"a": w} for w in ("one", "two", "three")}
    assert all(r.meta == {"b": "x"} for r in spans.clear_meta(marked, "a").collect()) and all(r.meta == {} for r in spans.clear_meta(marked).collect())
    ranges = spark.createDataFrame([(1, 2, 3), (1, 50, 60), (2, 0, 9), (1, 2, 3)], "doc long, first int, last int")
    assert sorted((r.doc, r.first, r.text, r.words) for r in spans.text_of(words, ranges).collect()) == [(1, 2, "one two", 2), (1, 2, "one two", 2), (1, 50, "", 0), (2, 0, "", 0)]


def test_inheritance_by_a_function(spark):
    from tessera.operators import frames
    from tessera.plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    rows = [("A", "IS-A", "B"), ("B", "IS-A", "C"), ("C", "IS-A", "A"), ("B", "N", "b"), ("C", "N", "c"), ("D", "INSTANCE-OF", "A")]
    f = spark.createDataFrame([(x, s, "VALUE", 0, v) for x, s, v in rows] + [("C", "N", "VALUE", 1, "c2")], frames.FILLERS)
    far = frames.inherit_by(f, "N", lambda frame, c: None if frame == "B" else len(c) - 1)
    assert sorted((r.frame, r.source, r.value) for r in far.collect()) == [("A", "C", "c"), ("A", "C", "c2"), ("C", "B", "b"), ("D", "C", "c"), ("D", "C", "c2")]
    near = frames.inherit_by(f, "N", lambda frame, c: 0, frames=spark.createDataFrame([("D",)], "frame string"))
    assert [(r.frame, r.source, r.pos, r.value) for r in near.collect()] == [("D", "B", 0, "b")]


def test_canonical_lines_and_tables(spark, tmp_path):
    from tessera.functions import text
    from tessera.sources import files

    (tmp_path / "l.txt").write_text("Don't stop,now\n\n  a  b ")
    assert [r.value for r in files.canonical_lines(spark, str(tmp_path / "l.txt"), upper=True).collect()] == ["DON'T STOP , NOW", "", "A B"]
    df = spark.createDataFrame([("né-ł_x½",)], "t string")
    cut = lambda e, *more: df.select(text.split_by_table(F.col("t"), e, *more).alias("w")).first().w
    assert cut("latin-1") == ["né", "x½"] and cut("latin-2") == ["né", "ł", "x"] and cut("utf-8") == ["né", "ł", "x½"] and cut("raw") == ["n", "x"] and cut("raw", "-_") == ["n", "-", "_x"]


def test_lines_of_a_block_are_joined_where_they_are(spark):
    """What begins and ends within a block leaves it as a whole; outcomes equal those of reading line by line from each state."""
    import pyarrow as pa

    lines = ["b c)", "(x", "y)", "12", '"a ( ;', '(" 7', "; | (", "|p", "(|", "(open", "more"]
    column = lambda v, t: pa.array([v] * len(lines), t)
    of = [column("f", pa.string()), column(3, pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines)]
    names = ["file", "block", "k", "value", "state", "depth"]
    batch = pa.RecordBatch.from_arrays([*of, column(objects.PLAIN, pa.int32()), column(1, pa.int64())], names=names)
    cut = [batch.slice(0, 2), batch.slice(2, 4), batch.slice(6)]
    found = [r for b in objects._begins(cut) for r in b.to_pylist()]
    assert [(r["own"], r["value"], r["inner"]) for r in found] == [(None, "b c)", False), (1, "(x\ny)", True), (3, "12", True), (4, '"a ( ;\n(" 7', True), (6, "; | (", True), (7, "|p\n(|", True), (9, "(open\nmore", False)]
    want = []
    for state in range(3):
        depth = 0
        for line in lines:
            state, change, _ = objects.scan(line, state)
            depth += change
        want.append((state, depth))
    (row,) = [r for b in objects._outcomes(cut) for r in b.to_pylist()]
    assert list(zip(row["states"], row["depths"])) == want
