"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with the same shingle set are one class. Each class is posted under (coordinate, value) pairs of its
signature. Two classes that agree in at least ``SHARED`` of the ``POSTED`` coordinates share one of the
``PREFIX`` rarest pairs of each, in one order of all pairs by the length of their lists; so lists of pairs that many unrelated
documents hold are mostly skipped. In a list, collisions over all coordinates are counted on one byte each, skipping pairs that are
connected already, and links of a spanning forest of those with at least ``MATCHES`` leave it. What the lists connect is
confirmed on the full shingle sets, where again a spanning forest of the true links leaves each group.

In a long list, or a large component of candidates, every member is first compared with one head, the member that collides most. Those
linked with it are the core. Only pairs with a member outside the core are left, and these meet in pairs of blocks; a
group that is all core is done. Copies never travel more than once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..plans.session import spread
from .graph import components
from .store import Tables, named, row_columns, whole_row
from .words import Words, binary_column, group_bounds, key_groups, list_column, mix, pieces

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two documents.
PERCENT = 85
#: Coordinates of a signature, and least collisions of a link: a similarity of 0.85 has fewer with a chance of 1.3e-9.
COORDINATES, MATCHES = 128, 82
#: Coordinates that are posted, and least collisions among them: fewer with a chance of 1.5e-9. So many of the rarest hold a shared one.
POSTED, SHARED = 64, 35
PREFIX = POSTED - SHARED + 1
#: Members of a posting list, and classes and shingles of a component, that meet in one block.
LIST_BLOCK, TEXT_BLOCK, SHINGLE_BLOCK = 2048, 2000, 800_000
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their number for each text."""
    w = Words(texts, fold=True)
    counts = np.diff(w.first)
    long = np.maximum(counts - size + 1, 0)
    # Starts of full shingles: every word but the last size - 1 of a text.
    number = np.arange(len(w.hash)) - w.first[w.text]
    at = np.flatnonzero(number < long[w.text])
    full = np.zeros(len(at), np.uint64)
    for k in range(size):
        full = full * _MIX[0] + mix(w.hash[at + k] + _MIX[1 + k])
    text = w.text[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for k, t in enumerate(short):
            h = np.zeros(1, np.uint64) + _MIX[8 + counts[t]]
            for x in w.hash[w.first[t] : w.first[t + 1]]:
                h = mix(h * _MIX[7] + x)
            own[k] = h[0]
        full, text = np.concatenate([full, own]), np.concatenate([text, short])
    full = mix(full)
    order = np.lexsort((full, text))
    full, text = full[order], text[order]
    first = np.ones(len(full), bool)
    first[1:] = (full[1:] != full[:-1]) | (text[1:] != text[:-1])
    return full[first], np.bincount(text[first], minlength=len(texts))


def _set_names(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: sums over its elements; zero for empty ones."""
    h1, h2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        h1[some] = np.add.reduceat(mix(sets + _MIX[13]), at)
        h2[some] = np.add.reduceat(mix(sets ^ _MIX[14]), at)
    return h1.view(np.int64), h2.view(np.int64)


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signature of each set; zeros for empty ones."""
    out = np.zeros((len(counts), COORDINATES), np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        for k in range(COORDINATES):
            out[some, k] = np.minimum.reduceat((sets ^ _B[k]) * _A[k], at) >> np.uint64(32)
    return out


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t1, t2, text) to the row's names, those of its set, its posted values, and one byte of each coordinate."""
    for batch in pieces(batches, 3, 1 << 21):
        sets, counts = shingle_sets(batch.column(3))
        h1, h2 = _set_names(sets, counts)
        signature = signatures(sets, counts)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(h1), pa.array(h2), list_column(signature[:, :POSTED].ravel().view(np.int32), np.full(batch.num_rows, POSTED), pa.int32()), binary_column(signature.astype(np.uint8))],
            names=["id", "t1", "t2", "n_shingles", "h1", "h2", "tokens", "sketch"],
        )


def _forest(core: np.ndarray, neighbours) -> list[tuple[int, int]]:
    """Links of 0..n-1, as stars around their least numbers: neighbours(x, rest) gives those of ``rest`` that x is linked with; members of the core are connected already."""
    queue, rest, out = np.flatnonzero(core).tolist(), np.flatnonzero(~core), []
    tree = queue[:1]
    while len(rest) and (queue or not len(tree)):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            tree = queue[:]
        while queue and len(rest):
            linked = neighbours(queue.pop(), rest)
            if linked.any():
                found = rest[linked].tolist()
                rest = rest[~linked]
                tree += found
                queue += found
        least = min(tree)
        out += [(least, y) for y in tree if y != least]
        queue, tree = [], []
    return out


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _to_head(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cid, sketch, head) to (key, cid, core): whether a member's sketch has enough collisions with that of the head of its list."""
    for batch in batches:
        own, head = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((own == head).sum(1) >= MATCHES)], names=["key", "cid", "core"])


def _collide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (key, i, j, cid, core, sketch) to links of pairs with enough collisions."""
    for t in key_groups(batches, 3):
        cols = [t.column(k).to_numpy() for k in range(5)]
        data = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(t), COORDINATES)
        bounds = group_bounds(cols[:3])
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low < 2:
                continue
            s, cid = data[low:high], cols[3][low:high]
            for x, y in _forest(cols[4][low:high], lambda x, rest, s=s: (s[rest] == s[x]).sum(1) >= MATCHES):
                a.append(int(cid[x]))
                b.append(int(cid[y]))
        yield _links(a, b)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, cid, members, shingles, head, text) to (component, cid, members, shingles, head, n, set); a class that comes again in a row is left out."""
    last = None
    for batch in pieces(batches, 5, 1 << 21):
        cid = batch.column(1).to_numpy()
        new = np.ones(len(cid), bool)
        new[1:] = cid[1:] != cid[:-1]
        new[:1] = cid[:1] != last
        last = cid[-1]
        part = batch.filter(pa.array(new))
        if not part.num_rows:
            continue
        sets, counts = shingle_sets(part.column(5))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 8
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(sets)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(counts, pa.int64()), packed], names=["component", "cid", "members", "shingles", "head", "n", "set"])


def _similar(both, x, y):
    return 100 * both >= PERCENT * (x + y - both)


def _to_head_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, cid, set, set of the head) to (component, cid, core): whether a member is linked with the head of its component."""
    for batch in batches:
        core = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            core.append(bool(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(core, pa.bool_())], names=["component", "cid", "core"])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (component, i, j, cid, core, set) to links of a forest of pairs that are similar enough on their full sets."""
    for t in key_groups(batches, 3):
        cols = [t.column(k).to_numpy() for k in range(5)]
        data = t.column(5).to_pylist()
        bounds = group_bounds(cols[:3])
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            # A class that two tasks met twice counts once.
            use = low + np.flatnonzero(np.append(True, np.diff(cols[3][low:high]) != 0))
            if len(use) < 2:
                continue
            cid, own = cols[3][use], [data[k] for k in use]
            counts = np.array([len(x) // 8 for x in own])
            sets, text = np.frombuffer(b"".join(own), np.uint64), np.repeat(np.arange(len(use)), counts)
            order = np.argsort(sets, kind="stable")
            values, owner = sets[order], text[order]
            begin = np.searchsorted(values, sets, "left")
            length = np.searchsorted(values, sets, "right") - begin
            first = np.cumsum(counts) - counts

            def similar(x, rest):
                s = slice(first[x], first[x] + counts[x])
                n = length[s]
                at = np.repeat(begin[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(cid))[rest]
                return _similar(both, counts[x], counts[rest])

            for x, y in _forest(cols[4][use], similar):
                a.append(int(cid[x]))
                b.append(int(cid[y]))
        yield _links(a, b)


def _core_and_left(compared: DataFrame, group: str, blocks) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect the core of each group, and (group, cid, core, i, j) for the pairs of blocks that are left to compare.

    compared: (group, cid, core) with the head in the core; blocks: the number of blocks of those that a condition holds for. Members of
    the core are in the first blocks and meet those of the others only; no core block meets another one, and a group without others has no rows.
    """
    sizes = compared.groupBy(group).agg(F.min(F.when(F.col("core"), F.col("cid"))).alias("least"), blocks(F.col("core")).cast("int").alias("c"), blocks(~F.col("core")).cast("int").alias("o"))
    met = compared.join(sizes, group)
    links = met.where("core").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    left = met.where("o > 0").withColumn("all", F.col("c") + F.col("o"))
    own = F.when(F.col("core"), F.pmod(F.xxhash64("cid"), F.col("c"))).otherwise(F.col("c") + F.pmod(F.xxhash64("cid"), F.col("o")))
    left = left.withColumn("own", own.cast("int")).withColumn("with", F.explode(F.sequence(F.when(F.col("core"), F.col("c")).otherwise(0), F.col("all") - 1)))
    # Pairs of different blocks hold the members of both; a block meets itself in each of them.
    left = left.where((F.col("all") == 1) | (F.col("with") != F.col("own")))
    return links, left.select(group, "cid", "core", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))


def _candidates(classes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect the pairs of classes with enough collisions in each list, and (cid, weight): the lengths of a class's lists added up."""
    posts = classes.select("cid", F.posexplode("tokens").alias("k", "v")).select("cid", (F.col("k").cast("long") * (1 << 32) + F.col("v")).alias("key"))
    met = posts.hint("merge").join(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    # A class has POSTED pairs at most. Those that it alone holds are the rarest; the prefix goes on with the shortest lists.
    own = met.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    own = own.withColumn("weight", F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    prefix = F.slice("own", 1, F.greatest(F.size("own") - (POSTED - PREFIX), F.lit(0)))
    own = tables.keep(own.select("cid", "weight", F.transform(prefix, lambda x: x["key"]).alias("keys")))
    posted = own.select("cid", "weight", F.explode("keys").alias("key"))
    lists = tables.keep(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "cid")).alias("head")).where("n > 1").select("key", "n", F.col("head.cid").alias("head")))
    sketches = classes.select("cid", "sketch")
    short = posted.join(lists.where(F.col("n") <= LIST_BLOCK), "key").join(sketches, "cid")
    dealt = short.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "cid", F.lit(False).alias("core"), "sketch")
    found, long = None, lists.where(F.col("n") > LIST_BLOCK)
    if long.limit(1).count():
        heads = long.join(sketches.withColumnRenamed("sketch", "of_head"), F.col("head") == F.col("cid")).select("key", "of_head")
        compared = tables.keep(posted.join(heads, "key").join(sketches, "cid").select("key", "cid", "sketch", "of_head").mapInArrow(_to_head, "key long, cid long, core boolean"))
        found, left = _core_and_left(compared, "key", lambda those: F.ceil(F.sum(those.cast("long")) / LIST_BLOCK))
        dealt = dealt.unionByName(left.join(sketches, "cid").select(*dealt.columns))
    links = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid").mapInArrow(_collide, "a long, b long")
    return links if found is None else links.unionByName(found), own.select("cid", "weight")


def _true_links(classes: DataFrame, found: DataFrame, weights: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) that hold on the full sets and connect what all such links within the candidates' components connect."""
    candidates = tables.keep(components(found, tables).withColumnRenamed("node", "cid").join(classes.select("cid", "at", "n_shingles"), "cid").join(weights, "cid"))
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"), F.max(F.struct("weight", "cid")).alias("head"))
    sized = candidates.join(sizes, "component").select("component", "cid", "members", "shingles", F.col("head.cid").alias("head"), "at")
    # By content: an id may stand on rows with other texts too. Both sides grow with the corpus, so neither is sent to all machines.
    met = sized.join(texts.hint("merge"), (F.col("at.t1") == F.col("t1")) & (F.col("at.t2") == F.col("t2")) & F.col("at.id").eqNullSafe(F.col("id"))).select("component", "cid", "members", "shingles", "head", "text")
    sets = tables.keep(met.mapInArrow(_sets, "component long, cid long, members long, shingles long, head long, n long, set binary"))
    large = (F.col("members") > TEXT_BLOCK) | (F.col("shingles") > SHINGLE_BLOCK)
    dealt = sets.where(~large).select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "cid", F.lit(False).alias("core"), "set")
    first, big = None, sets.where(large)
    if big.limit(1).count():
        heads = big.where("cid = head").groupBy("component").agg(F.first("set").alias("of_head"))
        compared = big.join(heads, "component").select("component", "cid", "set", "of_head").mapInArrow(_to_head_set, "component long, cid long, core boolean")
        compared = tables.keep(compared.join(big.select("cid", "n"), "cid").distinct())
        blocks = lambda those: F.greatest(F.ceil(F.sum(those.cast("long")) / TEXT_BLOCK), F.ceil(F.sum(F.when(those, F.col("n")).otherwise(0)) / SHINGLE_BLOCK))
        first, left = _core_and_left(compared, "component", blocks)
        dealt = dealt.unionByName(left.join(big.select("cid", "set"), "cid").select(*dealt.columns))
    links = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "cid").mapInArrow(_confirm, "a long, b long")
    return links if first is None else links.unionByName(first)


def _names(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, n_shingles, component_id) for every row."""
    tables = Tables(docs.sparkSession, "near")
    kind = docs.schema[id_col].dataType
    whole = ["n_shingles", "h1", "h2"]
    form = StructType([StructField("id", kind), *(StructField(c, LongType()) for c in ("t1", "t2", *whole)), StructField("tokens", ArrayType(IntegerType())), StructField("sketch", BinaryType())])
    texts = docs.select(F.col(id_col).alias("id"), *_names(F.col(text_col)), F.col(text_col).alias("text"))
    signed = tables.keep(texts.mapInArrow(_sign, form))
    # The smallest id names a class; ``at`` is one row that holds it.
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first(F.struct("id", "t1", "t2")).alias("at"), F.max("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = tables.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    joined = components(_true_links(classes, *_candidates(classes, tables), texts, tables), tables)
    named = classes.select("cid", "rep", "h1", "h2").join(joined, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = tables.keep(named.join(least, "component").select("h1", "h2", "component_id"))
    rows = signed.select("id", "t1", "t2", *whole).join(named, ["h1", "h2"], "left")
    return rows.select("id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Texts without words are linked with nothing, other empty ones included; very long texts are compared whole. Rows that share an id count as
    one document of several texts; the smallest id reachable names the component, null ids are named by other members (null if there is
    none). Other columns are ignored, whatever their names; no rows give no rows.
    """
    out = _grouped(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (all rows of that id whose texts are in the component). Columns may have any names."""
    plain = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    staying = _grouped(plain, "id", "text").where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("at"), "t1", "t2").distinct()
    marked = docs.select(whole_row(docs), named(id_col).alias("id"), *[c.alias(f"own{k}") for k, c in enumerate(_names(named(text_col)))])
    match = F.col("id").eqNullSafe(F.col("at")) & (F.col("own0") == F.col("t1")) & (F.col("own1") == F.col("t2"))
    return marked.join(staying, match, "left_semi").select(*row_columns(docs.columns))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
