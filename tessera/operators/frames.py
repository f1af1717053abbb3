"""Frames: slots, facets and fillers as one long table, with relations, inverse links and inheritance.

fillers(frame, slot, facet, pos, value) holds ordered values without repeats; relations(slot, inverse) pairs slots.
Inheritance walks from branching to branching: a round joins the frontier of all asked frames with the parent links at
once and drops what it has seen. Chains of single links are shortened and closures doubled, so neither is limited in depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ISA, SUBCLASSES, INSTANCE_OF, PART_OF, INSTANCES, HAS_PARTS = "IS-A", "SUBCLASSES", "INSTANCE-OF", "PART-OF", "INSTANCES", "HAS-PARTS"
VALUE, INHERITS = "VALUE", "INHERITS"
FILLERS = "frame string, slot string, facet string, pos long, value string"
#: Predefined pairs of slots.
RELATIONS = [(ISA, SUBCLASSES), (SUBCLASSES, ISA), (INSTANCE_OF, INSTANCES), (INSTANCES, INSTANCE_OF), (PART_OF, HAS_PARTS), (HAS_PARTS, PART_OF)]
MODES = ("none", "simple", "dfs", "bfs", "part_dfs", "part_bfs", "local_dfs", "local_bfs")


def relations(spark: SparkSession, more: list[tuple[str, str]] = ()) -> DataFrame:
    """The predefined relations and further pairs; pairing a slot anew ends its earlier pair."""
    pairs = dict(RELATIONS)
    for a, b in more:
        for x in (a, b):
            if x in pairs:
                pairs.pop(pairs.pop(x), None)
        pairs[a], pairs[b] = b, a
    return spark.createDataFrame(sorted(pairs.items()), "slot string, inverse string")


def undefine(rel: DataFrame, slot: str) -> DataFrame:
    return rel.where((F.col("slot") != slot) & (F.col("inverse") != slot))


#: The position of an inverse link before it is put in front of what a slot had.
_FRONT = -1


def _deduplicated(fillers: DataFrame) -> DataFrame:
    """The first of repeated values, positions counted anew from 0; inverse links come first, the last frame's in front."""
    kept = fillers.groupBy("frame", "slot", "facet", "value").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("frame", "slot", "facet").orderBy("pos", F.when(F.col("pos") == _FRONT, F.col("value")).desc(), "value")
    return kept.select("frame", "slot", "facet", (F.row_number().over(order) - 1).cast("long").alias("pos"), "value")


def with_inverses(fillers: DataFrame, rel: DataFrame) -> DataFrame:
    """Fillers with the other side of every relation: inverse links are put in front of the values a slot had, frame by frame in order of their names."""
    links = fillers.where(F.col("facet") == VALUE).join(rel, "slot")
    inverse = links.select(F.col("value").alias("frame"), F.col("inverse").alias("slot"), F.lit(VALUE).alias("facet"), F.lit(_FRONT).cast("long").alias("pos"), F.col("frame").alias("value"))
    new = inverse.join(fillers.select("frame", "slot", "facet", "value"), ["frame", "slot", "facet", "value"], "left_anti")
    return _deduplicated(fillers.unionByName(new.select(*fillers.columns)))


def add_fillers(fillers: DataFrame, more: DataFrame, rel: DataFrame | None = None, front: bool = False) -> DataFrame:
    """Values appended (or, with ``front``, pushed) unless there; more: (frame, slot, facet, value) or with pos."""
    if "pos" not in more.columns:
        more = more.withColumn("pos", F.lit(0).cast("long"))
    shift = F.lit(-(1 << 40)) if front else F.lit(1 << 40)
    both = fillers.unionByName(more.withColumn("pos", F.col("pos") + shift).select(*fillers.columns))
    if front:
        # A value that is there already keeps its place.
        both = fillers.unionByName(more.withColumn("pos", F.col("pos") + shift).join(fillers.select("frame", "slot", "facet", "value"), ["frame", "slot", "facet", "value"], "left_anti").select(*fillers.columns))
    return _deduplicated(both) if rel is None else with_inverses(_deduplicated(both), rel)


def erase(fillers: DataFrame, what: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """Without the rows of ``what`` (any of frame, slot, facet, value), and the inverse links of those that go; positions close up."""
    keys = [c for c in ("frame", "slot", "facet", "value") if c in what.columns]
    left = fillers.join(what.select(*keys).distinct(), keys, "left_anti")
    if rel is not None:
        gone = fillers.join(what.select(*keys).distinct(), keys, "left_semi").where(F.col("facet") == VALUE).join(rel, "slot")
        back = gone.select(F.col("value").alias("frame"), F.col("inverse").alias("slot"), "facet", F.col("frame").alias("value"))
        left = left.join(back, ["frame", "slot", "facet", "value"], "left_anti")
    return _deduplicated(left.select(*fillers.columns))


def pop_fillers(fillers: DataFrame, of: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """Without the first value of each of ``of`` (frame, slot, facet)."""
    keys = ["frame", "slot", "facet"]
    first = fillers.join(of.select(*keys).distinct(), keys).groupBy(*keys).agg(F.min_by("value", "pos").alias("value"))
    return erase(fillers, first, rel)


def erase_frame(fillers: DataFrame, frame: str, rel: DataFrame) -> DataFrame:
    """Without a frame's fillers and the links of other frames to it."""
    left = fillers.where(F.col("frame") != frame)
    links = left.where((F.col("value") == frame) & (F.col("facet") == VALUE)).join(rel.select("slot"), "slot", "left_semi")
    return _deduplicated(left.join(links.select("frame", "slot", "facet", "value"), ["frame", "slot", "facet", "value"], "left_anti").select(*fillers.columns))


def replace_filler(fillers: DataFrame, frame: str, slot: str, facet: str, old: str, new: str, rel: DataFrame | None = None) -> DataFrame:
    """One value in place of another, at its position, with the inverse links of both if ``rel`` is given."""
    hit = (F.col("frame") == frame) & (F.col("slot") == slot) & (F.col("facet") == facet) & (F.col("value") == old)
    out = _deduplicated(fillers.withColumn("value", F.when(hit, new).otherwise(F.col("value"))))
    if rel is None or facet != VALUE:
        return out
    back = rel.where(F.col("slot") == slot).select(F.lit(old).alias("frame"), F.col("inverse").alias("slot"), F.lit(VALUE).alias("facet"), F.lit(frame).alias("value"))
    return with_inverses(erase(out, back), rel)


def replace_facet(fillers: DataFrame, frame: str, slot: str, facet: str, values: list[str], rel: DataFrame | None = None) -> DataFrame:
    """All values of a facet replaced by others, with the inverse links of both if ``rel`` is given."""
    spark = fillers.sparkSession
    out = erase(fillers, spark.createDataFrame([(frame, slot, facet)], "frame string, slot string, facet string"), rel)
    new = spark.createDataFrame([(frame, slot, facet, k, v) for k, v in enumerate(values)], FILLERS)
    return add_fillers(out, new, rel)


def rename_frame(fillers: DataFrame, old: str, new: str, rel: DataFrame | None = None) -> DataFrame:
    """The frame under its new name, in links of relations to it too (the predefined ones, if ``rel`` is not given); other values stay."""
    link = F.col("slot").isin([a for a, _ in RELATIONS]) & (F.col("facet") == VALUE)
    if rel is not None:
        marked = fillers.join(rel.select("slot", F.lit(True).alias("_link")), "slot", "left").select(*fillers.columns, "_link")
        fillers, link = marked, F.coalesce("_link", F.lit(False)) & (F.col("facet") == VALUE)
    out = fillers.withColumns({"frame": F.when(F.col("frame") == old, new).otherwise(F.col("frame")), "value": F.when(link & (F.col("value") == old), new).otherwise(F.col("value"))})
    return out.drop("_link")


def copy_frame(fillers: DataFrame, old: str, new: str, rel: DataFrame | None = None) -> DataFrame:
    """The frame's fillers under a second name too, with the copy's inverse links if ``rel`` is given."""
    both = fillers.unionByName(fillers.where(F.col("frame") == old).withColumn("frame", F.lit(new)))
    return both if rel is None else with_inverses(both, rel)


def frames_with_prefix(fillers: DataFrame, prefix: str) -> DataFrame:
    """(frame) whose names begin with ``prefix``, upper and lower case alike."""
    return fillers.where(F.lower("frame").startswith(prefix.lower())).select("frame").distinct()


def parents(fillers: DataFrame, slot: str) -> DataFrame:
    """(child, parent, pos) along a slot's values."""
    return fillers.where((F.col("slot") == slot) & (F.col("facet") == VALUE)).select(F.col("frame").alias("child"), F.col("value").alias("parent"), "pos")


def all_slots(fillers: DataFrame) -> DataFrame:
    return fillers.select("frame", "slot", "facet").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth): everything reachable along (child, parent), at its least depth; cycles end by themselves.

    A round doubles the depth that is covered: what is reached from the farthest ancestors so far is added. Each is materialised, so plans stay short.
    """
    reached = edges.select("child", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)).checkpoint()
    covered = 1
    while True:
        farthest = reached.where((F.col("depth") == covered) & F.col("ancestor").isNotNull()).select(F.col("child").alias("from"), F.col("ancestor").alias("via"))
        new = farthest.join(reached, farthest["via"] == reached["child"]).select(F.col("from").alias("child"), "ancestor", (F.col("depth") + covered).alias("depth"))
        both = reached.unionByName(new).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")).checkpoint()
        covered *= 2
        if both.where(F.col("depth") == covered).isEmpty():
            return both
        reached = both


def is_a(fillers: DataFrame, pairs: DataFrame, slots=(ISA,), first=(INSTANCE_OF,)) -> DataFrame:
    """pairs(frame, ancestor) with a column that says whether the ancestor is reached: INSTANCE-OF at the first step or IS-A throughout."""
    up = fillers.where(F.col("slot").isin(*slots, *first) & (F.col("facet") == VALUE)).select(F.col("frame").alias("child"), F.col("value").alias("parent"))
    found = closure(up).select(F.col("child").alias("frame"), "ancestor", F.lit(True).alias("_yes"))
    return pairs.join(found, ["frame", "ancestor"], "left").select("frame", "ancestor", F.coalesce("_yes", F.lit(False)).alias("is_a"))


def part_of(fillers: DataFrame, pairs: DataFrame) -> DataFrame:
    return is_a(fillers, pairs, (PART_OF,), ()).withColumnRenamed("is_a", "part_of")


def _edges(fillers: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Links of the first step and of later ones: (child, parent, pos)."""
    if mode.startswith("part"):
        up = parents(fillers, PART_OF)
        return up, up
    isa, inst = parents(fillers, ISA), parents(fillers, INSTANCE_OF)
    # INSTANCE-OF parents if a frame has any, else IS-A; after that IS-A.
    first = inst.unionByName(isa.join(inst.select("child").distinct(), "child", "left_anti"))
    if mode == "simple":
        least = lambda up: up.groupBy("child").agg(F.min_by("parent", "pos").alias("parent"), F.min("pos").alias("pos"))
        return least(first), least(isa)
    return first, isa


def inherit(fillers: DataFrame, slot: str, facet: str = VALUE, mode: str = "dfs", frames: DataFrame | None = None) -> DataFrame:
    """(frame, source, pos, value): fillers of the slot, its own or those of the first ancestor that has any.

    bfs takes the nearest ancestor, ties in order of the links; dfs the first in pre-order; local modes look along the slot's
    INHERITS facet before that; an unknown mode is dfs. A frame is visited once for each asked frame, so cycles end. frames: those asked (all, if not given).
    """
    mode = mode.lower().replace("-", "_")
    mode = mode if mode in MODES else "dfs"
    have = fillers.where((F.col("slot") == slot) & (F.col("facet") == facet)).select(F.col("frame").alias("source"), "pos", "value")
    asked = (frames if frames is not None else fillers).select("frame").distinct()
    holders = have.select("source").distinct()
    start = asked.select("frame", F.col("frame").alias("node"), F.struct(F.lit(0).cast("long").alias("depth"), F.array().cast("array<long>").alias("path")).alias("rank"))
    found = start.join(holders, start["node"] == holders["source"]).select("frame", "source", "rank", F.lit(0).alias("stage"))
    if mode != "none":
        start = start.join(holders, start["node"] == holders["source"], "left_anti")
        if mode.startswith("local"):
            local = fillers.where((F.col("slot") == slot) & (F.col("facet") == INHERITS)).select(F.col("frame").alias("child"), F.col("value").alias("parent"), "pos")
            found = found.unionByName(_walk(start, local, local, holders, depth_first=mode.endswith("dfs")).withColumn("stage", F.lit(1)))
        first, later = _edges(fillers, mode)
        # Frames whose first links aren't their later ones; in the part modes all links are alike.
        kept = None if mode.startswith("part") else parents(fillers, INSTANCE_OF).select(F.col("child").alias("frame")).join(asked, "frame").distinct()
        found = found.unionByName(_walk(start, first, later, holders, depth_first=mode.endswith("dfs"), kept=kept).withColumn("stage", F.lit(2)))
    best = found.groupBy("frame").agg(F.min_by("source", F.struct("stage", "rank")).alias("source"))
    return best.join(have, "source").select("frame", "source", "pos", "value")


def inherit_by(fillers: DataFrame, slot: str, choose, facet: str = VALUE, frames: DataFrame | None = None) -> DataFrame:
    """(frame, source, pos, value) as a user's function decides: choose(frame, candidates) gives the number of a candidate, or None for none.

    candidates: dicts of source, depth (0 for the frame itself) and values, all that the frame has or could inherit along INSTANCE-OF and IS-A, nearest first, ties by name.
    They are gathered for each asked frame from the closure, so a frame's ancestors that fill the slot must fit a task; a frame without candidates isn't asked about.
    """
    import pyarrow as pa

    asked = (frames if frames is not None else fillers).select("frame").distinct()
    up = fillers.where(F.col("slot").isin(ISA, INSTANCE_OF) & (F.col("facet") == VALUE)).select(F.col("frame").alias("child"), F.col("value").alias("parent"))
    reach = closure(up).select(F.col("child").alias("frame"), F.col("ancestor").alias("source"), "depth").where("frame <> source")
    reach = reach.unionByName(asked.select("frame", F.col("frame").alias("source"), F.lit(0).alias("depth"))).join(asked, "frame", "left_semi")
    have = fillers.where((F.col("slot") == slot) & (F.col("facet") == facet)).groupBy(F.col("frame").alias("source")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"))
    gathered = reach.join(have, "source").groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("depth", "source", "values"))).alias("c"))

    def run(batches):
        for b in batches:
            rows = []
            for frame, candidates in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = choose(frame, candidates)
                if k is not None:
                    rows += [(frame, candidates[k]["source"], pos, value) for pos, value in enumerate(candidates[k]["values"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["frame", "source", "pos", "value"])

    return gathered.mapInArrow(run, "frame string, source string, pos long, value string")


def _jumps(later: DataFrame, holders: DataFrame, kept: DataFrame | None) -> DataFrame:
    """(node, to, steps, endless): where the only link of a node leads past all other nodes with one link that aren't holders or ``kept``.

    A round doubles the steps, so a chain takes the logarithm of its length; what leads into a ring of such nodes is endless.
    """
    single = later.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("to")).where((F.col("n") == 1) & F.col("to").isNotNull())
    for no in (holders.toDF("node"), *([] if kept is None else [kept.toDF("node")])):
        single = single.join(no, single["child"] == no["node"], "left_anti")
    jumps = single.select(F.col("child").alias("node"), "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("endless")).checkpoint()
    nodes, covered = jumps.count(), 1
    while True:
        on = jumps.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("steps").alias("more"))
        # Not endless: the node led to is none to be passed.
        jumps = jumps.join(on, F.col("to") == F.col("at"), "left").select("node", F.coalesce("on", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("endless")).checkpoint()
        covered *= 2
        # A way of more steps than there are nodes is a ring.
        if covered > 2 * nodes or jumps.where("endless").isEmpty():
            return jumps


def _walk(start: DataFrame, first: DataFrame, later: DataFrame, holders: DataFrame, depth_first: bool, kept: DataFrame | None = None) -> DataFrame:
    """(frame, source, rank) for holders met on the way up; rank has the links walked (0 if depth first) and the positions of the links chosen.

    Nodes with a single link are passed at once (``_jumps``): paths from one frame only part where there are several, so their order stays.
    A node is walked on again only with a rank that comes before the one known, until there is none.
    """
    jumps = _jumps(later, holders, kept)

    def jumped(edges: DataFrame) -> DataFrame:
        far = edges.join(jumps, edges["parent"] == jumps["node"], "left").where(~F.coalesce("endless", F.lit(False)))
        return far.select("child", F.coalesce("to", "parent").alias("parent"), "pos", F.lit(0).cast("long").alias("links") if depth_first else (1 + F.coalesce("steps", F.lit(0))).alias("links")).checkpoint()

    edges, later = jumped(first), jumped(later)
    step, seen, rounds = start, start, 0
    hits = start.select("frame", F.col("node").alias("source"), "rank").where(F.lit(False))
    while True:
        rank = F.struct((F.col("rank.depth") + F.col("links")).alias("depth"), F.concat("rank.path", F.array("pos")).alias("path"))
        grown = step.join(edges, step["node"] == edges["child"]).select("frame", F.col("parent").alias("node"), rank.alias("rank"))
        grown = grown.groupBy("frame", "node").agg(F.min("rank").alias("rank"))
        known = seen.groupBy("frame", "node").agg(F.min("rank").alias("_known"))
        grown = grown.join(known, ["frame", "node"], "left").where(F.col("_known").isNull() | (F.col("rank") < F.col("_known"))).drop("_known").checkpoint()
        if grown.isEmpty():
            return hits
        hits = hits.unionByName(grown.join(holders, grown["node"] == holders["source"]).select("frame", "source", "rank"))
        # Nothing behind a holder is asked for.
        step = grown.join(holders, grown["node"] == holders["source"], "left_anti")
        seen = seen.unionByName(grown)
        edges, rounds = later, rounds + 1
        if rounds % 8 == 0:
            seen = seen.groupBy("frame", "node").agg(F.min("rank").alias("rank")).checkpoint()
            hits = hits.groupBy("frame", "source").agg(F.min("rank").alias("rank")).checkpoint()


def collect_slots(fillers: DataFrame) -> DataFrame:
    """(frame, slot, facet, source): every slot a frame has or inherits along INSTANCE-OF and IS-A, with the nearest frame that fills it."""
    up = fillers.where(F.col("slot").isin(ISA, INSTANCE_OF) & (F.col("facet") == VALUE)).select(F.col("frame").alias("child"), F.col("value").alias("parent"))
    reach = closure(up).select(F.col("child").alias("frame"), F.col("ancestor").alias("source"), "depth")
    own = fillers.select("frame").distinct().select("frame", F.col("frame").alias("source"), F.lit(0).alias("depth"))
    slots = fillers.select(F.col("frame").alias("source"), "slot", "facet").distinct()
    seen = own.unionByName(reach).join(slots, "source")
    return seen.groupBy("frame", "slot", "facet").agg(F.min_by("source", F.struct("depth", "source")).alias("source"))


def inherit_all(fillers: DataFrame) -> DataFrame:
    """Fillers with inherited ones copied down."""
    return collect_slots(fillers).join(fillers.withColumnRenamed("frame", "source"), ["source", "slot", "facet"]).select("frame", "slot", "facet", "pos", "value")


# Versioned store: a row for each state of a frame; deletions are rows too.

def store(versions: DataFrame | None, fillers: DataFrame, version: int, deleted: list[str] = ()) -> DataFrame:
    """versions(frame, version, deleted, body) with a new version of every frame in ``fillers`` and tombstones."""
    body = fillers.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("slot", "facet", "pos", "value"))).alias("body"))
    new = body.select("frame", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"), "body")
    if deleted:
        spark = fillers.sparkSession
        gone = spark.createDataFrame([(f,) for f in deleted], "frame string").select("frame", F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast(body.schema["body"].dataType).alias("body"))
        new = new.unionByName(gone)
    return new if versions is None else versions.unionByName(new)


def as_of(versions: DataFrame, version: int | None = None) -> DataFrame:
    """Fillers of the frames as they stood at a version; later ones, and what a transaction that was given up left, don't count."""
    rows = versions if version is None else versions.where(F.col("version") <= version)
    last = rows.groupBy("frame").agg(F.max_by(F.struct("deleted", "body"), "version").alias("s"))
    return last.where("NOT s.deleted").select("frame", F.inline("s.body"))


def abort(versions: DataFrame, version: int) -> DataFrame:
    return versions.where(F.col("version") != version)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the tables: regions are IS-A WORLD, nations IS-A their region, customers INSTANCE-OF their nation, suppliers PART-OF theirs."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region = read("region").select(F.concat(F.lit("R"), "r_regionkey").alias("frame"), F.lit(ISA).alias("slot"), F.lit("WORLD").alias("value"))
    nation = read("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("frame"), F.lit(ISA).alias("slot"), F.concat(F.lit("R"), "n_regionkey").alias("value"))
    customer = read("customer").select(F.concat(F.lit("C"), "c_custkey").alias("frame"), F.lit(INSTANCE_OF).alias("slot"), F.concat(F.lit("N"), "c_nationkey").alias("value"))
    supplier = read("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("frame"), F.lit(PART_OF).alias("slot"), F.concat(F.lit("N"), "s_nationkey").alias("value"))
    whole = read("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("frame"), F.lit(PART_OF).alias("slot"), F.concat(F.lit("R"), "n_regionkey").alias("value"))
    name = read("region").select(F.concat(F.lit("R"), "r_regionkey").alias("frame"), F.lit("NAME").alias("slot"), F.col("r_name").alias("value"))
    odd = read("nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("N"), "n_nationkey").alias("frame"), F.lit("NAME").alias("slot"), F.col("n_name").alias("value"))
    rows = region.union(nation).union(customer).union(supplier).union(whole).union(name).union(odd)
    return rows.select("frame", "slot", F.lit(VALUE).alias("facet"), F.lit(0).cast("long").alias("pos"), "value")


def _inherit_query(mode, prefix):
    def run(spark, sf_dir):
        from ..plans.session import ensure_checkpoints

        ensure_checkpoints(spark)
        f = nations(spark, sf_dir)
        asked = f.where(F.col("frame").startswith(prefix)).select("frame").distinct()
        return inherit(f, "NAME", mode=mode, frames=asked).select("frame", "source", "value")

    return run


def _with_checkpoints(make):
    def run(spark, sf_dir):
        from ..plans.session import ensure_checkpoints

        ensure_checkpoints(spark)
        return make(spark, nations(spark, sf_dir))

    return run


def _pairs(f, prefix):
    """Each frame of a kind with the first region, all others asked about too."""
    return f.where(F.col("frame").startswith(prefix)).select("frame").distinct().withColumn("ancestor", F.lit("R1"))


def _chain(spark, sf_dir):
    """Every fiftieth customer of a chain of all customers inherits from its top."""
    key = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    named = lambda k: F.concat(F.lit("K"), k.cast("string"))
    links = key.where("k > 0").select(named(F.col("k")).alias("frame"), F.lit(ISA).alias("slot"), F.lit(VALUE).alias("facet"), F.lit(0).cast("long").alias("pos"), named(F.col("k") - 1).alias("value"))
    return links.unionByName(key.where("k = 0").select(F.lit("K0").alias("frame"), F.lit("TEST").alias("slot"), F.lit(VALUE).alias("facet"), F.lit(0).cast("long").alias("pos"), F.lit("top").alias("value"))), key.where("k % 50 = 49").select(named(F.col("k")).alias("frame"))


def q_chain(spark, sf_dir):
    from ..plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    fillers, asked = _chain(spark, sf_dir)
    return inherit(fillers, "TEST", mode="bfs", frames=asked).select("frame", "source", "value")


#: (frame, slot, facet, pos, value) for each nation k, where links branch, meet again and run in a circle, and odd nations have an INHERITS facet.
_LATTICE = (("N", ISA, VALUE, 0, "A"), ("N", ISA, VALUE, 1, "B"), ("A", ISA, VALUE, 0, "C"), ("C", ISA, VALUE, 0, "N"), ("B", ISA, VALUE, 0, "C"), ("C", "NAME", VALUE, 0, "c"), ("B", "NAME", VALUE, 0, "b"), ("N", PART_OF, VALUE, 0, "P"), ("N", PART_OF, VALUE, 1, "Q"), ("P", PART_OF, VALUE, 0, "R"), ("R", "NAME", VALUE, 0, "r"), ("Q", "NAME", VALUE, 0, "q"), ("D", "NAME", VALUE, 0, "d"), ("N", "NAME", INHERITS, 0, "D"))


def q_modes(spark, sf_dir):
    """What each nation inherits in every mode over a lattice in which the modes differ."""
    from ..plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    shape = F.array(*[F.struct(F.lit(f).alias("frame"), F.lit(s).alias("slot"), F.lit(c).alias("facet"), F.lit(p).cast("long").alias("pos"), F.lit(v).alias("value")) for f, s, c, p, v in _LATTICE])
    rows = nation.select("k", F.inline(shape)).where((F.col("facet") == VALUE) | (F.col("k") % 2 == 1))
    at = lambda c: F.concat(F.col(c), F.col("k").cast("string"))
    fillers = rows.select(at("frame").alias("frame"), "slot", "facet", "pos", F.when(F.col("slot").isin(ISA, PART_OF) | (F.col("facet") == INHERITS), at("value")).otherwise(F.col("value")).alias("value"))
    asked, out = nation.select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("frame")), None
    for mode in MODES:
        part = inherit(fillers, "NAME", mode=mode, frames=asked).select(F.lit(mode).alias("mode"), "frame", "value")
        out = part if out is None else out.unionByName(part)
    return out


def q_edits(spark, sf_dir):
    """Nations' first links erased, suppliers' popped, a region renamed and one erased: what is left, and where it stands."""
    f, rel = nations(spark, sf_dir), relations(spark)
    f = with_inverses(f, rel)
    f = pop_fillers(f, f.where(F.col("frame").startswith("R") & (F.col("slot") == SUBCLASSES)).select("frame", "slot", "facet"), rel)
    f = erase_frame(rename_frame(f, "R1", "AMERICAS", rel), "R0", rel)
    return f.where(F.col("slot").isin(SUBCLASSES, ISA) & ~F.col("frame").startswith("C")).select("frame", "slot", "pos", "value")


QUERIES = {
    "inherit_chain": q_chain,
    "inherit_modes": q_modes,
    "frame_edits": q_edits,
    "isa_closure": _with_checkpoints(lambda s, f: closure(f.where(F.col("slot").isin(ISA, INSTANCE_OF)).select(F.col("frame").alias("child"), F.col("value").alias("parent")))),
    "isa_p": _with_checkpoints(lambda s, f: is_a(f, _pairs(f, "C"))),
    "partof_p": _with_checkpoints(lambda s, f: part_of(f, _pairs(f, "S"))),
    "inverse_relation": _with_checkpoints(lambda s, f: with_inverses(f, relations(s)).groupBy("frame", "slot").agg(F.count(F.lit(1)).alias("n"))),
    "collect_slots": _with_checkpoints(lambda s, f: collect_slots(f)),
    "all_slots": _with_checkpoints(lambda s, f: all_slots(f)),
    "frame_versions": _with_checkpoints(lambda s, f: as_of(store(store(None, f, 1), f.where(F.col("slot") != "NAME"), 2, ["WORLD", "R0"])).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))),
} | {f"inherit_{m}": _inherit_query(m, p) for m, p in (("none", "N"), ("simple", "C"), ("bfs", "C"), ("dfs", "C"), ("part_bfs", "S"), ("part_dfs", "S"), ("local_bfs", "C"), ("local_dfs", "C"))}
_F = f"""WITH RECURSIVE f AS (SELECT 'R' || r_regionkey AS frame, '{ISA}' AS slot, 'WORLD' AS value FROM region UNION ALL SELECT 'N' || n_nationkey, '{ISA}', 'R' || n_regionkey FROM nation
UNION ALL SELECT 'C' || c_custkey, '{INSTANCE_OF}', 'N' || c_nationkey FROM customer UNION ALL SELECT 'S' || s_suppkey, '{PART_OF}', 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, '{PART_OF}', 'R' || n_regionkey FROM nation
UNION ALL SELECT 'R' || r_regionkey, 'NAME', r_name FROM region UNION ALL SELECT 'N' || n_nationkey, 'NAME', n_name FROM nation WHERE n_nationkey % 2 = 1)"""
_UP = _F + ", c AS (SELECT frame, value AS ancestor, 1 AS depth FROM f WHERE slot IN ({s}) UNION ALL SELECT c.frame, f.value, depth + 1 FROM c JOIN f ON f.frame = c.ancestor AND f.slot IN ({s}))"
_ISA, _PART = _UP.replace("{s}", f"'{ISA}', '{INSTANCE_OF}'"), _UP.replace("{s}", f"'{PART_OF}'")


def _inherit_sql(base, prefix):
    return f"{base}, n AS (SELECT frame, value FROM f WHERE slot = 'NAME'), a AS (SELECT DISTINCT frame, frame AS source, 0 AS depth FROM f WHERE frame LIKE '{prefix}%' UNION ALL SELECT frame, ancestor, depth FROM c WHERE frame LIKE '{prefix}%') SELECT a.frame, a.source, n.value FROM a JOIN n ON n.frame = a.source QUALIFY row_number() OVER (PARTITION BY a.frame ORDER BY depth) = 1"


SQL = {
    "inherit_chain": "SELECT 'K' || c_custkey AS frame, 'K0' AS source, 'top' AS value FROM customer WHERE c_custkey % 50 = 49",
    "inherit_modes": "SELECT mode, 'N' || n_nationkey AS frame, CASE WHEN mode LIKE 'local%' AND n_nationkey % 2 = 1 THEN 'd' WHEN mode IN ('bfs', 'local_bfs') THEN 'b' WHEN mode = 'part_bfs' THEN 'q' WHEN mode = 'part_dfs' THEN 'r' ELSE 'c' END AS value FROM nation, (VALUES ('simple'), ('dfs'), ('bfs'), ('part_dfs'), ('part_bfs'), ('local_dfs'), ('local_bfs')) m(mode)",
    "frame_edits": f"{_F}, l AS (SELECT frame, value FROM f WHERE slot = '{ISA}'), o AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY frame DESC) AS k FROM l), k AS (SELECT replace(frame, 'R1', 'AMERICAS') AS a, CASE WHEN value = 'R1' THEN 'AMERICAS' ELSE value END AS b, k FROM o WHERE 'R0' NOT IN (frame, value) AND NOT (value LIKE 'R%' AND k = 1)) SELECT a AS frame, '{ISA}' AS slot, 0::BIGINT AS pos, b AS value FROM k UNION ALL SELECT b, '{SUBCLASSES}', row_number() OVER (PARTITION BY b ORDER BY k) - 1, a FROM k",
    "isa_closure": f"{_ISA} SELECT frame AS child, ancestor, min(depth)::INT AS depth FROM c GROUP BY ALL",
    "isa_p": f"{_ISA} SELECT DISTINCT frame, 'R1' AS ancestor, frame IN (SELECT frame FROM c WHERE ancestor = 'R1') AS is_a FROM f WHERE frame LIKE 'C%'",
    "partof_p": f"{_PART} SELECT DISTINCT frame, 'R1' AS ancestor, frame IN (SELECT frame FROM c WHERE ancestor = 'R1') AS part_of FROM f WHERE frame LIKE 'S%'",
    "inverse_relation": f"{_F} SELECT frame, slot, count(*) AS n FROM (SELECT * FROM f UNION SELECT value, CASE slot WHEN '{ISA}' THEN '{SUBCLASSES}' WHEN '{INSTANCE_OF}' THEN '{INSTANCES}' ELSE '{HAS_PARTS}' END, frame FROM f WHERE slot IN ('{ISA}', '{INSTANCE_OF}', '{PART_OF}')) GROUP BY ALL",
    "collect_slots": f"{_ISA}, a AS (SELECT DISTINCT frame, frame AS source, 0 AS depth FROM f UNION ALL SELECT frame, ancestor, depth FROM c), s AS (SELECT DISTINCT frame, slot FROM f) SELECT a.frame, s.slot, 'VALUE' AS facet, arg_min(a.source, depth) AS source FROM a JOIN s ON s.frame = a.source GROUP BY a.frame, s.slot",
    "all_slots": f"{_F} SELECT DISTINCT frame, slot, 'VALUE' AS facet FROM f",
    "frame_versions": f"{_F} SELECT slot, count(*) AS n FROM f WHERE slot <> 'NAME' AND frame NOT IN ('WORLD', 'R0') GROUP BY slot",
    "inherit_none": f"{_F} SELECT frame, frame AS source, value FROM f WHERE slot = 'NAME' AND frame LIKE 'N%'",
} | {f"inherit_{m}": _inherit_sql(b, p) for m, b, p in (("simple", _ISA, "C"), ("bfs", _ISA, "C"), ("dfs", _ISA, "C"), ("part_bfs", _PART, "S"), ("part_dfs", _PART, "S"), ("local_bfs", _ISA, "C"), ("local_dfs", _ISA, "C"))}
