"""Reachability without recomputing it: a stored closure kept up as edges change, and labels that decide without a closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..storage import discard, store
from .graph import ancestors
from .skew import fit, join_hot

PAIRS = "node string, anc string"
EDGES = "head string, tail string"
PARTS = 64
#: Random orders of the labels; each decides part of the pairs that are not below.
ORDERS = 4


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("string")


def _edges(df: DataFrame) -> DataFrame:
    return df.select("head", "tail").filter("head is not null and tail is not null").distinct()


def create_closure(edges: DataFrame, root: str, parts: int = PARTS) -> versions.Snapshot:
    """Store edges and their closure below ``root``, dealt into parts: pairs by node (``up``), by ancestor (``down``), edges by head."""
    e, pairs = store(_edges(edges), "edges"), ancestors(edges)
    write = lambda df, key: versions.write_parts(df, root, _part(key, parts))
    return versions.update(edges.sparkSession, root, lambda base: {"edges": write(e, "head"), "up": write(pairs, "node"), "down": write(pairs, "anc")}, replace=True)


def read_closure(spark: SparkSession, root: str) -> DataFrame:
    """``node, anc`` of the newest version."""
    return versions.read(spark, root, "up", PAIRS)


def change_closure(spark: SparkSession, root: str, inserted: DataFrame, deleted: DataFrame, parts: int = PARTS) -> versions.Snapshot:
    """Insert and delete edges (``head, tail``) and bring the stored closure up to date as one version.

    Deletion first: every pair with a way through a deleted edge is suspected;
    those that remaining edges still connect are derived again, from pairs beyond
    suspicion outwards. Insertion extends pairs by one inserted edge at a time,
    from the pairs that the last round added. Work and the parts that are read
    and written follow the pairs concerned, not the closure. Edges that exist
    already, deleted ones that do not, and null ends change nothing; an edge in
    both is deleted and inserted. Cycles are followed to their end.
    """

    def read(table: str, key: str, keys: DataFrame, base: versions.Snapshot) -> DataFrame:
        """Rows of ``table`` whose ``key`` is among ``keys`` (column ``k``), from the parts that can hold them."""
        some = [r[0] for r in keys.select(_part("k", parts).alias("p")).distinct().collect()]  # ``parts`` at most
        rows = versions.read(spark, root, table, EDGES if table == "edges" else PAIRS, base, some)
        return rows.join(fit(keys).withColumnRenamed("k", key), key, "left_semi")

    def keys(df: DataFrame, column: str) -> DataFrame:
        return store(df.select(F.col(column).alias("k")).distinct(), "keys")

    def around(edges: DataFrame, base: versions.Snapshot, without: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(``node, head`` at or below the heads, ``head, anc`` at or above the tails) of edges, over pairs that are not ``without``."""
        below = read("down", "anc", keys(edges, "head"), base).join(without, ["node", "anc"], "left_anti").select("node", F.col("anc").alias("head"))
        above = read("up", "node", keys(edges, "tail"), base).join(without, ["node", "anc"], "left_anti").withColumnRenamed("node", "tail")
        below = below.unionByName(edges.select(F.col("head").alias("node"), "head"))
        jumps = edges.join(above, "tail").select("head", "anc").unionByName(edges.select("head", F.col("tail").alias("anc")))
        return store(below.distinct(), "below"), store(jumps.distinct(), "jumps")

    def make(base: versions.Snapshot) -> dict[str, dict[str, str]]:
        gone, fresh = _edges(deleted), _edges(inserted)
        known = lambda df: read("edges", "head", keys(df, "head"), base)
        gone = store(gone.join(known(gone), ["head", "tail"], "left_semi"), "deleted")
        fresh = store(fresh.join(known(fresh), ["head", "tail"], "left_anti").unionByName(fresh.join(gone, ["head", "tail"], "left_semi")).distinct(), "inserted")

        below, jumps = around(gone, base, spark.createDataFrame([], PAIRS))
        suspects = store(below.join(jumps, "head").select("node", "anc").distinct(), "suspects")
        step = store(read("edges", "head", keys(suspects, "node"), base).join(gone, ["head", "tail"], "left_anti"), "steps")
        tails = keys(step, "tail")
        sure = read("up", "node", tails, base).join(suspects, ["node", "anc"], "left_anti")
        ways = store(suspects.join(step, F.col("node") == F.col("head")).select("node", "tail", "anc"), "ways")
        held = ways.join(sure.withColumnRenamed("node", "tail"), ["tail", "anc"], "left_semi").unionByName(ways.filter("tail = anc"))
        rescued = new = store(held.select("node", "anc").distinct(), "rescued")
        while not new.isEmpty():
            new = ways.join(new.withColumnRenamed("node", "tail"), ["tail", "anc"], "left_semi").select("node", "anc").distinct()
            new = store(new.join(rescued, ["node", "anc"], "left_anti"), "rescued")
            rescued = rescued.unionByName(new)
        removed = store(suspects.join(rescued, ["node", "anc"], "left_anti"), "removed")

        below, jumps = around(fresh, base, removed)
        added, new = None, store(below.join(jumps, "head").select("node", "anc").distinct(), "reached")
        while not new.isEmpty():
            added = new if added is None else added.unionByName(new)
            new = new.withColumnRenamed("anc", "head").join(jumps, "head").select("node", "anc").distinct()
            new = store(new.join(added, ["node", "anc"], "left_anti"), "reached")
        added = added if added is not None else spark.createDataFrame([], PAIRS)
        out = {}
        for table, key, less, more in (("up", "node", removed, added), ("down", "anc", removed, added), ("edges", "head", gone, fresh)):
            touched = store(less.select(_part(key, parts).alias("p")).union(more.select(_part(key, parts))).distinct(), "touched")
            some = [r[0] for r in touched.collect()]
            if some:
                old = versions.read(spark, root, table, EDGES if table == "edges" else PAIRS, base, some)
                now = old.join(less, old.columns, "left_anti").unionByName(more.select(*old.columns)).distinct()
                out[table] = dict.fromkeys(some, _empty(spark, root, old.schema)) | versions.write_parts(now, root, _part(key, parts))
        return out

    return versions.update(spark, root, make)


def _empty(spark: SparkSession, root: str, schema) -> str:
    """A part without rows, for parts that lose their last one."""
    return versions.write_parts(spark.createDataFrame([], schema), root)["all"]


def reach_labels(edges: DataFrame, orders: int = ORDERS) -> DataFrame:
    """``node, pre, last``, ``low_<k>`` and ``up_<k>``: labels that decide most questions of reachability without any pairs.

    ``pre`` numbers a spanning forest (each node under its least parent) so that
    a node's subtree is ``pre`` to ``last``; nodes that their least parents lead
    into a cycle have none. ``low_<k>`` is the least of the random numbers of
    order ``k`` at or below the node: where a node is below another, none of its
    lows is less than the other's. ``up_<k>`` has one of 64 bits set for each node
    at or above the node: where a node is below another, it has all of the other's
    bits. Paths double in length every round, lows and bits take as many rounds
    as the graph is deep, of nodes that have others below them; hubs are combined
    before shuffles.
    """
    step = store(_edges(edges).filter("head <> tail"), "edges")
    nodes = store(step.select(F.col("head").alias("node")).union(step.select("tail")).union(_edges(edges).select("head")).distinct(), "nodes")
    count = nodes.count()
    parent = step.groupBy(F.col("head").alias("node")).agg(F.min("tail").alias("parent"))
    # a path runs from the node upwards; its last element is where it goes on
    paths = store(nodes.join(parent, "node", "left").select("node", F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("node", "parent")).alias("path"), F.col("parent").isNull().alias("whole")), "paths")
    for _ in range(max(1, count).bit_length() + 1):
        rest = paths.filter("not whole").withColumn("end", F.element_at("path", -1))
        ends = rest.groupBy("end").agg(F.count(F.lit(1)).alias("n"))
        tops = store(ends.join(paths.select(F.col("node").alias("end"), F.col("path").alias("more"), F.col("whole").alias("done")), "end"), "path-ends")
        if tops.isEmpty():
            break
        longer = join_hot(rest, tops, "end", "n", count).select("node", F.concat("path", F.slice("more", F.lit(2), F.size("more"))).alias("path"), F.col("done").alias("whole"))
        before, paths = paths, store(paths.filter("whole").unionByName(longer.filter(F.size("path") <= count)), "paths")
        discard(before, tops)
    whole = paths.filter("whole")
    placed = _numbered(whole.select("node", F.array_join(F.transform(F.reverse("path"), lambda x: F.concat(x, F.lit("\u0000"))), "").alias("key"), "path"))
    sizes = placed.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    forest = placed.select("node", "pre").join(sizes, "node").select("node", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))

    lows, ups = [f"low_{k}" for k in range(orders)], [f"up_{k}" for k in range(orders)]
    low = lambda key, k: F.xxhash64(key, F.lit(k))
    bit = lambda key, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(orders + k)), F.lit(64)).cast("int"))
    # a node without others below it has its own numbers and tells its parents nothing new after the first round
    first = step.groupBy(F.col("tail").alias("node")).agg(*(F.min(low("head", k)).alias(n) for k, n in enumerate(lows)))
    tops = store(first.select("node", *(F.least(n, low("node", k)).alias(n) for k, n in enumerate(lows)), *(bit("node", k).alias(n) for k, n in enumerate(ups))), "tops")
    inner = store(step.join(fit(tops).select(F.col("node").alias("head")), "head", "left_semi"), "inner-edges")
    changed = tops
    while not changed.isEmpty():
        some = fit(changed)
        below = some.join(inner, F.col("node") == F.col("head")).select(F.col("tail").alias("node"), *lows, *(F.lit(None).cast("long").alias(n) for n in ups))
        above = some.join(inner, F.col("node") == F.col("tail")).select(F.col("head").alias("node"), *(F.lit(None).cast("long").alias(n) for n in lows), *ups)
        told = below.union(above).groupBy("node").agg(*(F.min(n).alias(f"new_{n}") for n in lows), *(F.bit_or(n).alias(f"new_{n}") for n in ups))
        new = lambda n: F.coalesce(F.least(n, f"new_{n}") if n in lows else F.col(n).bitwiseOR(F.col(f"new_{n}")), F.col(n))
        differs = F.lit(False)
        for n in (*lows, *ups):
            differs = differs | (new(n) != F.col(n))
        both = store(tops.join(told, "node", "left").select("node", *(new(n).alias(n) for n in (*lows, *ups)), differs.alias("differs")), "tops")
        tops, changed = both.drop("differs"), store(both.filter("differs").drop("differs"), "changed")
    told = step.join(fit(store(tops, "tops")).withColumnRenamed("node", "tail"), "tail").groupBy(F.col("head").alias("node")).agg(*(F.bit_or(n).alias(f"new_{n}") for n in ups))
    own = nodes.select("node", *(low("node", k).alias(f"own_{n}") for k, n in enumerate(lows)), *(bit("node", k).alias(f"own_{n}") for k, n in enumerate(ups)))
    own = own.join(told, "node", "left").join(fit(tops), "node", "left")
    marks = own.select("node", *(F.coalesce(n, f"own_{n}").alias(n) for n in lows), *(F.col(f"own_{n}").bitwiseOR(F.coalesce(f"new_{n}", F.lit(0))).alias(n) for n in ups))
    return store(marks.join(forest, "node", "left"), "labels")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pre``, their place by ``key``; ranges are counted, one figure per partition."""
    spark = rows.sparkSession
    placed = store(rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("__at", F.monotonically_increasing_id()), "preorder")
    part = F.shiftright("__at", 33)
    starts, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):
        starts.append((p, at))
        at += n
    table = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    return placed.withColumn("__part", part).join(table, "__part").withColumn("pre", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start", "key")


def is_below(pairs: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, anc, below``: for each distinct pair whether ``anc`` is a proper ancestor of ``node``, as ``closure`` would say.

    Intervals decide for, lows and bits against; what is left walks upwards from
    the node, only through nodes that the labels leave possible, until an interval
    or the ancestor itself is met. Unknown nodes are below nothing; nulls are
    dropped; a node is below itself in a cycle only.
    """
    lows, ups = ([c for c in labels.columns if c.startswith(p)] for p in ("low_", "up_"))
    side = lambda df, key, mark: df.select(F.col("node").alias(key), *(F.col(c).alias(f"{mark}{c}") for c in ("pre", "last", *lows, *ups)))
    step = store(_edges(edges), "edges")
    # only these have anything below them
    tops = fit(store(labels.join(step.select(F.col("tail").alias("node")).distinct(), "node", "left_semi"), "tops"))
    inner = store(step.join(tops.select(F.col("node").alias("head")), "head", "left_semi"), "inner-edges")
    inside = (F.col("a_pre") < F.col("n_pre")) & (F.col("n_pre") <= F.col("a_last"))
    out_of = F.lit(False)
    for c in lows:
        out_of = out_of | (F.col(f"n_{c}") < F.col(f"a_{c}"))
    for c in ups:
        out_of = out_of | (F.col(f"n_{c}").bitwiseAND(F.col(f"a_{c}")) != F.col(f"a_{c}"))
    known = pairs.select("node", "anc").filter("node is not null and anc is not null").distinct().join(side(labels, "node", "n_"), "node", "left")
    marked = known.join(side(tops, "anc", "a_"), "anc", "left")
    unknown = F.col(f"n_{lows[0]}").isNull() | F.col(f"a_{lows[0]}").isNull()
    asked = store(marked.select("node", "anc", F.when(unknown | out_of, F.lit(False)).when(inside, F.lit(True)).alias("below")), "asked")
    left = asked.filter("below is null").select("node", "anc")
    found, ways = left.sparkSession.createDataFrame([], PAIRS), step
    seen = frontier = store(left.withColumn("at", F.col("node")), "frontier")
    while not frontier.isEmpty():
        up = frontier.join(ways, F.col("at") == F.col("head")).select("node", "anc", F.col("tail").alias("at")).distinct()
        met = up.join(side(tops, "anc", "a_"), "anc").join(side(tops, "at", "n_"), "at")
        hit = (F.col("at") == F.col("anc")) | F.coalesce(inside, F.lit(False))
        here = store(met.withColumn("hit", hit).filter(F.col("hit") | ~out_of).select("node", "anc", "at", "hit"), "walk")
        hits = store(here.filter("hit").select("node", "anc").distinct(), "hits")
        found, ways = found.unionByName(hits), inner
        frontier = here.select("node", "anc", "at").join(hits, ["node", "anc"], "left_anti").join(seen, ["node", "anc", "at"], "left_anti")
        frontier = store(frontier, "frontier")
        seen = seen.unionByName(frontier)
    yes = store(found.distinct().withColumn("yes", F.lit(True)), "below")
    walked = left.join(yes, ["node", "anc"], "left").select("node", "anc", F.coalesce("yes", F.lit(False)).alias("below"))
    return asked.filter("below is not null").unionByName(walked)
