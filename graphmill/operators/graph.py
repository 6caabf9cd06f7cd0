"""Graph operators over edge tables: closures, components, labels, paths.

Edges run from child to parent: columns ``head`` and ``tail``. Loops are joins of
a small frontier with the edges, stored every round; all end on cyclic graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, store
from .skew import fingerprint, fit, join_hot


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``node, anc``: every proper ancestor of every node, or of ``seeds`` (column ``node``).

    In a cycle a node is its own ancestor. Each round joins only the pairs that
    the last one added.
    """
    step = store(edges.select(F.col("head").alias("__child"), F.col("tail").alias("__parent")).filter("__child is not null and __parent is not null").distinct(), "edges")
    first = step.select(F.col("__child").alias("node"), F.col("__parent").alias("anc"))
    if seeds is not None:
        first = first.join(seeds.select("node").distinct(), "node", "left_semi")
    rounds = [store(first, "closure")]
    seen = rounds[0]
    while True:
        grown = rounds[-1].join(step, F.col("anc") == F.col("__child")).select("node", F.col("__parent").alias("anc")).distinct()
        new = store(grown.join(seen, ["node", "anc"], "left_anti"), "closure")
        if new.isEmpty():
            return seen
        rounds.append(new)
        seen = seen.unionByName(new)
        if len(rounds) % 8 == 0:
            seen = store(seen, "closure")


def reach(edges: DataFrame, roots: DataFrame, include_roots: bool = True) -> DataFrame:
    """``node``: everything at or below ``roots`` (column ``node``)."""
    step = store(edges.select("head", "tail").filter("head is not null and tail is not null").distinct(), "edges")
    seen = frontier = store(roots.select("node").distinct(), "reach")
    below = None
    while True:
        new = step.join(frontier, F.col("tail") == F.col("node")).select(F.col("head").alias("node")).distinct()
        new = store(new.join(seen, "node", "left_anti"), "reach")
        if new.isEmpty():
            return seen if include_roots else (below if below is not None else seen.limit(0))
        seen, frontier = seen.unionByName(new), new
        below = new if below is None else below.unionByName(new)


def ancestors_of_set(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``: all that ``seeds`` reach upwards, seeds left out unless reached."""
    return reach(edges.select(F.col("tail").alias("head"), F.col("head").alias("tail")), seeds, include_roots=False)


def labels_by_anchor(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``node, labels``: for each node the sorted labels of the anchors (``node, label``) at or above it.

    One breadth-first walk carries all labels.
    """
    step = store(edges.select("head", "tail").distinct(), "edges")
    seen = frontier = store(anchors.select("node", "label").distinct(), "labels")
    while True:
        # a root's children are many: they stay where they are while the frontier is small enough to be sent to them
        new = step.join(fit(frontier), F.col("tail") == F.col("node")).select(F.col("head").alias("node"), "label").distinct()
        new = store(new.join(seen, ["node", "label"], "left_anti"), "labels")
        if new.isEmpty():
            return seen.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))
        seen, frontier = seen.unionByName(new), new


def nearest_groups(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``node, group, depth``: labels flow down, but not past a node that has one of its own.

    A node between several groups keeps all of the nearest depth.
    """
    step = store(edges.select("head", "tail").distinct(), "edges")
    seen = frontier = store(anchors.select("node", F.col("label").alias("group"), F.lit(0).alias("depth")).distinct(), "groups")
    while True:
        new = step.join(fit(frontier), F.col("tail") == F.col("node")).select(F.col("head").alias("node"), "group", (F.col("depth") + 1).alias("depth")).distinct()
        new = store(new.join(seen.select("node").distinct(), "node", "left_anti"), "groups")
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new


def single_group(groups: DataFrame, precedence: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """``node, group``: one group per node, the first in ``precedence`` (others after it, by name), renamed by ``names``."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col("group"))
    rank = F.struct(F.when(order > 0, order).otherwise(len(precedence) + 1), "group")
    best = groups.groupBy("node").agg(F.min_by("group", rank).alias("group"))
    if not names:
        return best
    return best.withColumn("group", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("group")), F.col("group")))


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node of each connected component of ``a, b`` links.

    Alternating stars: a large star moves a node's greater neighbours to its
    least one, a small star joins its lesser neighbours to the least of them,
    until every node hangs on its component's least. Minima are combined before
    they are shuffled, and the edges of hubs meet theirs where they are
    (``skew.join_hot``), so no task holds a hub's neighbours. Rounds are stored.
    A link of a node to itself makes a component of one; nulls link nothing.
    """
    found = links.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = store(found, "links")
    alone = links.filter("u = v").select(F.col("u").alias("node"))
    edges = links.filter("u <> v")
    mark = fingerprint(edges, "u", "v")
    while mark[0]:
        # large star: what is greater than v moves to the least around v
        around = edges.select("v", F.col("u").alias("other"), F.lit(1).alias("up")).union(edges.select("u", "v", F.lit(0)))
        least = store(around.groupBy("v").agg(F.least(F.min("other"), F.col("v")).alias("m"), F.sum("up").alias("n")).filter("n > 0"), "large-star")
        large = store(join_hot(edges, least, "v", "n", mark[0]).select("u", F.col("m").alias("v")).distinct(), "large-stars")
        discard(least)
        # small star: what is less than u, and u, move to the least of them
        total = large.count()
        least = store(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small-star")
        moved = join_hot(large, least, "u", "n", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, store(moved.union(least.select("u", "m")).distinct(), "small-stars")
        discard(least, large, old)
        before, mark = mark, fingerprint(edges, "u", "v")
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return out.union(alone.join(out.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def listed_components(lists: DataFrame) -> DataFrame:
    """``node, component``: ids that occur together in any list (column ``ids``), by the least id of their cluster."""
    return components(lists.filter(F.size("ids") > 1).select(F.explode("ids").alias("b"), F.array_min("ids").alias("a")).filter("a <> b"))


def cluster_sizes(lists: DataFrame) -> DataFrame:
    """``node, component, n``: the cluster of each id that shares a list with another, and how many ids it has.

    One row per id and no array of members, so a cluster may have any size.
    """
    found = store(listed_components(lists), "clusters")
    sizes = store(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "cluster-sizes")
    return join_hot(found, sizes, "component", "n", found.count()).select("node", "component", "n")


def siblings(lists: DataFrame) -> DataFrame:
    """``node, siblings``: ids that occur together in any list (column ``ids``) form a cluster; each lists the others, sorted.

    As long as the square of the clusters; ``cluster_sizes`` gives membership alone.
    """
    found = store(listed_components(lists), "clusters")
    members = found.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    return found.join(members, "component").select("node", F.filter("members", lambda m: m != F.col("node")).alias("siblings"))


def ancestor_tree(edges: DataFrame, start: str, limit: int = 20) -> DataFrame:
    """``node, came_from, depth``: the edges above ``start``, each at its least depth, up to depth ``limit - 1``; ``came_from`` null at the start.

    A walk over a stored frontier, each node followed once. Edges that lead back
    to the start, or from a node to itself, are left out; in a graph with other
    cycles the edge that closes one is listed, but not followed.
    """
    step = store(edges.select("head", "tail").filter("head <> tail").distinct(), "edges")
    out = seen = edges.sparkSession.createDataFrame([(start, None, 0)], "node string, came_from string, depth int")
    frontier = out.select("node")
    for depth in range(1, limit):
        new = step.join(frontier, F.col("head") == F.col("node")).filter(F.col("tail") != start)
        new = store(new.select(F.col("tail").alias("node"), F.col("head").alias("came_from"), F.lit(depth).alias("depth")), "tree")
        if new.isEmpty():
            break
        frontier = new.select("node").distinct().join(seen.select("node").distinct(), "node", "left_anti")
        out = seen = out.unionByName(new)
    return out


#: Paths are counted in decimals: 38 digits hold those of 126 levels of two.
COUNT = "decimal(38,0)"


def _upwards(edges: DataFrame, targets: DataFrame, limit: int | None):
    """Levels of walks from each target to its roots: ``target, node, n, first_path``, one row per target, node and level.

    Walks that meet in a node are added up there, so a level has as many rows as
    targets have ancestors at that distance, however many paths lead to them.
    """
    step = store(edges.select("head", "tail").filter("head is not null and tail is not null").distinct(), "edges")
    most = limit if limit is not None else step.select("head").distinct().count() + 1
    level = store(targets.select(F.col("node").alias("target"), "node", F.lit(1).cast(COUNT).alias("n"), F.col("node").alias("first_path")).distinct(), "paths")
    for _ in range(most):
        yield level, step
        up = level.join(step, F.col("head") == F.col("node")).groupBy("target", F.col("tail").alias("next"))
        up = up.agg(F.sum("n").cast(COUNT).alias("n"), F.min("first_path").alias("first_path"))
        level = store(up.select("target", F.col("next").alias("node"), "n", F.concat_ws("/", "next", "first_path").alias("first_path")), "paths")
        if level.isEmpty():
            return
    if limit is None:
        raise ValueError("a walk is longer than there are nodes: the edges hold a cycle")


def path_counts(edges: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """``target, n_paths, first_path``: root-to-target paths of each target (``node``), the first by its text.

    Edges must be free of cycles (a cycle is an error); with ``limit`` only paths
    of at most so many nodes count.
    """
    found = None
    for level, step in _upwards(edges, targets, limit):
        top = level.join(step.select(F.col("head").alias("node")).distinct(), "node", "left_anti")
        found = top if found is None else found.unionByName(top)
    return found.groupBy("target").agg(F.sum("n").alias("n_paths"), F.min("first_path").alias("first_path"))


def pruned_tree(edges: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """``target, parent, child, n_paths``: the edges on any path from a root to a target, and how many ways lead on from the child to the target."""
    found = None
    for level, step in _upwards(edges, targets, limit):
        here = level.join(step, F.col("head") == F.col("node")).select("target", F.col("tail").alias("parent"), F.col("node").alias("child"), "n")
        found = here if found is None else found.unionByName(here)
    return found.groupBy("target", "parent", "child").agg(F.sum("n").alias("n_paths"))


def edges_within(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """``n``: edges whose ends are both in ``scope`` (``node``)."""
    inside = edges.join(scope.select(F.col("node").alias("head")), "head", "left_semi").join(scope.select(F.col("node").alias("tail")), "tail", "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("n"))


def scoped_edge_count(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``n``: edges whose ends are both seeds or ancestors of seeds."""
    return edges_within(edges, store(seeds.select("node").unionByName(ancestors_of_set(edges, seeds)).distinct(), "scope"))


def propagate_correlations(direct: DataFrame, closure: DataFrame, in_food: DataFrame) -> DataFrame:
    """Direct rows (``chem, disease, rel``) and, where the chemical occurs in a food, a copy for each ancestor.

    Returns ``chem, source_chem, disease, rel``.
    """
    own = direct.select("chem", F.col("chem").alias("source_chem"), "disease", "rel")
    eaten = direct.join(in_food.select("chem").distinct(), "chem", "left_semi")
    up = closure.select(F.col("node").alias("source_chem"), F.col("anc").alias("chem"))
    copied = eaten.withColumnRenamed("chem", "source_chem").join(up, "source_chem").select("chem", "source_chem", "disease", "rel")
    return own.unionByName(copied)
