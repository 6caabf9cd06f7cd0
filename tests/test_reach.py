"""Components by stars, closure upkeep and reachability labels against plain recomputation."""

from __future__ import annotations

import random

import pytest

from graphmill.operators import graph, reach
from graphmill.sources import versions

EDGE = "head string, tail string"


def closure_of(edges):
    up = {}
    for h, t in edges:
        up.setdefault(h, set()).add(t)
    out = set()
    for start in up:
        todo, seen = list(up[start]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out |= {(start, x) for x in seen}
    return out


def test_components_by_stars(spark):
    rng = random.Random(4)
    links = [(f"n{rng.randint(0, 400):03d}", f"n{rng.randint(0, 400):03d}") for _ in range(330)]
    links += [("hub", f"x{k}") for k in range(3000)] + [(f"z{k:04d}", f"z{k + 1:04d}") for k in range(200)]  # a star around a lesser and a chain
    links += [(f"a{k}", "star") for k in range(3000)] + [("self", "self"), (None, "a1"), ("a1", None), ("hub", "x1")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        if a and b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = [tuple(r) for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in root}


@pytest.mark.parametrize("cyclic", [False, True])
def test_closure_upkeep_equals_recomputation(spark, tmp_path, cyclic):
    rng, root, nodes = random.Random(9), str(tmp_path), [f"n{k:02d}" for k in range(24)]

    def some(n):
        out = set()
        while len(out) < n:
            a, b = rng.choice(nodes), rng.choice(nodes)
            if a != b or cyclic:
                out.add((a, b) if cyclic or a > b else (b, a))
        return out

    frame = lambda es: spark.createDataFrame(sorted(es) + [(None, "n01")], EDGE)
    edges = some(26)
    reach.create_closure(frame(edges), root, 8)
    for _ in range(4):
        gone, fresh = set(rng.sample(sorted(edges), 4)) | {("n99", "n98")}, some(4) | set(rng.sample(sorted(edges), 1))
        edges = (edges - gone) | fresh
        reach.change_closure(spark, root, frame(fresh), frame(gone), 8)
        assert {tuple(r) for r in reach.read_closure(spark, root).collect()} == closure_of(edges)
        assert {tuple(r) for r in versions.read(spark, root, "edges", reach.EDGES).collect()} == edges
        down = [tuple(r) for r in versions.read(spark, root, "down", reach.PAIRS).collect()]
        assert len(down) == len(set(down)) and set(down) == closure_of(edges)


def test_closure_upkeep_touches_what_changes(spark, tmp_path):
    """One leaf under one of 40 separate chains: few parts are written, and the last pairs of a part may go."""
    root = str(tmp_path)
    edges = [(f"c{k}-{i}", f"c{k}-{i + 1}") for k in range(40) for i in range(3)]
    first = reach.create_closure(spark.createDataFrame(edges, EDGE), root)
    second = reach.change_closure(spark, root, spark.createDataFrame([("leaf", "c7-0")], EDGE), spark.createDataFrame([], EDGE))
    changed = {t: sum(second.tables[t].get(p) != first.tables[t].get(p) for p in {**second.tables[t], **first.tables[t]}) for t in second.tables}
    assert changed["up"] == 1 and changed["down"] <= 4 and changed["edges"] == 1
    third = reach.change_closure(spark, root, spark.createDataFrame([], EDGE), spark.createDataFrame([("leaf", "c7-0"), ("c7-0", "c7-1")], EDGE))
    assert third.number == 2
    assert {tuple(r) for r in reach.read_closure(spark, root).collect()} == closure_of(set(edges) - {("c7-0", "c7-1")})
    assert reach.change_closure(spark, root, spark.createDataFrame([], EDGE), spark.createDataFrame([("no", "such")], EDGE)).number == 2


def test_reach_labels_equal_closure(spark):
    rng = random.Random(3)
    nodes = [f"n{k:02d}" for k in range(40)]
    edges = {tuple(sorted(rng.sample(nodes, 2), reverse=True)) for _ in range(60)}
    edges |= {("q1", "q2"), ("q2", "q3"), ("q3", "q1"), ("q0", "q1"), ("q3", "n00"), ("loop", "loop")}  # cycles, and nodes below them
    frame = spark.createDataFrame(sorted(edges) + [(None, "n01")], EDGE)
    labels = reach.reach_labels(frame)
    every = sorted({x for e in edges for x in e} | {"stranger"})
    pairs = spark.createDataFrame([(a, b) for a in every for b in every] + [("n01", None)], reach.PAIRS)
    got = {(r.node, r.anc) for r in reach.is_below(pairs, frame, labels).filter("below").collect()}
    assert got == closure_of(edges)
    assert reach.is_below(pairs, frame, labels).count() == len(every) ** 2
    empty = spark.createDataFrame([], EDGE)
    assert reach.reach_labels(empty).count() == 0


def test_bits_rule_out_what_lows_leave_open(spark):
    """Leaves under two parents each, asked about parents that are not theirs: labels alone decide nearly all, as no walk has to."""
    edges = [(f"x{k:03d}", f"a{k % 7}") for k in range(300)] + [(f"x{k:03d}", f"b{k % 20:02d}") for k in range(300)]
    edges += [(f"a{k}", "top") for k in range(7)] + [(f"b{k:02d}", "top") for k in range(20)]
    rows = {r.node: r.asDict() for r in reach.reach_labels(spark.createDataFrame(edges, EDGE)).collect()}
    below, ups = closure_of(edges), [f"up_{k}" for k in range(reach.ORDERS)]
    covered = lambda node, anc: all(rows[node][u] & rows[anc][u] == rows[anc][u] for u in ups)
    assert all(covered(*p) for p in below)
    others = [(f"x{k:03d}", f"b{j:02d}") for k in range(300) for j in range(20) if j != k % 20]
    assert sum(covered(*p) for p in others) < len(others) / 50
