"""Distributed selection, deep pages, release digests, resumable scoring, threshold-free measures, key filters."""

from __future__ import annotations

import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphmill.operators import curves, ledger, pages, releases, select
from graphmill.sources import keyfilter, versions


@pytest.mark.parametrize("largest", [5, 10_000])
def test_group_medians_equal_plain_ones(spark, largest):
    rng = random.Random(2)
    rows = [("even", float(k)) for k in range(400)] + [("odd", rng.gauss(0, 1e6)) for _ in range(777)] + [("ties", rng.choice([1.0, 1.0, 2.0, 2.0, 7.5])) for _ in range(500)]
    rows += [("two", -1.0), ("two", 4.0), ("one", 3.0), ("none", None), (None, 5.0), (None, 6.0), ("tiny", 1e-300), ("wide", -1e300), ("wide", 1e300), ("wide", 0.0)] + [("same", 9.0)] * 300
    rows += [("far", v) for v in [1e-9 * k for k in range(200)] + [1e12 * k for k in range(201)]] + [(None, float(k)) for k in range(30)]
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    want = {k: statistics.median([v for v in vs if v is not None]) if any(v is not None for v in vs) else None for k, vs in groups.items()}
    got = [tuple(r) for r in select.group_medians(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", largest).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert select.group_medians(spark.createDataFrame([], "g string, v double"), ["g"], "v", largest).count() == 0


def test_deep_pages_equal_the_sort(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path)
    rows = [(k, rng.choice([None, rng.random(), 0.5])) for k in range(5000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    order = [F.desc_nulls_last("v"), F.col("id").asc()]
    pages.build_order(df, order, root, 400)
    held = pages.Order(spark, root, df.schema)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert held.total == 5000 and len(held.parts) > 5
    for number, size in ((1, 10), (77, 30), (500, 10), (9, 500), (501, 10), (167, 30), (1, 6000)):
        got = sorted((r.rank, r.id, r.v) for r in held.page(number, size).collect())
        part = want[(number - 1) * size : number * size]
        assert got == [((number - 1) * size + i + 1, *r) for i, r in enumerate(part)]
        if size == 10 and number < 501:
            assert len(held.page(number, size).inputFiles()) <= 2
    pages.build_order(df.limit(0), order, f"{root}/none")
    assert pages.Order(spark, f"{root}/none", df.schema).page(1, 5).count() == 0


def test_small_parts_are_cut_from_few_ranges(spark, tmp_path, monkeypatch):
    """Samples of the ranges go to the driver, so their number may not follow the parts."""
    cut, asked = type(spark.range(1)).repartitionByRange, []
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda df, n, *by: asked.append(n) or cut(df, n, *by))
    df, root = spark.range(20_000).withColumn("v", F.xxhash64("id")), str(tmp_path)
    pages.build_order(df, [F.col("v"), F.col("id")], root, 50)
    held = pages.Order(spark, root, df.schema)
    assert asked == [pages.RANGES] and 400 <= len(held.parts) <= 600
    assert max(b - a for a, b in zip(held.starts, [*held.starts[1:], held.total])) <= 50
    want = sorted((r.v, r.id) for r in df.collect())
    for number in (1, 11, 999, 2000):
        assert [(r.v, r.id) for r in held.page(number, 10).orderBy("rank").collect()] == want[10 * (number - 1) : 10 * number]


def test_release_diff_reads_what_differs(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), "k int, a string, b double"
    old = [(k, f"a{k}", float(k)) for k in range(3000)] + [(None, "null key", 1.0)]
    new = [(k, a, -1.0 if k == 17 else b) for k, a, b in old if k not in (5, 900)] + [(3001, None, None)]
    one = releases.write_release(spark.createDataFrame(old, schema), ["k"], root, 256)
    two = releases.write_release(spark.createDataFrame(new, schema).repartition(5), ["k"], root, 256)
    read, whole = [], versions.read
    monkeypatch.setattr(versions, "read", lambda s, r, table, schema, at=None, parts=None: read.append((table, parts)) or whole(s, r, table, schema, at, parts))
    diff = sorted((r.k, r.status) for r in releases.diff_releases(spark, root, ["k"], schema, one, two).collect())
    assert diff == [(5, "removed"), (17, "changed"), (900, "removed"), (3001, "new")]
    assert all(len(parts) <= 4 for table, parts in read if table in ("rows", "lower"))
    three = releases.write_release(spark.createDataFrame(new, schema), ["k"], root, 256)
    assert releases.diff_releases(spark, root, ["k"], schema, two, three).count() == 0
    gone = releases.write_release(spark.createDataFrame([], schema), ["k"], root, 256)
    assert releases.diff_releases(spark, root, ["k"], schema, three, gone).groupBy("status").count().collect() == [("removed", len(new))]


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    root, schema = str(tmp_path), "id int, p double"

    def load():
        return lambda batch: pd.DataFrame({"id": batch["id"], "p": batch["text"].str.len().astype(float)})

    rows = [(k, "x" * k) for k in range(100)]
    run = lambda rs, **kw: ledger.score_resumably(spark.createDataFrame(rs, "id int, text string"), "id", root, schema, load, 16, 4, **kw)
    held = lambda: {r.id: r.p for r in ledger.read_scores(spark, root, schema).collect()}
    first = run(rows, waves=2)
    assert 0 < first < 100 and len(held()) == first
    assert run(rows) == 100 - first and held() == {k: float(k) for k in range(100)}
    assert run(rows) == 0
    changed = [(k, t if k != 42 else "changed") for k, t in rows if k != 7] + [(500, "new one")]
    assert run(changed) == 2  # of two chunks, only the rows that are new to them
    assert held() == {k: float(len(t)) for k, t in changed}
    assert run([(500, "new one")] * 3) == 0 and held() == {500: 7.0}

    def dying():
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ledger.score_resumably(spark.createDataFrame([(1, "a")], "id int, text string"), "id", root, schema, dying, 16, 4)
    assert held() == {500: 7.0}


def test_curve_by_all_thresholds(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0.1, 0.2, 0.2, 0.5, 0.9, rng.random()]), rng.choice([0, 1])) for _ in range(400)]
    got = curves.score_curve(spark.createDataFrame([*rows, (None, 1), (0.3, None)], "score double, label int")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap = f1 = seen = 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap, seen, f1 = ap + (tp - seen) * tp / (tp + fp) / len(pos), tp, max(f1, 2 * tp / (tp + fp + len(pos)))
    assert (got.n, got.positives) == (400, len(pos))
    assert abs(got.auc - auc) < 1e-12 and abs(got.average_precision - ap) < 1e-12 and abs(got.best_f1 - f1) < 1e-12
    lone = curves.score_curve(spark.createDataFrame([(0.5, 1)], "score double, label int")).first()
    assert lone.auc is None and lone.average_precision == 1.0
    assert curves.score_curve(spark.createDataFrame([], "score double, label int")).first().n == 0


def test_grouped_folds_leave_their_group_out(spark):
    """Copies share a fold; a fold's weights equal those counted without it; a word that only copies hold teaches their fold nothing."""
    rng = random.Random(5)
    words = "red green blue sweet sour leaf".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(6)) + (" iron" if k % 2 else " zinc"), k % 2) for k in range(200)]
    rows += [(1000 + k, "onlycopy iron leaf", 1) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, label int").withColumn("fold", curves.fold_of(F.col("text"), 4))
    assert df.filter("id >= 1000").select("fold").distinct().count() == 1
    counts = curves.word_counts(df)
    weights, priors = curves.word_weights(*counts, 3, True)
    mine = {(r.fold, r.word): r.weight for r in weights.collect()}
    for f in range(4):
        w, _ = curves.word_weights(*curves.word_counts(df.filter(F.col("fold") != f)), 3, False)
        assert {k[1]: round(v, 9) for k, v in mine.items() if k[0] == f} == {r.word: round(r.weight, 9) for r in w.collect()}
    own = df.filter("id = 1000").first().fold
    assert (own, "onlycopy") not in mine and sum(k[1] == "onlycopy" for k in mine) == 3
    scored = curves.bayes_scores(df.filter("id < 1000"), "id", weights, priors).join(df.select("id", "label"), "id")
    assert curves.score_curve(scored).first().auc > 0.99
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "unknown", 0)], "id int, text string, fold int")
    assert len({r.score for r in curves.bayes_scores(odd, "id", weights, priors).collect()}) == 1


def test_key_filter_spares_files(spark, tmp_path):
    path, side = f"{tmp_path}/map", f"{tmp_path}/filter"
    rng = random.Random(6)
    keys = [f"CHEBI:{rng.randint(0, 10**6)}" for _ in range(6000)]
    spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)] + [(None, "x")], "k string, v string").repartition(24).write.csv(path)
    read = lambda *at: spark.read.schema("k string, v string").csv(*at if at else (path,))
    keyfilter.build_filter(read(), "k", side)
    for n in (1, 3):
        asked = spark.createDataFrame([(k,) for k in rng.sample(keys, n)] + [("CHEBI:none",), (None,)], "k string")
        files = keyfilter.candidate_files(spark, side, asked, "k")
        want = sorted(tuple(r) for r in read().join(asked, "k").collect())
        got = sorted(tuple(r) for r in read(files).join(asked, "k").collect())
        assert got == want and len(files) <= len(want) + 1
    assert keyfilter.candidate_files(spark, side, spark.createDataFrame([("nothing",)], "k string"), "k") == []


def test_rollup_with_selected_medians_equals_plain(spark):
    from graphmill.plans import composition as comp

    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["c", "d", None]), rng.choice(comp.SOURCES), rng.choice([None, 0.0, 1.0, 2.5, 7.0]), rng.choice(["mg/100g", "g/100g"])) for _ in range(400)]
    c = spark.createDataFrame(rows, "food string, chem string, source string, conc double, unit string")
    assert sorted(map(str, comp.rollup(c).collect())) == sorted(map(str, comp.rollup(c, 20).collect()))


def test_newest_release():
    from graphmill.sources import readers

    assert readers.newest_release(["/x/2024-04", "/x/2024-10", "/x/2023-12"]) == "/x/2024-10"


def test_disambiguation_of_a_hot_name(spark):
    from graphmill.operators import build

    rows = [(str(k), "water", f"c{k}", None) for k in range(3000)] + [("a", "salt", None, "p1"), ("b", "iron", None, None), ("c", None, "x", None)]
    nodes = spark.createDataFrame(rows, "native_id string, name string, chebi string, pubchem string")
    out = {r.native_id: r.display_name for r in build.disambiguate(nodes, spark.createDataFrame([("salt",), ("salt",)], "name string"), ["chebi", "pubchem"]).collect()}
    assert out["7"] == "water (CHEBI:c7)" and out["a"] == "salt (PUBCHEM:p1)" and out["b"] == "iron" and out["c"] is None and len(out) == len(rows)
