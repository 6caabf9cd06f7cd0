"""Graph, build and query operators on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphmill import schemas, streaming
from graphmill.operators import build, graph, text
from graphmill.plans import composition as comp
from graphmill.schemas import TRUST_SIGNALS, conform
from graphmill.sources import versions
from graphmill.storage import store


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a")], "head string, tail string")
    got = rows(graph.ancestors(e), "node", "anc")
    assert [x for x in got if x[0] == "a"] == [("a", "a"), ("a", "b"), ("a", "c")] and ("d", "c") in got and len(got) == 12
    assert rows(graph.reach(e, spark.createDataFrame([("c",)], "node string"))) == [("a",), ("b",), ("c",), ("d",)]


def test_siblings(spark):
    lists = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["x"],), (["y", "z"],)], "ids array<string>")
    assert rows(graph.siblings(lists)) == [("a", ["b", "c"]), ("b", ["a", "c"]), ("c", ["a", "b"]), ("y", ["z"]), ("z", ["y"])]


def test_labels_and_nearest(spark):
    e = spark.createDataFrame([("leaf", "mid"), ("mid", "top"), ("leaf", "side")], "head string, tail string")
    a = spark.createDataFrame([("top", "T"), ("mid", "M"), ("side", "S")], "node string, label string")
    assert dict(rows(graph.labels_by_anchor(e, a)))["leaf"] == ["M", "S", "T"]
    assert [r for r in rows(graph.nearest_groups(e, a)) if r[0] == "leaf"] == [("leaf", "M", 1), ("leaf", "S", 1)]


def test_inherited_correlation(spark):
    direct = spark.createDataFrame([("c", "d", "r3"), ("x", "d", "r4")], "chem string, disease string, rel string")
    closure = spark.createDataFrame([("c", "a"), ("x", "a")], "node string, anc string")
    food = spark.createDataFrame([("c",)], "chem string")
    assert rows(graph.propagate_correlations(direct, closure, food)) == [("a", "c", "d", "r3"), ("c", "c", "d", "r3"), ("x", "x", "d", "r4")]


def test_trust_filter_is_inclusive(spark):
    c = spark.createDataFrame([("f", "c", "lit", 2.0, "mg/100g", 0.4), ("f", "c", "lit", 8.0, "mg/100g", None), ("f", "c", "fdc", 0.0, "mg/100g", 0.9), ("f", "c", "dmd", 9.0, "g/100g", 0.9)], "food string, chem string, source string, conc double, unit string, score double")
    assert rows(comp.rollup(comp.trust_filter(c, "low_only"))) == [("f", "c", 0, 0, 1, 2.0)]
    assert rows(comp.rollup(comp.trust_filter(c, "default"))) == [("f", "c", 1, 1, 1, 8.0)]
    assert rows(comp.rollup(c)) == [("f", "c", 1, 1, 2, 5.0)]


def test_latest_score_ignores_errors(spark):
    s = spark.createDataFrame([("1", "a", "k", 0.2, 1), ("2", "a", "k", -1.0, 3), ("3", "a", "k", 0.7, 2), ("4", "a", "other", 0.9, 9)], "signal_id string, attestation_id string, signal_kind string, score double, created_at int")
    assert rows(comp.latest_scores(s, "k")) == [("a", 0.7)]


def test_upsert_changes_only_listed_columns(spark):
    cols = "signal_id string, signal_kind string, score double, reason string, error_text string, model string, created_at timestamp"
    base = spark.createDataFrame([], schemas.TRUST_SIGNALS)
    make = lambda rs: schemas.conform(spark.createDataFrame(rs, "signal_id string, signal_kind string, score double"), schemas.TRUST_SIGNALS)
    old = streaming.merge_signals(base, make([("a", "k", 0.1), ("b", "k", 0.2)]))
    new = streaming.merge_signals(old, make([("a", "changed", 0.9), ("c", "k", 0.3)]))
    assert rows(new, "signal_id", "signal_kind", "score") == [("a", "k", 0.9), ("b", "k", 0.2), ("c", "k", 0.3)]
    assert cols


def test_ids_continue_and_are_dense(spark):
    reg = spark.createDataFrame([("s", "1", "e7")], "source string, native_id string, entity_id string")
    nodes = spark.createDataFrame([("s", str(i)) for i in range(5)], "source string, native_id string")
    assert rows(build.register(reg, nodes, ["native_id"]), "native_id", "entity_id") == [("0", "e8"), ("1", "e7"), ("2", "e9"), ("3", "e10"), ("4", "e11")]


def test_attest_is_idempotent(spark):
    resolved = spark.createDataFrame([("n1", "t1", "h", "t", ["h"], ["t"], "2", "mg/g")], "head_native_id string, tail_native_id string, head_id string, tail_id string, head_candidates array<string>, tail_candidates array<string>, v string, u string")
    ev, at, tr = build.attest(resolved.union(resolved), "fdc", F.col("head_native_id"), F.lit("r1"), F.col("v"), F.col("u"))
    assert ev.count() == at.count() == tr.count() == 1
    assert at.first()["conc_value"] == 200.0 and tr.first()["attestation_ids"] == [at.first()["attestation_id"]]


def test_term_match(spark):
    s = spark.createDataFrame([(1, "Raw apple juice is sweet."), (2, "Aple juice"), (3, "nothing here")], "key int, sentence string")
    t = spark.createDataFrame([("apple juice",), ("pear",)], "term string")
    got = {r.key: (r.term, r.score) for r in text.match_terms(s, t, "key").collect()}
    assert got[1] == ("apple juice", 100.0) and got[2][0] == "apple juice" and 91 <= got[2][1] < 100 and 3 not in got


def test_empty_tables(spark):
    e = spark.createDataFrame([], "head string, tail string")
    assert graph.ancestors(e).count() == 0 and graph.components(e.toDF("a", "b")).count() == 0
    assert build.merge_triplets(spark.createDataFrame([], "head_id string, relationship_id string, tail_id string, source string, attestation_id string")).count() == 0


def test_term_match_equals_all_pairs(spark, monkeypatch):
    """1,000 random pairs and more, long sentences that lack one short token of a term included, by broadcast and by shuffle."""
    rng = random.Random(5)
    pool = "alpha beta gamma an of to linolenic acid methyl ester x flax seeds green tea leaf apple juice aple juce".split()
    sents = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    sents += [(1004, "abcdefghij klmnopqrst uvwxyzabcd qqqqq"), (1005, "gg hh hh ggg")]
    sents += [(1000, "we found that the alpha linolenic acid methyl ester fraction of flax seeds is high"), (1001, "Pear"), (1002, ""), (1003, None)]
    terms = sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(40)} | {"alpha linolenic acid methyl ester x", "pear!", "abcdefghij klmnopqrst uvwxyzabcd zzzzzz zzxxy", "hh gg ggh"})
    token = lambda x: "".join(c for c in (x or "").lower() if c.isalnum() or c.isspace()).split()
    want = {}
    for k, x in sents:
        score, term = min((-text.token_set_score(token(x), token(t)), t) for t in terms)
        if -score >= 91:
            want[k] = (term, round(-score, 6))
    assert 1001 in want and 1004 in want
    one = text.match_terms(spark.createDataFrame([(1, sents[-4][1])], "key int, sentence string"), spark.createDataFrame([("alpha linolenic acid methyl ester x",)], "term string"), "key").first()
    assert 97 < one.score < 98
    for limit in (text.BROADCAST_TOKENS, 0):
        monkeypatch.setattr(text, "BROADCAST_TOKENS", limit)
        out = text.match_terms(spark.createDataFrame(sents, "key int, sentence string"), spark.createDataFrame([(t,) for t in terms], "term string"), "key")
        assert {r.key: (r.term, round(r.score, 6)) for r in out.collect()} == want


def test_vocabulary_match_equals_all_pairs(spark):
    rng = random.Random(6)
    base = ["alpha-tocopherol", "beta carotene", "linolenic acid", "Apple Juice", "tea"]
    raws = {"".join(c for c in rng.choice(base) if rng.random() > 0.04) for _ in range(60)} | {"TEA ", "nothing like it", ""}
    got = {r.raw: (r.term, round(r.score, 6)) for r in text.match_vocabulary(spark.createDataFrame([(r,) for r in raws], "raw string"), spark.createDataFrame([(b,) for b in base], "term string")).collect()}
    want = {}
    for r in raws:
        best = max((text._indel(r.lower().strip(), b.lower()), -len(b), b) for b in base)
        if best[0] >= 90:
            want[r] = (best[2], round(best[0], 6))
    assert got == want and len(got) > 15


def test_classifier_learns_a_word(spark):
    rng = random.Random(7)
    rows = [(" ".join(rng.choice("red green blue sweet sour".split()) for _ in range(8)) + (" contains iron" if i % 2 else " has nothing"), i % 2) for i in range(200)]
    model, metrics = text.train_classifier(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, text string, label int"))
    assert min(metrics.first()[k] for k in ("precision", "recall", "f1")) > 0.95


def test_paths_are_counted_not_listed(spark):
    """A ladder of diamonds holds 4096 paths; cycles are an error or end at the limit."""
    rungs = [(f"n{k}{a}", f"n{k + 1}{b}") for k in range(12) for a in "xy" for b in "xy"]
    edges = spark.createDataFrame(rungs, "head string, tail string")
    out = graph.path_counts(edges, spark.createDataFrame([("n0x",), ("n11y",)], "node string")).collect()
    assert {r.target: (r.n_paths, r.first_path[:4]) for r in out} == {"n0x": (2**12, "n12x"), "n11y": (2, "n12x")}
    tree = graph.pruned_tree(edges, spark.createDataFrame([("n10x",)], "node string")).collect()
    assert len(tree) == 6 and {r.n_paths for r in tree} == {1} and all(r.parent > r.child for r in tree)
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "head string, tail string")
    with pytest.raises(ValueError, match="cycle"):
        graph.path_counts(ring, ring.selectExpr("head as node"))
    assert {(r.node, r.came_from) for r in graph.ancestor_tree(ring, "a").collect()} == {("a", None), ("b", "a")}


def test_scores_upserted_by_part(spark, tmp_path):
    """Later batches change only the parts they touch; a lost checkpoint loses no scores."""
    put = lambda rows: conform(spark.createDataFrame(rows, "signal_id string, score double, created_at timestamp"), TRUST_SIGNALS).write.mode("append").parquet(f"{tmp_path}/in")
    day = lambda n: dt.datetime(2024, 1, n)
    assert streaming.read_signals(spark, f"{tmp_path}/out").count() == 0
    put([(f"s{i}", 0.1, day(1)) for i in range(50)])
    streaming.upsert_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c1", 4).awaitTermination()
    put([("s1", 0.9, day(2)), ("s99", 0.5, day(2))])
    streaming.upsert_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c1", 4).awaitTermination()
    got = {r.signal_id: r.score for r in streaming.read_signals(spark, f"{tmp_path}/out").collect()}
    assert len(got) == 51 and got["s1"] == 0.9 and got["s99"] == 0.5 and got["s2"] == 0.1
    first, second = (versions.snapshot(spark, f"{tmp_path}/out", n).tables["signals"] for n in (0, 1))
    assert len(first) == 4 and 1 <= sum(first[k] != second[k] for k in first) <= 2
    assert streaming.read_signals(spark, f"{tmp_path}/out", 0).count() == 50
    streaming.upsert_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c2", 4).awaitTermination()
    assert {r.signal_id: r.score for r in streaming.read_signals(spark, f"{tmp_path}/out").collect()} == got


def test_expanded_composition_joins_claims_once(spark, sf_dir):
    """Triplets, attestations and evidence come from claims that are kept, not from three joins of line items and orders."""
    from graphmill.plans import catalog

    df = catalog.queries()["composition_expanded"](spark, sf_dir)
    assert df.count() > 0 and not any("lineitem" in f or "orders" in f for f in df.inputFiles())


def test_sentences_of_the_same_words_are_matched_once(spark, monkeypatch):
    """Copies reach the pairs as one text, each gets the same row, and a key with several sentences keeps the best."""
    met = []
    monkeypatch.setattr(text, "store", lambda df, name: (met.append(df.count()) if name == "sentences" else None, store(df, name))[1])
    sents = [(k, f"Green tea leaf {k % 3}!") for k in range(90)] + [(90, "green tea"), (90, "apple juice x")]
    out = text.match_terms(spark.createDataFrame(sents, "key int, sentence string"), spark.createDataFrame([("green tea leaf",), ("apple juice",)], "term string"), "key")
    assert sorted((r.key, r.term, r.score) for r in out.collect()) == [(k, "green tea leaf", 100.0) for k in range(90)] + [(90, "apple juice", 100.0)]
    assert met == [5]
