from collections import Counter

from pyspark.sql import functions as F

from graphmill.operators import graph, skew


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cluster_sizes_hold_no_arrays(spark):
    lists = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["x"],), (["y", "z"],)], "ids array<string>")
    out = graph.cluster_sizes(lists)
    assert {tuple(r) for r in out.collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("y", "y", 2), ("z", "y", 2)}
    assert dict(out.dtypes) == {"node": "string", "component": "string", "n": "bigint"} and "collect_set" not in plan(out)


def test_siblings_within_a_page_come_from_their_group(spark):
    from graphmill.plans import catalog_query
    from graphmill.plans import composition as comp

    rows = spark.createDataFrame([("a", "g"), ("c", "g"), ("b", "g"), ("d", "h"), ("e", None)], "id string, group string")
    assert {r.id: r.siblings for r in comp.scoped_groups(rows).collect()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": [], "e": []}
    whole = plan(catalog_query.QUERIES["scoped_siblings"][0](spark, "/root/testdata/sf0.001"))
    assert "explode" not in whole and "array_except" not in whole  # no list per row is shuffled


def test_descriptors_of_users_beyond_a_thousand_match_the_query(spark, tmp_path):
    from graphmill.plans import catalog_files

    spark.createDataFrame([(1001, "view"), (1001, "buy"), (7, "view")], "user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, "PROMO"), (1, "SMALL"), (2, "PROMO")], "p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    out = Counter((r.kind, r.a, r.c) for r in catalog_files.QUERIES["source_flavor"][0](spark, str(tmp_path)).collect())
    assert out == Counter({("node", "1001", ""): 2, ("xref", "1001", "1001"): 2} | {(k, a, a if k == "xref" else ""): 1 for k in ("node", "xref") for a in ("7", "1002")})


def test_ids_multiply_out_without_lists(spark):
    from graphmill.operators import build

    edges = spark.createDataFrame([("1", "9", "x"), ("2", "9", "y"), ("3", "8", "z")], "head_native_id string, tail_native_id string, kind string")
    heads = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "native_id string, entity_id string")
    tails = spark.createDataFrame([("9", "p"), ("9", "q"), ("8", "r")], "native_id string, entity_id string")
    out = build.resolve_counted(edges, heads, tails)
    assert Counter((r.head_id, r.tail_id, r.kind, r.n_heads, r.n_tails) for r in out.collect()) == Counter({("a", "p", "x", 2, 2): 1, ("a", "q", "x", 2, 2): 1, ("b", "p", "x", 2, 2): 1, ("b", "q", "x", 2, 2): 1, ("a", "p", "y", 1, 2): 1, ("a", "q", "y", 1, 2): 1})
    assert "array" not in {t.split("<")[0] for _, t in out.dtypes}


def test_members_in_slices_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("i", 4)], "grp string, n int")
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "grp string, m string")
    want = Counter(map(tuple, skew.with_members(rows, members, "grp").select("grp", "n", "m").collect()))
    monkeypatch.setattr(skew, "MEMBERS", 0)
    assert Counter(map(tuple, skew.with_members(rows, members, "grp").select("grp", "n", "m").collect())) == want and sum(want.values()) == 5


def lookup(spark):
    return spark.createDataFrame([("food", "milk", ["f1", "f2"]), ("food", "cream", ["f2"]), ("chemical", "salt", ["c1", "c2"]), ("chemical", "nacl", ["c2"]), ("food", "salt", ["f9"])], "entity_type string, name string, entity_ids array<string>")


def claimed(spark):
    return spark.createDataFrame([("1", "s", "milk", "salt", "2 mg/g"), ("2", "s", "cream", "salt", "2 mg/g"), ("2", "s", "cream", "salt", "2 mg/g"), ("3", "s", "milk", "nacl", "2 mg/g"), ("4", "s", "tea", "salt", "2 mg/g"), ("5", "s", None, "salt", "2 mg/g"), ("6", "s", "milk", "salt", None)], "pmcid string, sentence string, food string, chemical string, quantity string")


def test_claims_resolve_alike_with_counts_for_lists(spark):
    from graphmill.operators import build

    want = Counter((r.pmcid, r.head_id, r.tail_id, len(r.head_candidates), len(r.tail_candidates)) for r in build.resolve_claims(claimed(spark), lookup(spark)).collect())
    out = build.resolve_claims_counted(claimed(spark), lookup(spark))
    assert Counter((r.pmcid, r.head_id, r.tail_id, r.n_heads, r.n_tails) for r in out.collect()) == want
    assert not any(t.startswith("array") for _, t in out.dtypes)


def test_claims_are_counted_as_their_triplets_list_them(spark):
    from graphmill.operators import build

    _, _, listed = build.claim_triplets(build.resolve_claims(claimed(spark), lookup(spark)), "lit")
    counted = build.claim_counts(claimed(spark), lookup(spark), "lit")
    want = {(r.head_id, r.relationship_id, r.tail_id): len(r.attestation_ids) for r in listed.collect()}
    assert Counter({(r.head_id, r.relationship_id, r.tail_id): r.n_att for r in counted.collect()}) == Counter(want) and counted.count() == len(want) == 4


def test_candidate_lists_are_not_broadcast(spark, sf_dir):
    from graphmill.plans import catalog_build

    physical = catalog_build.QUERIES["ontology_builders"][0](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    broadcast = [line for line in physical.splitlines() if "BroadcastHashJoin" in line]
    assert not any("native_id" in line or "attestation_id" in line for line in broadcast) and "SortMergeJoin" in physical


def test_score_curve_of_more_pairs_than_an_integer_holds(spark):
    from graphmill.operators import curves

    scored = spark.range(120_000).select((F.col("id") >= 60_000).cast("int").alias("label"), F.floor(F.col("id") / 1000).cast("double").alias("score"))
    assert tuple(curves.score_curve(scored).first()) == (1.0, 1.0, 1.0, 120_000, 60_000)


def test_greek_spellings_meet_by_equality(spark, sf_dir):
    from graphmill.plans import catalog_text

    physical = catalog_text.QUERIES["greek_match"][0](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in physical.splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("Contains" in line or "translate" in line for line in joins) and any("name" in line for line in joins)


def test_key_filters_are_built_without_sorting_rows(spark, tmp_path):
    from graphmill.sources import keyfilter

    spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("target")).repartition(3).write.csv(str(tmp_path / "map"))
    rows = spark.read.schema("target string").csv(str(tmp_path / "map"))
    made = keyfilter.filter_of(rows, "target")
    want = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("target").alias("least"), F.max("target").alias("most"))
    assert Counter(map(tuple, made.select("file", "least", "most").distinct().collect())) == Counter(map(tuple, want.collect()))
    assert made._jdf.queryExecution().sparkPlan().toString().count("SortAggregate") == 2  # only places that are distinct are sorted


def test_rows_of_a_group_meet_its_members_run_by_run(spark, monkeypatch):
    """So that files of the product repeat short sequences; null and repeated keys as in a join."""
    monkeypatch.setattr(skew, "RUN", 2, raising=False)
    rows = spark.createDataFrame([("g", k) for k in range(4)] + [("h", 7), ("h", 7), ("i", 8), (None, 9)], "grp string, n int").coalesce(1)
    members = spark.createDataFrame([("g", m) for m in "edcba"] + [("h", "z"), ("h", "z"), ("j", "y"), (None, "x")], "grp string, m string")
    out = [(r.grp, r.n, r.m) for r in skew.with_members(rows, members, "grp", False).select("grp", "n", "m").collect()]
    assert Counter(out) == Counter([("g", k, m) for k in range(4) for m in "abcde"] + [("h", 7, "z")] * 4)
    met = [m for g, _, m in out if g == "g"]
    assert [set(met[:8]), set(met[8:16]), set(met[16:])] == [{"a", "b"}, {"c", "d"}, {"e"}]


def test_repeated_sequences_keep_products_small_on_disk(spark, tmp_path):
    from graphmill.operators import build

    edges = spark.createDataFrame([(str(k % 3), "1") for k in range(9)], "head_native_id string, tail_native_id string").distinct()
    ids = lambda n, keys, pre: spark.range(n).select((F.col("id") % keys).cast("string").alias("native_id"), F.concat(F.lit(pre), (F.col("id") * 7919 % 100_003).cast("string")).alias("entity_id"))
    out = build.resolve_counted(edges, ids(600, 3, "h"), ids(6_000, 2, "t"))
    out.write.parquet(str(tmp_path / "out"))
    assert out.count() == 600 * 3_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * 600 * 3_000
