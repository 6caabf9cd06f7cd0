"""Construction of the graph: evidence, attestations, triplets, entities, registry.

Everything is a function from DataFrames to DataFrames; "first" always names its
order, and collected arrays are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import concentration
from ..functions.names import content_id, pick_common_name, signal_id
from ..storage import store
from .skew import join_hot, with_members


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def native_ids(entities: DataFrame, key: str) -> DataFrame:
    """``native_id, entity_id``: each id of one kind with every entity that carries it, a row each."""
    return entities.select("entity_id", F.explode(F.try_element_at("external_ids", F.lit(key))).alias("native_id")).filter("native_id is not null").distinct()


def explode_ids(entities: DataFrame, key: str) -> DataFrame:
    """``native_id, entity_id, candidates``: each id of one kind with every entity that carries it; as long as the square of an id's bearers."""
    flat = entities.select("entity_id", F.explode(F.try_element_at("external_ids", F.lit(key))).alias("native_id")).distinct()
    return flat.groupBy("native_id").agg(F.array_sort(F.collect_set("entity_id")).alias("candidates")).withColumn("entity_id", F.explode("candidates"))


def resolve_edges(edges: DataFrame, heads: DataFrame, tails: DataFrame, loops: bool = False) -> DataFrame:
    """Edges with both ends resolved: ``head_id, tail_id, head_candidates, tail_candidates`` and the edge's columns; edges within one entity go unless ``loops``."""
    h = heads.select(F.col("native_id").alias("head_native_id"), F.col("entity_id").alias("head_id"), F.col("candidates").alias("head_candidates"))
    t = tails.select(F.col("native_id").alias("tail_native_id"), F.col("entity_id").alias("tail_id"), F.col("candidates").alias("tail_candidates"))
    # candidate lists are far larger than the file they are made from suggests: they are not sent to every task
    found = edges.join(h.hint("merge"), "head_native_id").join(t.hint("merge"), "tail_native_id")
    return found if loops else found.filter("head_id <> tail_id")


def resolve_counted(edges: DataFrame, heads: DataFrame, tails: DataFrame, few: bool = True) -> DataFrame:
    """Edges with both ends resolved, how many candidates each end has beside them: ``head_id, tail_id, n_heads, n_tails`` and the edge's columns.

    ``heads`` and ``tails`` are distinct ``native_id, entity_id``. Candidates are
    counted, not listed, so an id may have any number of bearers. ``few`` edges
    are dealt out once more after their heads are known.
    """
    def side(ids: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
        key = f"{end}_native_id"
        named = ids.select(F.col("native_id").alias(key), F.col("entity_id").alias(f"{end}_id"))
        return named, named.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(f"n_{end}s"))

    (h, nh), (t, nt) = side(heads, "head"), side(tails, "tail")
    counted = edges.join(nh, "head_native_id").join(nt, "tail_native_id")
    return with_members(with_members(counted, h, "head_native_id"), t, "tail_native_id", few)


def attest(resolved: DataFrame, source: str, reference: Column, relation: Column, value: Column | None = None, unit: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, attestations, triplets) of resolved edges; ids follow from content, so a second run adds nothing."""
    none = F.lit(None).cast("string")
    full = resolved.withColumns({"reference": reference, "relationship_id": relation, "source": F.lit(source), "raw_value": (value if value is not None else none).cast("string"), "raw_unit": unit if unit is not None else none})
    full = full.withColumn("evidence_id", content_id("ev", F.lit(source), F.col("reference")))
    full = full.withColumn("attestation_id", content_id("at", F.col("evidence_id"), F.col("source"), F.col("head_native_id"), F.col("tail_native_id")))
    evidence = full.select("evidence_id", F.col("source").alias("source_type"), "reference").dropDuplicates(["evidence_id"])
    kept = first_per(full, ["attestation_id"], [F.col("raw_value").asc_nulls_last(), F.col("head_id"), F.col("tail_id")])
    # converted once for each attestation that is kept
    attestations = concentration.with_converted(kept, F.col("raw_value"), F.col("raw_unit")).select("attestation_id", "evidence_id", "source", F.col("head_native_id").alias("head_name_raw"), F.col("tail_native_id").alias("tail_name_raw"), "conc_value", F.when(F.col("conc_value").isNotNull(), "mg/100g").alias("conc_unit"), F.col("raw_value").alias("conc_value_raw"), F.col("raw_unit").alias("conc_unit_raw"), "head_candidates", "tail_candidates")
    return evidence, attestations, merge_triplets(full.select("head_id", "relationship_id", "tail_id", "source", "attestation_id"))


def merge_triplets(rows: DataFrame) -> DataFrame:
    """One row per (head, relation, tail): sorted distinct attestation ids, the least source."""
    return rows.groupBy("head_id", "relationship_id", "tail_id").agg(F.min("source").alias("source"), F.array_sort(F.collect_set("attestation_id")).alias("attestation_ids"))


def append_triplets(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two triplet tables, attestation ids merged."""
    both = old.unionByName(new, allowMissingColumns=True).withColumn("attestation_id", F.explode_outer("attestation_ids")).drop("attestation_ids")
    return merge_triplets(both)


def add_ontology(triplets: DataFrame, keys: DataFrame) -> DataFrame:
    """Triplets plus new (head, relation, tail) keys without attestations."""
    on = ["head_id", "relationship_id", "tail_id"]
    fresh = keys.select(*on).dropDuplicates().join(triplets, on, "left_anti")
    return triplets.unionByName(fresh.withColumns({"source": F.lit(""), "attestation_ids": F.array().cast("array<string>")}), allowMissingColumns=True)


def labelled_parents(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``head, tail, rule``: nodes (``node, labels``) under the parent of each label they carry (``label, parent``)."""
    named = nodes.select("node", F.explode("labels").alias("label"))
    return named.join(rules, "label").filter("node <> parent").select(F.col("node").alias("head"), F.col("parent").alias("tail"), F.col("label").alias("rule"))


def bridges(pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Hand-made is_a pairs of names (``head_name, tail_name``) as entity ids; a pair with an unknown name is left out."""
    by = lambda c, as_: lookup.select(F.col("name").alias(c), F.col("entity_id").alias(as_))
    return pairs.join(by("head_name", "head"), "head_name").join(by("tail_name", "tail"), "tail_name").filter("head <> tail").select("head", "tail")


def milk_triplets(edges: DataFrame, tails: DataFrame, milk: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Composition of milk: one fixed head, tails resolved, values as given in ``conc_value`` (mg/100g)."""
    t = tails.select(F.col("native_id").alias("tail_native_id"), F.col("entity_id").alias("tail_id"), F.col("candidates").alias("tail_candidates"))
    rows = edges.join(t, "tail_native_id").withColumns({"head_id": F.lit(milk), "head_native_id": F.lit("milk"), "head_candidates": F.array(F.lit(milk))})
    return attest(rows, "dmd", F.to_json(F.struct("tail_native_id")), F.lit("r1"), F.col("conc_value"), F.lit("mg/100g"))


# fixed values: which evidence of a chemical-disease association makes which relation
DIRECT_EVIDENCE = {"marker/mechanism": "r3", "therapeutic": "r4"}


def disease_triplets(edges: DataFrame, chemicals: DataFrame, diseases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correlations: edges with ``direct_evidence`` and ``pubmed_ids``; one evidence per publication."""
    relation = F.try_element_at(F.create_map(*(F.lit(x) for kv in DIRECT_EVIDENCE.items() for x in kv)), F.col("direct_evidence"))
    rows = edges.withColumn("relation", relation).filter("relation is not null").withColumn("pmid", F.explode("pubmed_ids"))
    return attest(resolve_edges(rows, chemicals, diseases), "ctd", F.to_json(F.struct("pmid")), F.col("relation"))


def food_triplets(edges: DataFrame, foods: DataFrame, nutrients: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Composition from tables: ``amount`` per 100 g in the nutrient's unit (``tail_native_id, unit_name``; milligrams by default)."""
    rows = edges.join(units, "tail_native_id", "left")
    unit = F.concat(F.lower(F.coalesce("unit_name", F.lit("mg"))), F.lit("/100g"))
    return attest(resolve_edges(rows, foods, nutrients), "fdc", F.to_json(F.struct("head_native_id")), F.lit("r1"), F.col("amount"), unit)


def named_ids(claims: DataFrame, lut: DataFrame, kind: str, name: str, as_: str) -> DataFrame:
    """(``name``, ``as_``): the ids of one kind that bear a name of the claims, a row each."""
    bearers = lut.filter(F.col("entity_type") == kind).select(F.col("name").alias(name), F.col("entity_ids"))
    return bearers.join(claims.select(name).distinct(), name, "left_semi").select(name, F.explode("entity_ids").alias(as_))


def resolve_claims(claims: DataFrame, lut: DataFrame, head: str = "food", tail: str = "chemical") -> DataFrame:
    """Claims with both names known, once for each pair of candidates; candidate lists are kept beside."""
    side = lambda kind, name, as_: lut.filter(F.col("entity_type") == kind).select(F.col("name").alias(name), F.col("entity_ids").alias(as_))
    both = claims.join(side("food", head, "head_candidates"), head).join(side("chemical", tail, "tail_candidates"), tail)
    return both.withColumn("head_id", F.explode("head_candidates")).withColumn("tail_id", F.explode("tail_candidates"))


def resolve_claims_counted(claims: DataFrame, lut: DataFrame, head: str = "food", tail: str = "chemical") -> DataFrame:
    """As ``resolve_claims``, with ``n_heads, n_tails`` in place of the candidate lists, so a name may have any number of bearers."""
    ids = lambda kind, name: named_ids(claims, lut, kind, name, "entity_id").withColumnRenamed(name, "native_id")
    found = resolve_counted(claims.withColumnsRenamed({head: "head_native_id", tail: "tail_native_id"}), ids("food", head), ids("chemical", tail), few=False)
    return found.withColumnsRenamed({"head_native_id": head, "tail_native_id": tail})


def claim_triplets(resolved: DataFrame, method: str, head: str = "food", tail: str = "chemical") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, attestations, triplets) of resolved literature claims: one evidence per article and sentence (``pmcid, sentence``), ``quantity`` as text."""
    rows = resolved.withColumns({"head_native_id": F.col(head), "tail_native_id": F.col(tail)})
    rows = rows.select("*", F.explode(F.array(concentration.parse(F.col("quantity")))).alias("__conc"))
    return attest(rows, method, F.to_json(F.struct("pmcid", "sentence")), F.lit("r1"), F.col("__conc.value"), F.col("__conc.unit"))


def _alike(ids: DataFrame, name: str, entity: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(``name, group``, ``group, entity``): entities that bear the same names are one group."""
    members = store(ids.groupBy(entity).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(name))), 256).alias(group), F.collect_set(name).alias(name)), "alike")
    return members.groupBy(group).agg(F.any_value(name).alias(name)).select(group, F.explode(name).alias(name)), members.select(group, entity)


def claim_counts(claims: DataFrame, lut: DataFrame, method: str, head: str = "food", tail: str = "chemical") -> DataFrame:
    """``head_id, relationship_id, tail_id, n_att``: the triplets of ``claim_triplets``, their attestations counted.

    The candidates of a pair of names share its attestations, and a name pair has
    attestations of its own: these are counted per pair of names, added up per
    pair of groups of entities that bear the same names, and only then given to
    the members, each pair of which is met once. Nothing is shuffled per pair.
    """
    rows = claims.withColumn("__conc", F.explode(F.array(concentration.parse(F.col("quantity")))))
    evidence = content_id("ev", F.lit(method), F.to_json(F.struct("pmcid", "sentence")))
    attestation = content_id("at", evidence, F.lit(method), F.col(head), F.col(tail)).alias("__at")
    counted = rows.select(head, tail, attestation).filter(F.col(head).isNotNull() & F.col(tail).isNotNull()).distinct().groupBy(head, tail).agg(F.count(F.lit(1)).alias("n"))
    names = store(counted, "name-pairs")
    (heads, h), (tails, t) = (_alike(named_ids(names, lut, kind, name, f"{end}_id"), name, f"{end}_id", f"__{end}") for kind, name, end in (("food", head, "head"), ("chemical", tail, "tail")))
    groups = store(names.join(heads, head).join(tails, tail).groupBy("__head", "__tail").agg(F.sum("n").alias("n_att")), "group-pairs")
    found = with_members(with_members(groups, h, "__head"), t, "__tail")
    return found.select("head_id", F.lit("r1").alias("relationship_id"), "tail_id", "n_att")


def resolution_counts(claims: DataFrame, lut: DataFrame, head: str = "food", tail: str = "chemical") -> DataFrame:
    """``counter, n``: rows, resolved and dropped rows, unique, ambiguous and unknown names, rows that ambiguity adds."""
    side = lambda kind, as_: lut.filter(F.col("entity_type") == kind).select(F.col("name").alias(as_), F.size("entity_ids").alias(f"n_{as_}"))
    j = claims.select(head, tail).join(side("food", head), head, "left").join(side("chemical", tail), tail, "left")
    h, t = F.coalesce(f"n_{head}", F.lit(0)), F.coalesce(f"n_{tail}", F.lit(0))
    ok = (h > 0) & (t > 0)
    names = lambda c, cond: F.count_distinct(F.when(cond, F.col(c)))
    out = {
        "rows": F.count(F.lit(1)),
        "resolved": F.count_if(ok),
        "dropped": F.count_if(~ok),
        "heads": F.count_distinct(head),
        "tails": F.count_distinct(tail),
        "heads_unknown": names(head, h == 0),
        "tails_unknown": names(tail, t == 0),
        "heads_ambiguous": names(head, h > 1),
        "tails_ambiguous": names(tail, t > 1),
        "rows_out": F.sum(F.when(ok, h * t).otherwise(0)),
        "rows_added": F.sum(F.when(ok, h * t - 1).otherwise(0)),
        "rows_ambiguous": F.count_if(ok & (h * t > 1)),
    }
    one = j.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in out.items()))
    return one.select(F.explode(F.map_entries(F.create_map(*(x for k in out for x in (F.lit(k), F.col(k)))))).alias("e")).select(F.col("e.key").alias("counter"), F.col("e.value").alias("n"))


def unresolved(names: DataFrame, known: DataFrame, samples: int = 3) -> DataFrame:
    """``name, n, samples``: unknown names with how often they occur and their first references (``name, reference``)."""
    lost = names.join(known.select("name").distinct(), "name", "left_anti")
    w = Window.partitionBy("name").orderBy("reference")
    ranked = lost.withColumn("__n", F.row_number().over(w))
    return ranked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("__n") <= samples, F.col("reference")))).alias("samples"))


def assign_ids(fresh: DataFrame, order: list[str], highest: int) -> DataFrame:
    """``entity_id`` = e and the next numbers after ``highest``, in the order given.

    Rows are range-partitioned and counted per partition, so no task sees all of
    them; the counts (one per partition) are the only rows collected.
    """
    spark = fresh.sparkSession
    sort = [F.col(c).asc_nulls_last() for c in order]
    placed = store(fresh.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    starts, at = [], highest + 1
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    table = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    number = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(table, "__part").withColumn("entity_id", F.concat(F.lit("e"), number)).drop("__at", "__part", "__start")


def highest_id(ids: DataFrame) -> int:
    """The greatest number among ids ``e<number>``; -1 without any."""
    row = ids.agg(F.max(F.substring("entity_id", 2, 20).try_cast("bigint"))).first()
    return -1 if row[0] is None else row[0]


def register(registry: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with an ``entity_id``: the registered one, or a new one where (source, native_id) is unknown."""
    joined = nodes.join(registry, ["source", "native_id"], "left")
    old = joined.filter("entity_id is not null")
    return old.unionByName(assign_ids(joined.filter("entity_id is null").drop("entity_id"), order, highest_id(registry)).select(*old.columns))


def register_alias(registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Further native ids for entities; known rows stay single."""
    return registry.unionByName(aliases).distinct()


def reassign(registry: DataFrame, moves: DataFrame) -> DataFrame:
    """Registry rows moved to another entity (``source, native_id, entity_id``)."""
    on = ["source", "native_id"]
    return registry.join(moves, on, "left_anti").unionByName(moves.select(*registry.columns))


def registry_conflicts(registry: DataFrame) -> DataFrame:
    """Native ids registered more than once."""
    return registry.groupBy("source", "native_id").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1")


def seed_registry(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """``source, native_id, entity_id, is_primary`` from the id maps of an earlier release.

    ``rules`` maps (entity_type, key) to a source; the first id of a list is the
    primary one; ids that are blank or placeholders are left out.
    """
    flat = entities.select("entity_id", "entity_type", F.explode("external_ids").alias("key", "ids")).select("*", F.posexplode("ids").alias("__pos", "native_id"))
    named = flat.join(rules, ["entity_type", "key"])
    return named.filter(~F.trim("native_id").isin("", "nan", "None")).select("source", "native_id", "entity_id", (F.col("__pos") == 0).alias("is_primary"))


def merge_ids(long: DataFrame) -> DataFrame:
    """``entity_id, external_ids``: a map per entity from rows (entity_id, key, value), values distinct and sorted."""
    lists = long.filter("value is not null").groupBy("entity_id", "key").agg(F.array_sort(F.collect_set("value")).alias("ids"))
    return lists.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "ids")))).alias("external_ids"))


def link_tiers(records: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """``native_id, entity_id, tier``: each record (``native_id``) takes the matches of the first tier that has any."""
    left, out = records.select("native_id").distinct(), []
    for k, tier in enumerate(tiers, 1):
        hit = left.join(tier.select("native_id", "entity_id").distinct(), "native_id").withColumn("tier", F.lit(k))
        out.append(hit)
        left = left.join(hit, "native_id", "left_anti")
    return reduce(DataFrame.unionByName, out)


def link_with_overrides(xrefs: DataFrame, overrides: DataFrame, multi: DataFrame) -> DataFrame:
    """xrefs (``native_id, target``) whose target is replaced by ``multi``, else by ``overrides``."""
    o, m = overrides.select("native_id", F.col("target").alias("__o")), multi.select("native_id", F.col("target").alias("__m"))
    return xrefs.join(o, "native_id", "left").join(m, "native_id", "left").select("native_id", F.coalesce("__m", "__o", "target").alias("target")).distinct()


def unlinked(nodes: DataFrame, linked: DataFrame, keys: tuple[str, ...] = ("native_id",)) -> DataFrame:
    """Nodes whose ``keys`` no link names."""
    return nodes.join(linked.select(*keys).distinct(), list(keys), "left_anti")


def disambiguate(nodes: DataFrame, taken: DataFrame, preference: list[str]) -> DataFrame:
    """``native_id, display_name``: names used twice, or already taken, get `` (SOURCE:id)`` from the preferred id columns."""
    # counted before the joins, and joined hot names apart, so a name may have any number of bearers
    bearers = store(nodes.groupBy("name").agg(F.count(F.lit(1)).alias("__n")), "bearers")
    used = taken.select("name").distinct().withColumn("__used", F.lit(True))
    known = store(bearers.join(used, "name", "left").withColumn("__twice", F.col("__n") > 1).filter("__twice or __used"), "known-names")
    total = bearers.agg(F.sum("__n")).first()[0] or 0
    tag = F.coalesce(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f" ({c.upper()}:"), F.col(c), F.lit(")"))) for c in preference), F.lit(""))
    marked = join_hot(nodes, known, "name", "__n", total, "left")
    return marked.select("native_id", F.when(F.coalesce(F.col("__twice"), F.lit(False)) | F.coalesce(F.col("__used"), F.lit(False)), F.concat("name", tag)).otherwise(F.col("name")).alias("display_name"))


def lookup_table(entities: DataFrame) -> DataFrame:
    """``entity_type, name, entity_ids``: every lower-cased name and synonym with the sorted ids that bear it."""
    names = F.array_union(F.array("common_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    flat = entities.select("entity_type", "entity_id", F.explode(F.transform(names, lambda n: F.lower(n))).alias("name")).filter("name is not null and name <> ''")
    return flat.groupBy("entity_type", "name").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def ambiguous(lut: DataFrame) -> DataFrame:
    return lut.filter(F.size("entity_ids") > 1)


def ambiguous_attestations(attestations: DataFrame) -> DataFrame:
    return attestations.filter((F.size("head_candidates") > 1) | (F.size("tail_candidates") > 1))


def synonym_mentions(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entity_id, common_name``: renamed to the most mentioned synonym, the earliest of equals; unchanged without mentions."""
    counts = mentions.groupBy(F.lower("name").alias("__name")).agg(F.count(F.lit(1)).alias("__n"))
    flat = entities.select("entity_id", "common_name", F.posexplode("synonyms").alias("__pos", "__syn")).withColumn("__name", F.lower("__syn"))
    best = flat.join(counts, "__name").groupBy("entity_id").agg(F.max_by("__syn", F.struct(F.col("__n"), -F.col("__pos"))).alias("__best"))
    return entities.select("entity_id", "common_name").join(best, "entity_id", "left").select("entity_id", F.coalesce("__best", "common_name").alias("common_name"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Keyed upsert: new rows win on ``columns`` only, all other columns keep their first value; the last new row of a key counts."""
    last = first_per(new, [key], order)
    o, n = old.alias("o"), last.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def append_new(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Append rows with unseen ids once; the first by ``order`` of equal ids."""
    return old.unionByName(first_per(new.join(old, key, "left_anti"), [key], order))


def replace_run(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with the keys of ``new`` make way for ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def id_changes(old: DataFrame, new: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``id, status``: new, removed (but for merged ids), or stable."""
    o, n = old.select("id").distinct().withColumn("__o", F.lit(1)), new.select("id").distinct().withColumn("__n", F.lit(1))
    both = o.join(n, "id", "full_outer")
    out = both.select("id", F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").otherwise("stable").alias("status"))
    return out if merged is None else out.join(merged.select("id").withColumn("status", F.lit("removed")), ["id", "status"], "left_anti")


def signal_rows(replies: DataFrame, kind: str, version: str, config: str) -> DataFrame:
    """Validated replies (``attestation_id, score, reason, error_text``) as trust signals."""
    made = replies.withColumns({"signal_kind": F.lit(kind), "version": F.lit(version), "config_hash": F.lit(config)})
    return made.withColumn("signal_id", signal_id(*(F.col(c) for c in ("attestation_id", "signal_kind", "version", "config_hash"))))


# fixed values: the kind and the id map key of the sources that make entities of their own
PRIMARY = {"foodon": "food", "chebi": "chemical", "ctd": "disease"}


def create_primary(registry: DataFrame, nodes: DataFrame, source: str, drop_names: list[str] | None = None) -> DataFrame:
    """``entity_id, entity_type, common_name, scientific_name, synonyms, external_ids`` of one primary source's nodes.

    Nodes have ``native_id, name, synonyms, synonym_types``. A registered native
    id keeps its entity, others get the next ids in order of native id; of nodes
    that share an entity the least native id makes it. Foods and chemicals are
    named by their best synonym, diseases by their name, else their first
    synonym. Synonyms are lower-cased; chemicals lose those in ``drop_names``.
    """
    kind = PRIMARY[source]
    found = register(registry, nodes.withColumn("source", F.lit(source)), ["native_id"])
    one = first_per(found, ["entity_id"], [F.col("native_id")])
    synonyms = F.coalesce("synonyms", F.array().cast("array<string>"))
    lower = F.transform(synonyms, lambda s: F.lower(s))
    if drop_names:
        lower = F.filter(lower, lambda s: ~s.isin(drop_names))
    own = F.lower(F.coalesce(F.when(F.col("name") != "", F.col("name")), F.get(synonyms, 0), F.lit("")))
    name = own if kind == "disease" else pick_common_name(synonyms, F.col("synonym_types"))
    ids = F.create_map(F.lit(source), F.array("native_id"))
    return one.select("entity_id", F.lit(kind).alias("entity_type"), name.alias("common_name"), F.lit("").alias("scientific_name"), lower.alias("synonyms"), ids.alias("external_ids"))


def enrich_seeded(registry: DataFrame, molecules: DataFrame, source: str, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``entity_id, key, value`` ids, ``entity_id, name`` names) that registered molecules (``native_id, name``) add to entities already made.

    Molecules whose registered entity does not exist yet are left for later
    passes.
    """
    known = registry.filter(F.col("source") == source).select("native_id", "entity_id").join(entities.select("entity_id"), "entity_id", "left_semi")
    found = molecules.join(known, "native_id")
    names = found.filter("name <> ''").select("entity_id", F.lower("name").alias("name")).distinct()
    return found.select("entity_id", F.lit(source).alias("key"), F.col("native_id").alias("value")).distinct(), names


@dataclass(frozen=True)
class Ontology:
    """How one ontology's is_a edges become triplets: the id map key of both ends, whether ids are numbers, whether edges within one entity stay."""

    key: str
    numeric: bool = False
    loops: bool = True


# fixed values: the ontologies that bring is_a edges
ONTOLOGIES = {"foodon": Ontology("foodon"), "chebi": Ontology("chebi", numeric=True), "cdno": Ontology("cdno", loops=False), "ctd": Ontology("ctd")}


def ontology_triplets(edges: DataFrame, entities: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, attestations, triplets) of one ontology's is_a edges, both ends found by its native ids; one evidence per source.

    Numeric ids are read as numbers, so leading zeros do not matter; what is no
    number is compared as it stands. An id that several entities bear gives a
    triplet for each. Edges of other types are left out.
    """
    rule = ONTOLOGIES[source]
    ids = explode_ids(entities, rule.key)
    plain = lambda c: F.coalesce(F.col(c).try_cast("bigint").cast("string"), F.col(c)) if rule.numeric else F.col(c)
    isa = edges.filter("edge_type = 'is_a'").withColumns({c: plain(c) for c in ("head_native_id", "tail_native_id")})
    rows = resolve_edges(isa, ids, ids, rule.loops)
    return attest(rows, source, F.to_json(F.struct(F.lit(source).alias("source"), F.col("edge_type"))), F.lit("r2"))


def entity_views(entities: DataFrame, triplets: DataFrame, attestations: DataFrame) -> DataFrame:
    """Entities with a page: ``entity_id, entity_type, common_name, groups, flavors, siblings``.

    Foods need a composition triplet (r1); chemicals one, a correlation (r3, r4),
    or a place above a correlated chemical in the is_a edges (r2) of chemicals;
    diseases a correlation. ``siblings`` are entities that some attestation holds
    as further candidates, sorted.
    """
    from .graph import ancestors_of_set, siblings

    ids = lambda rels, end: triplets.filter(F.col("relationship_id").isin(*rels)).select(F.col(end).alias("entity_id"))
    chemicals = entities.filter("entity_type = 'chemical'").select("entity_id")
    inside = lambda df, end: df.join(chemicals.select(F.col("entity_id").alias(end)), end, "left_semi")
    isa = inside(inside(triplets.filter("relationship_id = 'r2'").select(F.col("head_id").alias("head"), F.col("tail_id").alias("tail")), "head"), "tail")
    correlated = ids(("r3", "r4"), "head_id").distinct()
    above = ancestors_of_set(isa, correlated.withColumnRenamed("entity_id", "node")).withColumnRenamed("node", "entity_id")
    paged = [
        ids(("r1",), "head_id").withColumn("entity_type", F.lit("food")),
        ids(("r1",), "tail_id").unionByName(correlated).unionByName(above).withColumn("entity_type", F.lit("chemical")),
        ids(("r3", "r4"), "tail_id").withColumn("entity_type", F.lit("disease")),
    ]
    shown = entities.join(reduce(DataFrame.unionByName, paged).distinct(), ["entity_id", "entity_type"], "left_semi")
    lists = attestations.select(F.col("head_candidates").alias("ids")).unionByName(attestations.select(F.col("tail_candidates").alias("ids")))
    none = F.array().cast("array<string>")
    made = shown.join(siblings(lists).withColumnRenamed("node", "entity_id"), "entity_id", "left")
    return made.select("entity_id", "entity_type", "common_name", F.coalesce("attributes.groups", none).alias("groups"), F.coalesce("attributes.flavors", none).alias("flavors"), F.coalesce("siblings", none).alias("siblings"))


def merge_attributes(entities: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Entities whose typed ``attributes`` take ``values`` (``entity_id`` and an array of the field's name) in one field; missing attributes are empty ones, other fields stay."""
    none = F.array().cast("array<string>")
    new = values.select("entity_id", F.col(field).alias("__new"))
    joined = entities.join(new, "entity_id", "left")
    old = lambda f: F.coalesce(F.col(f"attributes.{f}"), none)
    filled = {f: F.coalesce("__new", old(f)) if f == field else old(f) for f in ("groups", "flavors")}
    return joined.withColumn("attributes", F.struct(*(c.alias(f) for f, c in filled.items()))).drop("__new")


def citation_summary(citations: DataFrame, by: str, score: str = "score") -> DataFrame:
    """``by``, ``greatest, mean, spread``: the greatest score of a key's citations, their mean, and the deviation from the rounded mean; three decimals."""
    means = citations.groupBy(by).agg(F.max(score).alias("greatest"), F.avg(score).alias("mean"), F.avg(F.col(score) * F.col(score)).alias("square"))
    mean = F.round("mean", 3)
    around = F.greatest(F.col("square") - 2 * mean * F.col("mean") + mean * mean, F.lit(0.0))
    return means.select(by, F.round("greatest", 3).alias("greatest"), mean.alias("mean"), F.round(F.sqrt(around), 3).alias("spread"))
