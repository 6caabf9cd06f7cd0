"""Links between sources: number suffixes, term names, flavors, and the three-pass resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import chebi_number
from .build import assign_ids, highest_id, lookup_table, unlinked


def link_chebi(xrefs: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """``entity_id, key, value``: xrefs (``native_id, target_id``) whose target ends in a registered number."""
    numbered = xrefs.withColumn("n", chebi_number(F.col("target_id")).cast("string"))
    r = registry.select(F.col("native_id").alias("n"), "entity_id")
    return numbered.join(r, "n").select("entity_id", F.lit(key).alias("key"), F.col("native_id").alias("value")).distinct()


def link_two_hops(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``entity_id, key, value``: ``native_id -> middle`` and ``middle -> entity_id`` joined."""
    return first.join(second, "middle").select("entity_id", F.lit(key).alias("key"), F.col("native_id").alias("value")).distinct()


def link_mesh(terms: DataFrame, mesh: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_id, key, value``: compound -> term name (lower case) -> MeSH id, given to the compound's entity."""
    t = terms.select("compound", F.lower(F.trim("term")).alias("term"))
    m = mesh.select(F.lower(F.trim("term")).alias("term"), "mesh_id")
    e = entities.select(F.col("native_id").alias("compound"), "entity_id")
    return t.join(m, "term").join(e, "compound").select("entity_id", F.lit("mesh").alias("key"), F.col("mesh_id").alias("value")).distinct()


def one_entity_per_id(entities: DataFrame, order: str) -> DataFrame:
    """``native_id, entity_id``: where several entities bear an id the last by ``order`` counts."""
    return entities.groupBy("native_id").agg(F.max_by("entity_id", order).alias("entity_id"))


def flavor_descriptions(entities: DataFrame, flavors: DataFrame) -> DataFrame:
    """``entity_id, flavors``: descriptors of each entity's first compound; the last entity of a compound takes them."""
    first = entities.select("entity_id", F.get("compounds", 0).alias("compound"), "order").filter("compound is not null")
    owner = first.groupBy("compound").agg(F.max_by("entity_id", "order").alias("entity_id"))
    return flavors.join(owner, "compound").groupBy("entity_id").agg(F.array_sort(F.collect_set("flavor")).alias("flavors"))


def resolve_all(primary: DataFrame, linked: DataFrame, secondary: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, registry, lookup table): primary records, links of secondary ones, new entities for the rest.

    ``primary`` and ``secondary`` have ``source, native_id, entity_type,
    common_name, synonyms``; ``linked`` maps secondary ids (``source, native_id``) to ``primary_id``, so
    equal native ids of two sources keep links of their own.
    """
    from .build import register, register_alias

    one = register(registry, primary, ["source", "native_id"])
    reg = register_alias(registry, one.select("source", "native_id", "entity_id"))
    by_primary = linked.join(one.select(F.col("native_id").alias("primary_id"), "entity_id"), "primary_id")
    alias = secondary.join(by_primary, ["source", "native_id"]).select("source", "native_id", "entity_id")
    reg = register_alias(reg, alias)
    rest = unlinked(secondary, alias, ("source", "native_id")).join(reg, ["source", "native_id"], "left_anti")
    new = assign_ids(rest, ["source", "native_id"], highest_id(reg))
    reg = register_alias(reg, new.select("source", "native_id", "entity_id"))
    entities = one.select("entity_id", "entity_type", "common_name", "synonyms").unionByName(new.select("entity_id", "entity_type", "common_name", "synonyms")).dropDuplicates(["entity_id"])
    return entities, reg, lookup_table(entities)
