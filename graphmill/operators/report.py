"""Reports and checks over releases and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """Entities in no triplet."""
    used = triplets.select(F.col("head_id").alias("entity_id")).union(triplets.select("tail_id")).distinct()
    return entities.join(used, "entity_id", "left_anti")


def attestations_per_entity(triplets: DataFrame) -> DataFrame:
    """``entity_id, n_att``: attestations over both roles."""
    n = F.size("attestation_ids").alias("n")
    both = triplets.select(F.col("head_id").alias("entity_id"), n).unionByName(triplets.select(F.col("tail_id").alias("entity_id"), n))
    return both.groupBy("entity_id").agg(F.sum("n").alias("n_att"))


def unclassified(entities: DataFrame, parents: DataFrame, triplets: DataFrame) -> DataFrame:
    """Entities without a parent edge (``head``), most attested first."""
    alone = entities.join(parents.select(F.col("head").alias("entity_id")).distinct(), "entity_id", "left_anti")
    return alone.join(attestations_per_entity(triplets), "entity_id", "left").withColumn("n_att", F.coalesce("n_att", F.lit(0))).orderBy(F.desc("n_att"), "entity_id")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of both releases whose name or type differs, null-safe."""
    o, n = old.select("id", F.col("name").alias("old_name"), F.col("type").alias("old_type")), new.select("id", F.col("name").alias("new_name"), F.col("type").alias("new_type"))
    return o.join(n, "id").filter(~F.col("old_name").eqNullSafe(F.col("new_name")) | ~F.col("old_type").eqNullSafe(F.col("new_type"))).select("id", "old_name", "new_name", "old_type", "new_type")


def release_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``section, key, old_n, new_n, delta`` for types, ids and changed fields of two releases (``id, type, name``)."""
    from .build import id_changes

    count = lambda df, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    types = count(old, "type").withColumnRenamed("n", "old_n").join(count(new, "type").withColumnRenamed("n", "new_n"), "key", "full_outer").select(F.lit("type").alias("section"), "key", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))
    s = F.col("status")
    ids = id_changes(old, new).groupBy(s.alias("key")).agg(F.count_if(s != "new").alias("old_n"), F.count_if(s != "removed").alias("new_n")).select(F.lit("ids").alias("section"), "key", "old_n", "new_n")
    both = changed(old, new).agg(F.count_if(~F.col("old_name").eqNullSafe(F.col("new_name"))).alias("name"), F.count_if(~F.col("old_type").eqNullSafe(F.col("new_type"))).alias("type"))
    fields = both.select(F.explode(F.map_entries(F.create_map(F.lit("name"), F.col("name"), F.lit("type"), F.col("type")))).alias("e")).select(F.lit("changed").alias("section"), "e.key", F.col("e.value").alias("old_n"), F.col("e.value").alias("new_n"))
    return types.unionByName(ids).unionByName(fields).withColumn("delta", F.col("new_n") - F.col("old_n"))


def validate(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """``problem, found``: stages that produced nothing."""
    zero = lambda df, what: df.limit(1).agg((F.count(F.lit(1)) == 0).alias("found")).select(F.lit(what).alias("problem"), "found")
    return zero(entities, "zero entities").unionByName(zero(triplets, "zero triplets"))
