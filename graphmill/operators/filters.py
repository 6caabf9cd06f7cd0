"""Domain filters of the ingested ontologies. Edges are ``head`` (child) and ``tail`` (parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach


def _root(df: DataFrame, *roots: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(r,) for r in roots], "node string")


def food_domain(edges: DataFrame, food_root: str, organism_root: str) -> tuple[DataFrame, DataFrame]:
    """(``node, is_food, is_organism``; edges with either end kept)."""
    food = reach(edges, _root(edges, food_root)).withColumn("is_food", F.lit(True))
    organism = reach(edges, _root(edges, organism_root)).withColumn("is_organism", F.lit(True))
    nodes = food.join(organism, "node", "full_outer").select("node", F.coalesce("is_food", F.lit(False)).alias("is_food"), F.coalesce("is_organism", F.lit(False)).alias("is_organism"))
    ids = nodes.select(F.col("node").alias("__n"))
    by_head = edges.join(ids, F.col("head") == F.col("__n"), "left_semi")
    by_tail = edges.join(ids, F.col("tail") == F.col("__n"), "left_semi")
    return nodes, by_head.unionByName(by_tail).distinct()


def below(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Nodes (``node``) at or below a root; edges are left as they are."""
    return nodes.join(reach(edges, _root(edges, root)), "node", "left_semi")


def direct_evidence(edges: DataFrame) -> DataFrame:
    """Without associations that lack direct evidence; other edge types stay."""
    return edges.filter((F.col("edge_type") != "chemical_disease_association") | (F.coalesce("direct_evidence", F.lit("")) != ""))


def nutrient_domain(edges: DataFrame, with_xref: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes with a food-table xref or below a listed root; edges with both ends kept)."""
    nodes = with_xref.select("node").union(reach(edges, _root(edges, *roots))).distinct()
    inside = edges.join(nodes.withColumnRenamed("node", "head"), "head", "left_semi").join(nodes.withColumnRenamed("node", "tail"), "tail", "left_semi")
    return nodes, inside.select("head", "tail")


def chemical_branch(df: DataFrame, column: str = "tree_numbers", prefix: str = "D") -> DataFrame:
    """Only tree numbers of one branch; rows left without any go."""
    return df.withColumn(column, F.filter(column, lambda t: F.startswith(t, F.lit(prefix)))).filter(F.size(column) > 0)


def tree_levels(descriptors: DataFrame, mapped: DataFrame, names: DataFrame) -> DataFrame:
    """``id, labels``: names of the first two tree levels over all descriptors an entity maps to.

    ``descriptors`` has ``descriptor, tree_numbers``, ``mapped`` ``id,
    descriptor``, ``names`` ``tree_number, name``.
    """
    flat = mapped.join(chemical_branch(descriptors), "descriptor").select("id", F.explode("tree_numbers").alias("t"))
    parts = F.split("t", r"\.")
    levels = flat.select("id", F.explode(F.array_distinct(F.array(F.get(parts, 0), F.concat_ws(".", F.slice(parts, 1, 2))))).alias("tree_number"))
    return levels.join(names, "tree_number").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("labels"))
