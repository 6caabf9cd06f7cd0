"""Table schemas. Every reader gives its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "source_id string, native_id string, name string, synonyms array<string>, synonym_types array<string>, node_type string, raw_attrs string"
EDGES = "source_id string, head_native_id string, tail_native_id string, edge_type string, raw_attrs string"
XREFS = "source_id string, native_id string, target_source string, target_id string"
ENTITIES = "entity_id string, entity_type string, common_name string, scientific_name string, synonyms array<string>, external_ids map<string,array<string>>, attributes struct<groups:array<string>,flavors:array<string>>"
TRIPLETS = "head_id string, relationship_id string, tail_id string, source string, attestation_ids array<string>"
EVIDENCE = "evidence_id string, source_type string, reference string"
ATTESTATIONS = (
    "attestation_id string, evidence_id string, source string, head_name_raw string, tail_name_raw string, "
    "conc_value double, conc_unit string, conc_value_raw string, conc_unit_raw string, food_part string, "
    "food_processing string, filter_score double, validated boolean, validated_correct boolean, "
    "head_candidates array<string>, tail_candidates array<string>"
)
TRUST_SIGNALS = "signal_id string, attestation_id string, signal_kind string, version string, config_hash string, model string, score double, reason string, error_text string, created_at timestamp"
REGISTRY = "source string, native_id string, entity_id string"
LUT = "entity_type string, name string, entity_ids array<string>"
RAW_CLAIMS = "pmcid string, section string, matched_query string, sentence string, prob double, response string"

RELATIONSHIPS = (("r1", "contains"), ("r2", "is_a"), ("r3", "positively_correlates_with"), ("r4", "negatively_correlates_with"))


def relationships(spark: SparkSession) -> DataFrame:
    """The four relations, id and name."""
    return spark.createDataFrame(list(RELATIONSHIPS), "relationship_id string, name string")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones null, others dropped."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def attrs_json(**columns: Column) -> Column:
    """Attributes as one JSON string; null members are left out, as ``to_json`` does."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items()))) if columns else F.lit("{}")


def attr(name: str, column: str = "raw_attrs") -> Column:
    return F.get_json_object(F.col(column), f"$.{name}")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Null text becomes ``""``, null lists ``[]``, ``validated`` false, ``validated_correct`` true."""
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if f.name in ("validated", "validated_correct"):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(f.name == "validated_correct"))
        elif kind == "string":
            out[f.name] = F.coalesce(F.col(f.name), F.lit(""))
        elif kind.startswith("array"):
            out[f.name] = F.coalesce(F.col(f.name), F.array().cast(kind))
        elif kind.startswith("map"):
            out[f.name] = F.coalesce(F.col(f.name), F.create_map().cast(kind))
    return df.withColumns(out)
