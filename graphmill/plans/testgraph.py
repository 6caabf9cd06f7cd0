"""The driver's tables in graph roles, for Spark and as SQL of the same meaning.

Suppliers are foods, parts and brands chemicals, nations diseases, line items
attestations, orders evidence, events trust signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(flag: str = "l_returnflag"):
    return F.when(F.col(flag) == "A", "fdc").when(F.col(flag) == "R", "dmd").otherwise("lit")


def claims(spark: SparkSession, d: str, by_subject: DataFrame | None = None) -> DataFrame:
    """``food, chem, part, source, attestation_id, premise, reference, conc, unit, subject, status``.

    The columns of ``by_subject``, one row per ``subject``, come after these
    where given; they meet the orders, which are fewer than the claims.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    more = [c for c in by_subject.columns if c != "subject"] if by_subject is not None else []
    if by_subject is not None:
        o = o.join(by_subject, F.col("o_custkey") == F.col("subject"), "left").drop("subject")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.concat(F.lit("s"), "l_suppkey").alias("food"),
        F.col("p_brand").alias("chem"),
        F.concat(F.lit("p"), "l_partkey").alias("part"),
        source_of().alias("source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("attestation_id"),
        F.col("o_orderpriority").alias("premise"),
        F.concat(F.lit("o"), "l_orderkey").alias("reference"),
        F.col("l_quantity").alias("conc"),
        F.when(F.col("l_linestatus") == "F", "mg/100g").otherwise("g/100g").alias("unit"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderstatus").alias("status"),
        *more,
    )


CLAIMS = """claims AS (
  SELECT 's' || l_suppkey AS food, p_brand AS chem, 'p' || l_partkey AS part,
    CASE l_returnflag WHEN 'A' THEN 'fdc' WHEN 'R' THEN 'dmd' ELSE 'lit' END AS source,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS attestation_id,
    o_orderpriority AS premise, 'o' || l_orderkey AS reference, l_quantity AS conc,
    CASE WHEN l_linestatus = 'F' THEN 'mg/100g' ELSE 'g/100g' END AS unit, o_custkey AS subject, o_orderstatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Trust signals: ``signal_id, subject, signal_kind, score, created_at``; refunds of a kind stand for errors."""
    e = table(spark, d, "events")
    score = F.when(F.pmod("event_id", F.lit(17)) == 0, F.lit(-1.0)).otherwise(F.col("value") / 500)
    return e.select(F.col("event_id").alias("signal_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("signal_kind"), score.alias("score"), F.col("ts").alias("created_at"))


SIGNALS = """signals AS (
  SELECT event_id AS signal_id, user_id AS subject, event_type AS signal_kind,
    CASE WHEN event_id % 17 = 0 THEN -1.0 ELSE value / 500 END AS score, ts AS created_at FROM events)"""
SCORES = """scores AS (
  SELECT subject, score FROM signals WHERE signal_kind = 'view' AND score >= 0
  QUALIFY row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, signal_id DESC) = 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """is_a edges: parts to brand and type, those to ``chem``; suppliers to nation, region, ``world``."""
    s = lambda x: F.col(x).cast("string")
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    brand, kind = F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("t:"), "p_type")
    pieces = [
        part.select(F.concat(F.lit("p"), s("p_partkey")).alias("head"), brand.alias("tail")),
        part.select(F.concat(F.lit("p"), s("p_partkey")).alias("head"), kind.alias("tail")),
        part.select(brand.alias("head"), F.lit("chem").alias("tail")),
        part.select(kind.alias("head"), F.lit("chem").alias("tail")),
        supplier.select(F.concat(F.lit("s"), s("s_suppkey")).alias("head"), F.concat(F.lit("n"), s("s_nationkey")).alias("tail")),
        table(spark, d, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("head"), F.concat(F.lit("r"), s("n_regionkey")).alias("tail")),
        table(spark, d, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("head"), F.lit("world").alias("tail")),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.distinct()


EDGES = """edges AS (
  SELECT 'p' || p_partkey AS head, 'b:' || p_brand AS tail FROM part UNION SELECT 'p' || p_partkey, 't:' || p_type FROM part
  UNION SELECT 'b:' || p_brand, 'chem' FROM part UNION SELECT 't:' || p_type, 'chem' FROM part
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'r' || r_regionkey, 'world' FROM region)"""
CLOSURE = """closure(node, anc) AS (
  SELECT head, tail FROM edges UNION SELECT c.node, e.tail FROM closure c JOIN edges e ON e.head = c.anc)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Foods, chemicals and diseases with names, synonyms and id maps."""
    empty = F.array().cast("array<string>")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("food").alias("entity_type"), F.lower("s_name").alias("common_name"), F.array(F.lower("s_name"), F.concat(F.lit("food "), "s_suppkey")).alias("synonyms"), F.create_map(F.lit("fdc"), F.array(F.col("s_suppkey").cast("string"))).alias("external_ids"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.lit("chemical").alias("entity_type"), F.col("p_name").alias("common_name"), F.array("p_name", F.lower("p_type")).alias("synonyms"), F.create_map(F.lit("chebi"), F.array(F.col("p_partkey").cast("string")), F.lit("foodon"), F.array(F.concat(F.lit("http://x.org/"), "p_size"))).alias("external_ids"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.lit("disease").alias("entity_type"), F.lower("n_name").alias("common_name"), empty.alias("synonyms"), F.create_map(F.lit("ctd"), F.array(F.concat(F.lit("D"), "n_nationkey"))).alias("external_ids"))
    return s.unionByName(p).unionByName(n).withColumn("scientific_name", F.lit(""))


ENTITIES = """entities AS (
  SELECT 's' || s_suppkey AS entity_id, 'food' AS entity_type, lower(s_name) AS common_name, [lower(s_name), 'food ' || s_suppkey] AS synonyms, [s_suppkey::VARCHAR] AS ids FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'chemical', p_name, [p_name, lower(p_type)], [p_partkey::VARCHAR, 'http://x.org/' || p_size] FROM part
  UNION ALL SELECT 'n' || n_nationkey, 'disease', lower(n_name), [], ['D' || n_nationkey] FROM nation)"""


def correlations(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """Direct correlations: ``chem`` (part), ``disease`` (the customer's nation), ``rel`` by order status, with evidence."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.concat(F.lit("n"), "c_nationkey").alias("disease"))
    rel = F.when(F.col("status") == "F", "r3").when(F.col("status") == "O", "r4")
    return (known if known is not None else claims(spark, d)).join(c, "subject").withColumn("rel", rel).filter("rel is not null").select(F.col("part").alias("chem"), "disease", "rel", "source", "reference")


CORRELATIONS = """direct AS (
  SELECT part AS chem, 'n' || c_nationkey AS disease, CASE status WHEN 'F' THEN 'r3' ELSE 'r4' END AS rel, source, reference
  FROM claims JOIN customer ON subject = c_custkey WHERE status IN ('F', 'O'))"""
