"""Graph tables, literature files, exports and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTESTATIONS, ENTITIES, EVIDENCE, RAW_CLAIMS, TRIPLETS, TRUST_SIGNALS, conform, empty, fill_defaults

_JSON = {"synonyms": "array<string>", "attestation_ids": "array<string>", "external_ids": "map<string,array<string>>", "head_candidates": "array<string>", "tail_candidates": "array<string>", "attributes": "struct<groups:array<string>,flavors:array<string>>"}


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """JSON text columns as arrays, maps and structs; what is no JSON of the kind becomes empty."""
    kinds = dict(df.dtypes)
    made = {c: F.from_json(F.col(c), k) for c, k in _JSON.items() if kinds.get(c) == "string"}
    return fill_defaults(conform(df.withColumns(made) if made else df, schema))


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """entities, triplets, evidence, attestations and, where present, trust_signals."""
    read = lambda name: spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}.parquet")
    out = {n: _parsed(read(n), s) for n, s in (("entities", ENTITIES), ("triplets", TRIPLETS), ("evidence", EVIDENCE), ("attestations", ATTESTATIONS))}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/trust_signals.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    out["trust_signals"] = conform(read("trust_signals"), TRUST_SIGNALS) if there else empty(spark, TRUST_SIGNALS)
    return out


def overwrite(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replace a serving table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def read_raw_claims(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Raw extraction rows from ``json``, ``tsv`` or ``parquet``; a missing column is an error, extra ones are dropped."""
    reader = spark.read
    df = reader.json(path) if form == "json" else reader.option("sep", "\t").option("header", True).csv(path) if form == "tsv" else reader.parquet(path)
    wanted = [c.split()[0] for c in RAW_CLAIMS.split(", ")]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return conform(df, RAW_CLAIMS)


def read_runs(spark: SparkSession, pattern: str, info: str) -> DataFrame:
    """Raw claims of all run folders with ``run`` and ``method`` (from the run's info file, else the folder's name)."""
    rows = spark.read.schema(RAW_CLAIMS).json(pattern).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    known = spark.read.schema("method string").json(info).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.join(known, "run", "left").withColumn("method", F.coalesce("method", "run"))


BATCH_RESULT = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"


def join_batch_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Input rows (``custom_id``) with the content of their response, empty where it is missing, in order of the number in the id."""
    content = F.get("response.body.choices", 0)["message"]["content"]
    got = results.groupBy("custom_id").agg(F.min(content).alias("response"))
    number = F.regexp_extract("custom_id", r"(\d+)$", 1).try_cast("bigint")
    return rows.join(got, "custom_id", "left").withColumn("response", F.coalesce("response", F.lit(""))).orderBy(number.asc_nulls_last(), "custom_id")


ARTICLES = "documents array<struct<id:string,passages:array<struct<text:string,infons:struct<section_type:string,type:string>>>>>"


def read_articles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Article JSON, one article per file or, with ``lines``, per line."""
    return spark.read.schema(ARTICLES).option("multiLine", not lines).json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, pmcid`` pairs of an id map with a header."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("PMID").alias("pmid"), F.col("PMCID").alias("pmcid"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term, translations``: one term per line, its translations after a tab and separated by pipes."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim(F.get(parts, 0)).alias("term"), F.filter(F.split(F.coalesce(F.get(parts, 1), F.lit("")), r"\|"), lambda t: t != "").alias("translations"))


def split_terms(df: DataFrame, column: str) -> DataFrame:
    """``term``: the terms of comma lists, or single terms, trimmed; blank ones go."""
    return df.select(F.explode(F.split(F.col(column), ",")).alias("t")).select(F.trim("t").alias("term")).filter("term <> ''")


def write_diagnostics(df: DataFrame, path: str, form: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("sep", "\t").option("header", True).csv(path)


def write_export(df: DataFrame, path: str) -> None:
    """``;``-separated text; nested cells as JSON, quotes doubled."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(path)


def publish(manifest: DataFrame, version: str, date: str, files: list[str]) -> DataFrame:
    """The release manifest (``version, date, file``) with one version replaced, newest first."""
    spark = manifest.sparkSession
    new = spark.createDataFrame([(version, date, f) for f in files], "version string, date string, file string")
    return manifest.join(new.select("version").distinct(), "version", "left_anti").unionByName(new).orderBy(F.desc("date"), F.desc("version"), "file")
