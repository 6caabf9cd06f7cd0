"""A document pipeline of five operators, each stage written as Parquet before the next reads it.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import decontam, feistel, mixing, simhash, toxicity
from graphmill.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not scored toxic. Each row by its own text: nulls count as empty, repeated rows and rows without an id
    share their text's fate, an empty table stays empty, further columns may have any name."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id; null and empty texts are alike, repeated rows
    are reduced to one, unrelated texts under one id all stay, an empty table stays empty, further columns may have any name."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Each row by its own text: null and empty texts stay, repeated rows share
    their fate, an empty table stays empty, further columns may have any name."""
    return decontam.keep_uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts stay once, rows that share an id are repeated alike,
    a null source is one of its own and sorts last, an empty table stays empty, further columns may have any name."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard`` and ``slot``, which replace columns of these names. Null ids sort last, repeated rows get
    slots each, rows of one id are interchangeable, an empty table stays empty."""
    return feistel.shard_rows(docs, 16, ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The label model, SimHash and the shuffled schedule have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
