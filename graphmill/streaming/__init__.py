"""Late scores as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import upsert
from ..schemas import TRUST_SIGNALS
from ..sources import versions

UPDATED = ["score", "reason", "error_text", "model", "created_at"]


def merge_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins per signal id; only score, texts, model and time change."""
    return upsert(old, new, "signal_id", UPDATED, [F.col("created_at").desc_nulls_last(), F.col("score").desc_nulls_last()])


#: The table is kept in so many parts by signal id; a micro-batch rewrites those it touches.
PARTS = 64
TABLE = "signals"


def read_signals(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The newest version, or an older one, of a table that ``upsert_stream`` keeps; empty before the first batch."""
    return versions.read(spark, table, TABLE, TRUST_SIGNALS, versions.snapshot(spark, table, version))


def upsert_stream(spark: SparkSession, source: str, table: str, checkpoint: str, parts: int = PARTS):
    """A file stream of score rows upserted into ``table``; returns the started query.

    The table is dealt into ``parts`` by signal id. A micro-batch writes the
    parts it touches, merged with their newest versions, to a folder of its own,
    then commits them as one version (``sources.versions``). A batch killed at
    any step leaves the newest version as it was and is run again; merging the
    same rows once more changes nothing. Batch numbers are not used, so a lost
    checkpoint loses no scores, and a second query on the same table merges onto
    the version of the first. A batch reads one manifest, however many versions
    there were.
    """
    stream = spark.readStream.schema(TRUST_SIGNALS).parquet(source)
    part = F.pmod(F.xxhash64("signal_id"), F.lit(parts)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        touched = [str(r[0]) for r in batch.select(part.alias("part")).distinct().collect()]  # ``parts`` at most

        def merged(base: versions.Snapshot) -> dict[str, dict[str, str]]:
            if not touched:
                return {}
            old = versions.read(session, table, TABLE, TRUST_SIGNALS, base, touched)
            return {TABLE: versions.write_parts(merge_signals(old, batch), table, part)}

        versions.update(session, table, merged, note=f"batch {number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
