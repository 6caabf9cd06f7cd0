"""Key filters beside large files: which files can hold a key, without opening them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap, as Spark's bitmap functions have them; a filter has ``BITMAPS`` of these.
BITS = 32768
BITMAPS = 8
HASHES = 4
FILTER = "file string, bucket long, bits binary, least string, most string"


def _places(key: Column, bitmaps: int) -> Column:
    """Bits, from 1, that stand for a key."""
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITS * bitmaps)) + 1 for seed in range(HASHES)))


def filter_of(rows: DataFrame, key: str, bitmaps: int = BITMAPS) -> DataFrame:
    """The filter of ``rows``, as read from files: a Bloom filter, least and greatest key of each file.

    Bits are set by partial aggregation, so a file's keys are never gathered; a
    file takes up to ``bitmaps`` times 4 KB. Null keys are not entered.
    """
    marked = rows.select(F.col("_metadata.file_path").alias("file"), F.col(key).cast("string").alias("k")).filter("k is not null")
    # least and greatest texts alone would be found by sorting all rows; beside a collecting aggregate they are kept per file
    ends = marked.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.collect_set(F.lit(1)).alias("__kept")).filter(F.size("__kept") > 0).drop("__kept")
    # places are made distinct first, by hashing: at most all bits of a file are left to be sorted into bitmaps
    bits = marked.select("file", F.explode(_places(F.col("k"), bitmaps)).alias("at")).distinct()
    maps = bits.groupBy("file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return maps.join(ends, "file").select("file", "bucket", "bits", "least", "most")


def build_filter(rows: DataFrame, key: str, path: str, bitmaps: int = BITMAPS) -> None:
    """Write the filter of ``rows`` to ``path``."""
    filter_of(rows, key, bitmaps).write.parquet(path)


def candidate_files(spark: SparkSession, path: str, keys: DataFrame, key: str, bitmaps: int = BITMAPS) -> list[str]:
    """The files that may hold any of ``keys``: all that do, and one in thousands of the others while filters are not full."""
    asked = keys.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct()
    places = asked.select("k", F.explode(_places(F.col("k"), bitmaps)).alias("at")).select("k", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    hits = spark.read.schema(FILTER).parquet(path).join(places, "bucket").filter(F.col("k").between(F.col("least"), F.col("most")) & is_set)
    full = hits.groupBy("file", "k").agg(F.count_distinct("bucket", "bit").alias("n"))
    need = places.groupBy("k").agg(F.count_distinct("bucket", "bit").alias("need"))
    return sorted(r.file for r in full.join(need, "k").filter("n = need").select("file").distinct().collect())  # names of files
