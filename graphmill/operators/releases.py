"""Differences between releases, found by digests: only buckets that differ are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

BUCKETS = 1024
#: Buckets under one digest of the upper level.
GROUP = 32
DIGESTS = "grp int, bucket int, n long, digest string"


def _row_hash(columns: list[str], seed: int) -> Column:
    return F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).cast("string")


def write_release(rows: DataFrame, keys: list[str], root: str, buckets: int = BUCKETS, note: str = "") -> versions.Snapshot:
    """A release as the next version below ``root``: rows dealt into buckets by key, and two levels of digests.

    A bucket's digest counts its rows and adds up two 64-bit hashes of each, so
    it does not depend on their order; the upper level hashes the digests of
    ``GROUP`` buckets. Columns are hashed in the order given.
    """
    spark, columns = rows.sparkSession, rows.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    marked = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", _row_hash(columns, 1), _row_hash(columns, 2)).alias("digest"))
    lower = marked.select(F.floor(F.col("bucket") / GROUP).cast("int").alias("grp"), "bucket", "n", "digest")

    def write(base: versions.Snapshot) -> dict[str, dict[str, str]]:
        below = versions.write_parts(lower, root, F.col("grp").cast("string"))
        stored = versions.read_folders(spark, root, below, DIGESTS)
        line = F.concat_ws(" ", F.col("bucket").cast("string"), F.col("n").cast("string"), "digest")
        upper = stored.groupBy("grp").agg(F.lit(None).cast("int").alias("bucket"), F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
        return {"rows": versions.write_parts(rows, root, bucket.cast("string")), "lower": below, "upper": versions.write_parts(upper.select("grp", "bucket", "n", "digest"), root)}

    return versions.update(spark, root, write, replace=True, note=note)


def differing_buckets(spark: SparkSession, root: str, old: versions.Snapshot, new: versions.Snapshot) -> list[str]:
    """The buckets whose digests differ. The driver receives them and the upper level: as many rows as there are buckets at most."""

    def changed(table: str, key: str, parts: list[str] | None) -> list[str]:
        a, b = (versions.read(spark, root, table, DIGESTS, s, parts).select(F.col(key).alias("k"), F.concat_ws(" ", F.col("n").cast("string"), "digest").alias("d")) for s in (old, new))
        both = a.withColumnRenamed("d", "a").join(b.withColumnRenamed("d", "b"), "k", "full_outer")
        return [str(r.k) for r in both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("k").collect()]

    groups = changed("upper", "grp", None)
    return changed("lower", "bucket", groups) if groups else []


def diff_releases(spark: SparkSession, root: str, keys: list[str], schema: str, old: versions.Snapshot, new: versions.Snapshot) -> DataFrame:
    """``keys`` and ``status`` of every key whose row is ``new``, ``removed`` or ``changed``; unchanged keys are not listed.

    Keys are unique within a release; null-safe, so a null key is a key. Releases
    must have been written with the same number of buckets.
    """
    buckets = differing_buckets(spark, root, old, new)
    columns = spark.createDataFrame([], schema).columns
    mark = lambda s, name: versions.read(spark, root, "rows", schema, s, buckets).select(*keys, F.struct(*columns).alias(name))
    a, b = mark(old, "__a").alias("l"), mark(new, "__b").alias("r")
    on = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = same if on is None else on & same
    both = a.join(b, on, "full_outer")
    status = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    named = [F.when(F.col("__a").isNull(), F.col(f"r.{k}")).otherwise(F.col(f"l.{k}")).alias(k) for k in keys]
    return both.select(*named, status.alias("status")).filter("status is not null")
