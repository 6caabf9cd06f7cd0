"""Pages of a stored order, however deep, without gathering the pages before."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from ..sources import versions

#: Rows of a part, about; a page reads the parts it lies in.
PART_ROWS = 1_000_000
#: Ranges sorted by one task each; small parts are cut from them, so the driver's samples follow the ranges and not the parts.
RANGES, RANGE_ROWS = 200, 1_000_000


def build_order(rows: DataFrame, order: list[Column], root: str, part_rows: int = PART_ROWS) -> versions.Snapshot:
    """Store ``rows`` by ``order`` in parts of at most ``part_rows``, and how many rows each part holds.

    A task sorts a range and cuts it into parts, each named by the place of its
    first row. ``order`` should be total; rows equal in all of it keep one order
    once stored. An empty table gives an order without rows.
    """
    spark, n = rows.sparkSession, rows.count()
    ranges = min(-(-n // part_rows), max(RANGES, -(-n // RANGE_ROWS)))
    ranged = rows.repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order)
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) % part_rows
    placed = ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__row", place)
    placed = placed.withColumn("__range", F.col("__at") - F.col("__row")).drop("__at")

    def write(base: versions.Snapshot) -> dict[str, dict[str, str]]:
        parts = versions.write_sorted(placed, root, "__range")
        stored = versions.read_folders(spark, root, parts, _schema(rows.schema))
        counts = stored.groupBy(F.col("__part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        return {"rows": parts, "counts": versions.write_parts(counts.coalesce(1), root)}

    return versions.update(spark, root, write, replace=True)


def _schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("__row", LongType())])


class Order:
    """A stored order, opened: the places where its parts begin, one figure per part."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, seen: versions.Snapshot | None = None):
        self.spark, self.root, self.schema = spark, root, schema
        self.seen = seen or versions.snapshot(spark, root)
        counts = versions.read(spark, root, "counts", "part long, n long", self.seen).orderBy("part").collect()
        self.parts, self.starts, self.total = [], [], 0
        for r in counts:
            self.parts.append(str(r.part))
            self.starts.append(self.total)
            self.total += r.n

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1): the rows and their ``rank`` over all pages; empty beyond the last."""
        first, last = (number - 1) * size, min(number * size, self.total) - 1
        out = None
        if first <= last:
            for k in range(bisect_right(self.starts, first) - 1, bisect_right(self.starts, last)):
                start = self.starts[k]
                rows = versions.read(self.spark, self.root, "rows", _schema(self.schema), self.seen, [self.parts[k]])
                rows = rows.filter(F.col("__row").between(first - start, last - start)).withColumn("rank", F.col("__row") + start + 1).drop("__row")
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("rank", LongType())]))
