"""Exact medians of groups of any size, by distributed selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

#: Groups with more values than this are never gathered in one buffer.
LARGEST = 100_000
#: Pivots by which a round cuts what is left of a group.
PIVOTS = 64


def group_medians(rows: DataFrame, keys: list[str], value: str, largest: int = LARGEST) -> DataFrame:
    """``keys`` and ``median``: the exact median of each group's values, the mean of the middle two where their number is even.

    Small groups are aggregated as usual. Of groups above ``largest`` values,
    which number at most rows / ``largest`` and are broadcast, the middle ranks
    are selected: a round takes pivots from a sketch of what is left, counts the
    values between and at them, and goes on with the one bucket that holds the
    rank, until that has few values or one value only. Every round leaves about
    one part in ``PIVOTS``. Null values do not count, a group of nulls has a null
    median, null keys are a group, NaN is greater than any number.
    """
    flat = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = store(flat.groupBy(*keys).agg(F.count("__v").alias("__n")), "group-sizes")
    hot = store(sizes.filter(F.col("__n") > largest).withColumn("__group", F.monotonically_increasing_id()), "hot-groups")
    same = reduce(lambda a, b: a & b, (F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys))
    cold = flat.alias("__l").join(F.broadcast(hot.alias("__r")), same, "left_anti").groupBy(*keys).agg(F.median("__v").alias("median"))
    if hot.isEmpty():
        return cold
    values = store(flat.alias("__l").join(F.broadcast(hot.alias("__r")), same).filter("__v is not null").select("__group", "__v"), "hot-values")
    ranks = F.array_distinct(F.array(F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1))
    open_ = store(hot.select("__group", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("__n").alias("left")), "ranks")
    found = None
    while not open_.isEmpty():
        here = values.join(F.broadcast(open_), "__group").filter((F.col("lo").isNull() | (F.col("__v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") <= F.col("hi"))))
        few = here.filter(F.col("left") <= largest).groupBy("__group", "rank").agg(F.array_sort(F.collect_list("__v")).alias("vs"), F.first("below").alias("below"))
        done = [few.select("__group", "rank", F.element_at("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))]
        many = here.filter(F.col("left") > largest)
        marks = [k / (PIVOTS + 1) for k in range(1, PIVOTS + 1)]
        pivots = store(many.groupBy("__group", "rank").agg(F.array_distinct(F.percentile_approx("__v", marks, 10_000)).alias("pivots")), "pivots")
        # even buckets lie between pivots, odd ones hold a pivot's own value
        cut = many.join(F.broadcast(pivots), ["__group", "rank"]).withColumn("bucket", 2 * F.size(F.filter("pivots", lambda p: p < F.col("__v"))) + F.array_contains("pivots", F.col("__v")).cast("int"))
        counted = cut.groupBy("__group", "rank", "below", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("__group", "rank").orderBy("bucket"))  # as many rows as there are buckets
        chosen = counted.withColumn("upto", F.col("below") + upto).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        chosen = store(chosen.select("__group", "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi", F.col("n").alias("left")), "ranks")
        done.append(chosen.filter("lo = hi").select("__group", "rank", F.col("lo").alias("v")))
        got = store(done[0].union(done[1]), "selected")
        found = got if found is None else found.union(got)
        open_ = chosen.filter("lo < hi")
    middle = found.groupBy("__group").agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    return cold.unionByName(hot.join(F.broadcast(middle), "__group").select(*keys, "median"))
