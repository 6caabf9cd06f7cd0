"""Joins in which some keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

#: A key is hot when it holds more than this share of the rows; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001
#: Tables with at most so many rows are broadcast.
BROADCAST_ROWS = 500_000


def fit(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def join_hot(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, a stored table unique on ``on`` whose ``weight`` counts the rows of ``left`` with that key.

    Hot keys number at most ``1 / HOT_SHARE``, so their rows of ``right`` are
    broadcast and ``left`` stays where it is; the rest is joined by shuffle. Null
    keys match nothing: an inner join drops them, a left join keeps them.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot, cold = right.filter(F.col(weight) > limit), right.filter(F.coalesce(F.col(weight), F.lit(0)) <= limit)
    keys = F.broadcast(hot.select(on))
    near = left.join(keys, on, "left_semi").join(F.broadcast(hot), on)
    return near.unionByName(left.join(keys, on, "left_anti").join(cold, on, how))


#: Members of groups are sent to every task up to so many; more are shuffled in ``SLICES`` slices of each group.
MEMBERS = 2_000_000
SLICES = 64
#: So many members of a group stand together in the product; Parquet packs values by eight.
RUN = 512


def with_members(rows: DataFrame, members: DataFrame, on: str, spread: bool = True) -> DataFrame:
    """``rows`` once for each of the ``members`` of their group ``on``: a product within groups, however large these are.

    With ``spread`` ``rows`` are dealt out evenly first, for a few of them may
    give nearly all of the product. Members are narrow rows and stay single, never in arrays.
    A task's rows of a group meet its members by the same runs of ``RUN``, one run
    after the other, so that files written in this order repeat short
    sequences and stay small.
    """
    spark = rows.sparkSession
    held = store(members, "members")
    if held.count() <= MEMBERS:
        even = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if spread else rows
        # at most MEMBERS / RUN groups are larger than a run
        large = F.broadcast(held.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("__runs")).filter("__runs > 1"))
        place = F.row_number().over(Window.partitionBy(on).orderBy(*(c for c in held.columns if c != on)))
        cut = held.withColumn("__run", F.floor((place - 1) / RUN).cast("int"))
        every = even.join(large, on, "left").withColumn("__of", F.explode(F.sequence(F.lit(0), F.coalesce("__runs", F.lit(1)) - 1))).drop("__runs")
        # the optimiser drops a sort that stands directly below a join
        sorted_ = every.sortWithinPartitions(on, "__of").withColumn("__run", F.explode(F.array("__of"))).drop("__of")
        return sorted_.join(F.broadcast(cut), [on, "__run"]).drop("__run")
    sliced = held.withColumn("__slice", F.pmod(F.xxhash64(*held.columns), F.lit(SLICES)).cast("int"))
    every = rows.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return every.join(sliced.hint("merge"), [on, "__slice"]).drop("__slice")


def fingerprint(df: DataFrame, *columns: str | Column) -> tuple[int, int, int]:
    """Rows and two order-free sums over their hashes: equal for equal bags of rows."""
    one, two = (F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2))
    n, a, b = df.agg(F.count(F.lit(1)), one, two).first()
    return n, int(a or 0), int(b or 0)
