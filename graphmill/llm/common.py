"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a plain local session gets a folder of its own,
    removed at exit; any other master is an error, since a machine-local folder
    would be invisible to the executors.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folders.get(context.applicationId)
        if base is None:
            base = tempfile.mkdtemp(prefix="spark-graphmill-")
            _own_folders[context.applicationId] = base
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """Names rows of documents by id and text, so that rows without an id, or of one id and unlike texts, are told apart."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


#: Sides of a join with at most so many rows of a few dozen bytes are broadcast: about 100 MB.
BROADCAST_ROWS = 500_000


def checked(small: DataFrame) -> DataFrame:
    """``small``, a stored table, marked for broadcast where its counted rows allow it; otherwise Spark joins by shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[tuple]], schema: str, rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """Run ``fn`` over the rows of each partition, in order, through Arrow.

    ``fn`` takes an iterator of row tuples and yields output tuples. Output is
    sent on in batches of at most ``rows`` rows or about ``size`` bytes of binary
    or string data, so memory does not follow the partition.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for batch in batches:
                step = 512
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        held: list[tuple] = []
        weight = 0
        for row in fn(tuples()):
            held.append(row)
            weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if len(held) >= rows or weight >= size:
                yield _batch(held, arrow)
                held, weight = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int, str]:
    """Add a global row number (0-based, by ``order``); return the rows, their count and the new column's name.

    Rows are range-partitioned and sorted, written once, and counted per
    partition; only those counts (one per partition) reach the driver. Ties take
    the same set of numbers in any order, so ``order`` should end in columns that
    make tied rows interchangeable. The new column bears a name that is free.
    """
    spark = df.sparkSession
    at, row = free_name(df, "__at"), free_name(df, "__row")
    ranged = df.repartitionByRange(*(F.col(c).asc_nulls_last() for c in order))
    ranged = ranged.sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in order))
    kept = stored(ranged.withColumn(at, F.monotonically_increasing_id()), name)
    counts = {r[0]: r[1] for r in kept.groupBy(F.shiftright(at, 33).alias("p")).count().collect()}
    total, starts = 0, []
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    part, start = free_name(df, "__part"), free_name(df, "__start")
    # one row per partition of the table, so the size is known
    table = F.broadcast(spark.createDataFrame(starts, f"`{part}` long, `{start}` long"))
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    out = kept.withColumn(part, F.shiftright(at, 33)).join(table, part).withColumn(row, F.col(start) + within)
    return out.drop(part, start, at), total, row


#: A key is hot when it holds more than this share of the rows; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def join_skewed(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``on``) where some keys may hold a third of ``left``.

    ``weight`` is a column of ``right``: the rows of ``left`` with that key. Keys
    above ``HOT_SHARE`` of ``total`` number at most ``1 / HOT_SHARE``, so those
    rows of ``right`` are broadcast; the rest is joined by shuffle.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    keys = F.broadcast(hot.select(on))
    near = left.join(keys, on, "left_semi").join(F.broadcast(hot), on, "inner")
    far = left.join(keys, on, "left_anti").join(cold, on, how)
    return near.unionByName(far)
