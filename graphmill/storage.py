"""Stored intermediate tables for iterated jobs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a plain local session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-graphmill-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of stored tables by the identity of their plans, so that superseded ones can be removed.
_held: dict[int, str] = {}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: ends the lineage, so a loop's plan does not grow and lost executors lose no rounds."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _held[id(out)] = path
    weakref.finalize(out, _held.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``store`` returned, once what was made of them is stored itself; anything else is left alone."""
    for table in tables:
        path = _held.pop(id(table), None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
