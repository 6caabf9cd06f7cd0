"""Scoring that goes on where it stopped: finished chunks and unchanged rows are not scored again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..storage import store
from .text import score_batches

CHUNKS = 64
#: Chunks scored and committed together; each wave reads the stored input's chunks once.
WAVE = 16


def _digest(columns: list[str]):
    return F.concat_ws(":", *(F.hex(F.xxhash64(*columns, F.lit(seed))) for seed in (1, 2)))


def score_resumably(rows: DataFrame, key: str, root: str, schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], chunks: int = CHUNKS, wave: int = WAVE, waves: int | None = None) -> int:
    """Score ``rows`` chunk by chunk into the versioned table below ``root``; returns how many rows the model saw.

    A chunk is named by its number and a digest of its rows, and is committed
    together with its scores, a wave of chunks at a time: a job that dies, or
    stops after ``waves``, has its finished waves and scores the others when run
    again. In a chunk that changed, rows whose own digest is known keep their
    scores. ``schema`` are the model's columns, ``key`` first; ``load`` as for
    ``score_batches``. Rows that are gone lose their scores; rows of one key are
    told apart by their content, equal ones are scored once.
    """
    spark, columns = rows.sparkSession, rows.columns
    marked = rows.withColumns({"__row": _digest(columns), "__chunk": F.pmod(F.xxhash64(key), F.lit(chunks)).cast("string")}).dropDuplicates(["__row"])
    marked = store(marked.repartition("__chunk"), "ledger-input")
    sums = [F.sum(F.xxhash64("__row", F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    now = {r[0]: f"{r[0]}:{r[1]}" for r in marked.groupBy("__chunk").agg(F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums))).collect()}  # ``chunks`` rows
    done = versions.snapshot(spark, root).tables.get("scores", {})
    todo = sorted(c for c, name in now.items() if name not in done)
    scored = 0
    full = f"{schema}, __row string"
    for at in range(0, len(todo), wave)[:waves]:
        some = todo[at : at + wave]
        old = versions.read(spark, root, "scores", full, parts=[p for p in done if p.split(":")[0] in some])
        mine = marked.filter(F.col("__chunk").isin(some))
        fresh = mine.join(old.select("__row"), "__row", "left_anti")
        made = score_batches(fresh.select(*columns, "__row"), full, lambda: _with_row(load()))
        result = store(made, "scored")
        scored += result.count()
        kept = old.join(mine.select("__row"), "__row", "left_semi")
        whole = result.unionByName(kept).join(mine.select("__row", "__chunk"), "__row")

        def write(base: versions.Snapshot) -> dict[str, dict[str, str]]:
            parts = versions.write_parts(whole.select(*result.columns, "__chunk"), root, F.col("__chunk"))
            stay = {p: path for p, path in base.tables.get("scores", {}).items() if p.split(":")[0] not in some}
            return {"scores": stay | {now[c]: path for c, path in parts.items()}}

        done = versions.update(spark, root, write, replace=True).tables["scores"]
    if waves is None and any(p.split(":")[0] not in now for p in done):
        versions.update(spark, root, lambda base: {"scores": {p: path for p, path in base.tables["scores"].items() if p.split(":")[0] in now}}, replace=True)
    return scored


def _with_row(model: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = model(batch.drop(columns="__row"))
        return out.assign(__row=batch["__row"].to_numpy())

    return run


def read_scores(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The scores of the newest version, one row per distinct scored row."""
    return versions.read(spark, root, "scores", schema)
