"""Attestations of resolved edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import concentration
from graphmill.operators import build


def test_kept_values_are_converted_once(spark):
    rows = [("1", "a", "s1", "pa", 2.0, "UG"), ("1", "b", "s1", "pb", 3.0, None), ("2", "a", "s2", "pa", None, "MG"), ("2", "a", "s3", "pa", 5.0, "G"), ("3", "c", "s4", "pc", 1.0, "no unit")]
    one = lambda c: F.array(c)
    frame = spark.createDataFrame(rows, "head_native_id string, tail_native_id string, head_id string, tail_id string, amount double, unit string").withColumns({"head_candidates": one("head_id"), "tail_candidates": one("tail_id")})
    unit = F.concat(F.lower(F.coalesce("unit", F.lit("mg"))), F.lit("/100g"))
    _, found, _ = build.attest(frame, "fdc", F.col("head_native_id"), F.lit("r1"), F.col("amount"), unit)
    got = {(r.head_name_raw, r.tail_name_raw): (r.conc_value, r.conc_unit) for r in found.collect()}
    want = {(r.h, r.t): r.v for r in frame.select(F.col("head_native_id").alias("h"), F.col("tail_native_id").alias("t"), concentration.convert(F.col("amount").cast("string"), unit).alias("v")).collect() if (r.h, r.t) != ("2", "a")}
    assert got == {k: (v, "mg/100g" if v is not None else None) for k, v in want.items()} | {("2", "a"): (5000.0, "mg/100g")}
    # once for the unit and four times within the one expression of the number: the optimiser repeats more where no step stands between
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 5
