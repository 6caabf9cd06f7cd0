"""Literal cases of scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.functions import claims, concentration, names


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


CONVERT = [
    ("1.5", "mg/g", 150.0), ("910", "mg/kg", 91.0), ("315.1", "mg/100g", 315.1), ("60", "µg/g", 6.0), ("20–50", "mg/100g", 35.0),
    ("0.3±0.1", "mg/g", 30.0), ("<0.01", "mg/g", 1.0), ("12.5", "mg/100g fw", 12.5), ("50", "mg/ml", 5000.0),
    ("5", "%", None), ("1.5", "mmol/l", None), ("1.5", "mg", None), ("0", "mg/g", None), ("2", "g/g", None), ("", "", None),
]


@pytest.mark.parametrize("value,unit,expected", CONVERT)
def test_convert(spark, value, unit, expected):
    got = one(spark, concentration.convert(F.col("v"), F.col("u")), v=value, u=unit)
    assert got is None if expected is None else got == pytest.approx(expected)


PARSE = [
    ("1.5mg/g", ("1.5", "mg/g")), ("20–50 mg", ("20–50", "mg")), ("", ("", "")), ("  ", ("", "")), ("trace", None), ("present", None),
    ("n/a", None), ("3 to 5 mg/100g FW", ("3-5", "mg/100g fw")), ("12", None), ("5 %", ("5", "%")), (None, ("", "")),
]


@pytest.mark.parametrize("raw,expected", PARSE)
def test_parse(spark, raw, expected):
    got = one(spark, concentration.parse(F.col("r")), r=raw)
    assert (None if got is None else tuple(got)) == expected


@pytest.mark.parametrize("raw,expected", [("β-carotene", "beta-carotene"), (" “Ω”‑3 ", '"omega"-3'), ("α→γ", "alpha->gamma"), ("κ-Casein", "kappa-casein"), ("", "")])
def test_standardize(spark, raw, expected):
    assert one(spark, names.standardize_name(F.col("r")), r=raw) == expected


def test_claims_keep_inner_commas(spark):
    raw = spark.createDataFrame([(1, "(berry, , anthocyanins, )\n(berry, , n-3,6-acid | other, 2 mg/g)\n\nnothing"), (2, None)], "id int, response string")
    good, bad = claims.claims(raw)
    assert sorted((r.chemical, r.quantity) for r in good.collect()) == [("anthocyanins", ""), ("n-3,6-acid", "2 mg/g")]
    assert sorted((r.id, r.error) for r in bad.collect()) == [(1, "bad_tuple"), (1, "bad_tuple"), (2, "bad_response")]


@pytest.mark.parametrize("raw,expected", [('{a,"b,c"}', ["a", "b,c"]), ("{}", []), (None, []), ("", []), ('{"x y",}', ["x y"])])
def test_set_field(spark, raw, expected):
    assert one(spark, names.set_field(F.col("r")), r=raw) == expected


def test_judge_reply(spark):
    df = spark.createDataFrame([('{"score": 0.9, "reason": "ok"}', None), ('{"score": 1.5}', None), ("no", None), (None, "timeout")], "t string, e string")
    got = [tuple(r[0]) for r in df.select(claims.judge_reply(F.col("t"), F.col("e"))).collect()]
    assert got == [(0.9, "ok", ""), (-1.0, "", "schema: score out of range"), (-1.0, "", "schema: no score"), (-1.0, "", "timeout")]


def test_pick_common_name(spark):
    assert one(spark, names.pick_common_name(F.col("n"), F.col("t")), n=["a", "b", "c"], t=["broad", "label", "label"]) == "b"
    assert one(spark, names.pick_common_name(F.col("n"), F.col("t")), n=[], t=[]) == ""


def test_similarity_bounds(spark):
    assert one(spark, names.similarity(F.col("a"), F.col("b")), a="apple", b="apple") == 1.0
    assert one(spark, names.similarity(F.col("a"), F.col("b")), a="", b="") == 0.0
