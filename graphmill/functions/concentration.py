"""Concentrations as text: parsing and conversion to mg per 100 g. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: characters and units the extraction prompts allow
DASHES = "-‐‑‒–—―−~∼"
APPROX = "<>≈~∼"
WEIGHTS = {"freshweight": "fw", "offw": "fw", "fw": "fw", "dryweight": "dw", "dw": "dw", "dm": "dw"}
GRAMS = {"kg": 1e3, "g": 1.0, "grams": 1.0, "mg": 1e-3, "µg": 1e-6, "ug": 1e-6, "μg": 1e-6, "ng": 1e-9}
LITRES = {"l": 1.0, "ml": 1e-3, "µl": 1e-6, "ul": 1e-6, "μl": 1e-6}
CEILING = 1e5
MILK_DENSITY = 1.03

_NUMBER = r"[\d.]+(?:±[\d.]+)?"
_SHAPE = rf"^([{APPROX}]?{_NUMBER}(?:[{DASHES}]{_NUMBER})?)(.+)$"
_SUFFIX = "(?i)(" + "|".join(sorted(WEIGHTS, key=len, reverse=True)) + ")$"


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def parse(raw: Column) -> Column:
    """struct(value, unit); both empty for blank text, null where the text is no concentration."""
    tight = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(\d)\s+to\s+(\d)", "$1-$2"), r"\s+", "")
    suffix = F.lower(F.regexp_extract(tight, _SUFFIX, 1))
    bare = F.regexp_replace(tight, _SUFFIX, "")
    value, unit = F.regexp_extract(bare, _SHAPE, 1), F.regexp_extract(bare, _SHAPE, 2)
    weighted = F.concat_ws(" ", unit, F.try_element_at(_table(WEIGHTS), suffix))
    good = (value != "") & unit.rlike(r"[\p{L}%]")
    pair = lambda v, u: F.struct(v.alias("value"), u.alias("unit"))
    return F.when(tight == "", pair(F.lit(""), F.lit(""))).when(good, pair(value, weighted))


def numeric(value: Column) -> Column:
    """The number a value stands for: no approximation mark, no deviation, the middle of a range."""
    bare = F.regexp_replace(value, rf"^[{APPROX}]+", "")
    centre = F.substring_index(bare, "±", 1)
    parts = F.split(F.translate(centre, DASHES, "-" * len(DASHES)), "-", 2)
    one = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 2, (one(1) + one(2)) / 2).otherwise(one(1))


def _unit_parts(unit: Column) -> Column:
    """A unit's parts around the slash, without its weight suffix, in lower case."""
    return F.split(F.lower(F.trim(F.regexp_replace(F.trim(unit), _SUFFIX, ""))), "/")


def _ratio(parts: Column) -> Column:
    below = F.try_element_at(parts, F.lit(2))
    name = F.ltrim(below, F.lit("0123456789"))
    amount = F.coalesce(F.nullif(F.substring(below, F.lit(1), F.length(below) - F.length(name)), F.lit("")).cast("double"), F.lit(1.0))
    above = F.try_element_at(_table(GRAMS), F.try_element_at(parts, F.lit(1)))
    grams = F.try_element_at(_table(GRAMS | {k: v * 1e3 for k, v in LITRES.items()}), name)
    return F.when((F.size(parts) == 2) & (amount > 0), above / grams * (100 / amount) * 1e3)


def multiplier(unit: Column) -> Column:
    """What turns the unit into mg/100g; a millilitre counts as a gram; null for everything else, percent included."""
    return _ratio(_unit_parts(unit))


def convert(value: Column, unit: Column) -> Column:
    """The value in mg/100g, or null where it is not positive, not convertible or implausibly large."""
    number = numeric(value)
    out = number * multiplier(unit)
    return F.when((number > 0) & (out <= CEILING), out)


def milk_ug_240ml(value: Column) -> Column:
    """µg per 240 ml of milk as mg/100g."""
    return value / F.lit(MILK_DENSITY) * 100 / 240 / 1e3


def milk_concentration(value: Column, unit: Column, estimate: Column, glycan: Column) -> Column:
    """Milk figures in mg/100g: µg/240 ml by density, percent by the estimate unless a glycan, zero as null."""
    out = F.when(unit == "%", F.when(glycan, F.lit(None).cast("double")).otherwise(estimate)).otherwise(milk_ug_240ml(value))
    return F.when(out != 0, out)


def with_converted(df: DataFrame, value: Column, unit: Column) -> DataFrame:
    """``df`` with ``conc_value``, what ``convert`` gives of a value and its unit.

    Each step sits behind an explode, which keeps the optimiser from repeating
    the long expression wherever a field of it is used.
    """
    parts = df.select("*", F.explode(F.array(_unit_parts(unit))).alias("__u"))
    pieces = F.struct(numeric(value).alias("n"), _ratio(F.col("__u")).alias("m"))
    pieces = parts.select("*", F.explode(F.array(pieces)).alias("__p"))
    out = F.col("__p.n") * F.col("__p.m")
    return pieces.withColumn("conc_value", F.when((F.col("__p.n") > 0) & (out <= CEILING), out)).drop("__p", "__u")


def converted(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``conc`` (the parsed struct) and ``conc_value`` (mg/100g) of a text column."""
    parsed = df.select("*", F.explode(F.array(parse(F.col(raw)))).alias("conc"))
    return with_converted(parsed, F.col("conc.value"), F.col("conc.unit"))
