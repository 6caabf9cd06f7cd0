"""Extraction responses: claim tuples, requests, judge replies. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import concentration
from .names import standardize_name

_TUPLE = r"^([^,]*),([^,]*),(.*),([^,]*)$"


def claim(line: Column) -> Column:
    """struct(food, part, chemical, quantity) of one line, or null.

    Parentheses go; the first two commas and the last one split, so chemical
    names keep theirs. Of names with aliases behind a pipe the first counts. Food
    and chemical must not be empty.
    """
    bare = F.regexp_replace(F.trim(line), r"^\(|\)$", "")
    field = lambda k: F.trim(F.regexp_extract(bare, _TUPLE, k))
    first = lambda c: F.trim(F.substring_index(c, "|", 1))
    food, chemical = standardize_name(first(field(1))), standardize_name(first(field(3)))
    return F.when(bare.rlike(_TUPLE) & (food != "") & (chemical != ""), F.struct(food.alias("food"), F.lower(field(2)).alias("part"), chemical.alias("chemical"), field(4).alias("quantity")))


def claims(raw: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(claims, errors) of all response lines, one row per line.

    Claims carry ``food, part, chemical, quantity, conc_value`` (mg/100g or
    null). Errors carry ``line`` and ``error``: ``bad_response`` for a null
    response, ``bad_tuple`` (a blank line is one), ``bad_conc`` or
    ``unconverted``; rows of the last two are claims as well.
    """
    lines = raw.filter(F.col(response).isNotNull()).withColumn("line", F.explode(F.split(F.trim(response), r"\r?\n")))
    # explode keeps the optimiser from repeating the long expressions wherever a field is used
    parsed = lines.select("*", F.explode(F.array(claim(F.col("line")))).alias("claim"))
    parsed = parsed.select("*", F.explode(F.array(concentration.parse(F.col("claim.quantity")))).alias("conc"))
    parsed = parsed.withColumn("conc_value", concentration.convert(F.col("conc.value"), F.col("conc.unit")))
    given = F.col("claim.quantity") != ""
    error = F.when(F.col("claim").isNull(), "bad_tuple").when(given & F.col("conc").isNull(), "bad_conc").when(given & F.col("conc_value").isNull(), "unconverted")
    parsed = parsed.withColumn("error", error)
    good = parsed.filter("claim is not null").select(*raw.columns, "claim.*", "conc_value")
    bad = parsed.filter("error is not null").select(*raw.columns, "line", "error")
    nothing = raw.filter(F.col(response).isNull()).select(*raw.columns, F.lit(None).cast("string").alias("line"), F.lit("bad_response").alias("error"))
    return good, bad.unionByName(nothing)


def response_fields(response: Column) -> Column:
    """Lines of a response as sorted arrays of four fields: three commas split, missing fields are empty."""
    bare = lambda x: F.regexp_replace(F.trim(x), r"^\(|\)$", "")
    four = lambda x: F.transform(F.slice(F.concat(F.split(bare(x), ",", 4), F.array_repeat(F.lit(""), 4)), 1, 4), lambda f: F.trim(f))
    return F.array_sort(F.transform(F.filter(F.split(response, "\n"), lambda x: F.trim(x) != ""), four))


def render(template: str, **fields: Column) -> Column:
    """A prompt: each ``{name}`` of the template replaced by its column."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def request(custom_id: Column, model: str, prompt: Column) -> Column:
    """One batch request as JSON."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.lit(model).alias("model"), F.array(message).alias("messages")).alias("body")))


def judge_reply(text: Column, error: Column) -> Column:
    """struct(score, reason, error_text) of a judge's reply.

    A reported error, a reply that is no JSON, a score outside 0 to 1 or a reason
    of more than 500 characters give score -1 and an error text.
    """
    reply = F.from_json(text, "score double, reason string")
    bad = (
        F.when(error.isNotNull(), error)
        .when(reply["score"].isNull(), F.lit("schema: no score"))
        .when((reply["score"] < 0) | (reply["score"] > 1), F.lit("schema: score out of range"))
        .when(F.length(reply["reason"]) > 500, F.lit("schema: reason too long"))
    )
    return F.struct(F.when(bad.isNull(), reply["score"]).otherwise(F.lit(-1.0)).alias("score"), F.when(bad.isNull(), F.coalesce(reply["reason"], F.lit(""))).otherwise(F.lit("")).alias("reason"), F.coalesce(bad, F.lit("")).alias("error_text"))
