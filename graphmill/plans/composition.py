"""Composition of foods: roll-up, trust filter, pages and counts.

Work is done on flat claims, one row per (food, chemical, attestation):
``food, chem, source, attestation_id, premise, reference, conc, unit, score``.
Nesting comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_hot
from ..storage import store

LOW_TRUST = 0.4
UNIT = "mg/100g"
SOURCES = ("fdc", "dmd", "lit")


def expand(triplets: DataFrame, attestations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Triplets down to attestations (inner) and evidence (left)."""
    flat = triplets.withColumn("attestation_id", F.explode("attestation_ids")).drop("attestation_ids", "source")
    return flat.join(attestations, "attestation_id").join(evidence, "evidence_id", "left")


def drop_zero(claims: DataFrame, column: str = "conc") -> DataFrame:
    """Without claims of exactly zero; what is no number counts as unknown and stays."""
    value = F.col(column).try_cast("double")
    return claims.filter(value.isNull() | (value != 0))


def latest_scores(signals: DataFrame, kind: str, key: str = "attestation_id", at: str = "created_at") -> DataFrame:
    """``key, score``: the newest valid score of one kind; error rows (negative scores) never count."""
    valid = signals.filter((F.col("signal_kind") == kind) & (F.col("score") >= 0))
    return valid.groupBy(key).agg(F.max_by("score", F.struct(F.col(at), F.col("signal_id"))).alias("score"))


def eligible(conc: Column, unit: Column) -> Column:
    """The value, where it may enter a median."""
    return F.when(conc.isNotNull() & (conc != 0) & (unit == UNIT), conc)


def trust_filter(claims: DataFrame, mode: str, threshold: float = LOW_TRUST) -> DataFrame:
    """``default`` keeps scores above the threshold, ``low_only`` those at or below it, ``show_all`` marks them (``low``); unscored counts as 1."""
    marked = claims.withColumn("low", F.coalesce("score", F.lit(1.0)) <= threshold)
    return {"default": marked.filter("not low"), "low_only": marked.filter("low"), "show_all": marked}[mode]


def rollup(claims: DataFrame, largest: int | None = None, *more: Column) -> DataFrame:
    """One row per (food, chem): claims per source, ``more`` aggregates and the exact median of eligible values.

    With ``largest`` the medians of pairs with more values than that are found
    by distributed selection (``operators.select``), so no pair is one buffer;
    claims are then read once more.
    """
    per = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in SOURCES]
    if largest is not None:
        from ..operators.select import group_medians

        medians = group_medians(claims.withColumn("__value", eligible(F.col("conc"), F.col("unit"))), ["food", "chem"], "__value", largest)
        counted = claims.groupBy("food", "chem").agg(*per, *more).alias("l")
        same = F.col("l.food").eqNullSafe(F.col("r.food")) & F.col("l.chem").eqNullSafe(F.col("r.chem"))
        return counted.join(medians.alias("r"), same).select("l.*", "median")
    return claims.groupBy("food", "chem").agg(*per, F.median(eligible(F.col("conc"), F.col("unit"))).alias("median"), *more)


def evidence_lists(claims: DataFrame) -> DataFrame:
    """One row per (food, chem) with one array of evidences per source, null where a source has none.

    Literature evidence with equal premises shares an entry and its first
    reference; tables give one evidence each.
    """
    extraction = F.struct("attestation_id", "conc", "unit")
    premise = F.when(F.col("source") == "lit", F.coalesce("premise", F.lit(""))).otherwise(F.lit(""))
    entries = claims.withColumn("premise", premise).groupBy("food", "chem", "source", "premise").agg(F.min("reference").alias("reference"), F.array_sort(F.collect_list(extraction)).alias("extraction"))
    entry = F.struct("premise", "reference", "extraction")
    lists = [F.array_sort(F.collect_list(F.when(F.col("source") == s, entry))).alias(s) for s in SOURCES]
    nested = entries.groupBy("food", "chem").agg(*lists)
    return nested.select("food", "chem", *(F.when(F.size(s) > 0, F.col(s)).alias(s) for s in SOURCES))


def premises(claims: DataFrame) -> DataFrame:
    """``food, chem, premise, first_ref, n`` of literature claims."""
    return claims.filter("source = 'lit'").groupBy("food", "chem", "premise").agg(F.min("reference").alias("first_ref"), F.count(F.lit(1)).alias("n"))


def flag_evidence(lists: DataFrame, column: str, low: Column) -> DataFrame:
    """Adds ``n_ambiguous`` and ``n_low``: evidences with any ambiguous (more than one candidate) or low-trust extraction."""
    return lists.withColumns({
        "n_ambiguous": F.size(F.filter(column, lambda e: F.exists(e["extraction"], lambda x: x["candidates"] > 1))),
        "n_low": F.size(F.filter(column, lambda e: F.exists(e["extraction"], lambda x: x["score"] <= low))),
    })


def order_evidence(column: str) -> Column:
    """Evidences by their largest converted value, descending, those without a value last."""
    best = lambda e: F.coalesce(F.array_max(F.transform(e["extraction"], lambda x: x["conc"])), F.lit(float("-inf")))
    return F.array_sort(F.col(column), lambda a, b: F.when(best(a) > best(b), -1).when(best(a) < best(b), 1).when(a["premise"] < b["premise"], -1).when(a["premise"] > b["premise"], 1).otherwise(0))


def search_predicate(term: str, id_col: str = "chem", name_col: str = "chem_name") -> Column:
    """``e<digits>`` asks for one id, anything else for names that contain it, whatever the case; wildcards are literal."""
    import re

    if re.fullmatch(r"e\d+", term):
        return F.col(id_col) == term
    return F.lower(F.col(name_col)).contains(term.lower())


def class_predicate(classes: list[str], column: str = "classes") -> Column:
    """Any of the classes, ``n/a`` standing for none."""
    out = F.arrays_overlap(F.col(column), F.array(*(F.lit(c) for c in classes if c != "n/a")).cast("array<string>"))
    return out | (F.size(column) == 0) if "n/a" in classes else out


def source_predicate(sources: list[str]) -> Column:
    """Rows with evidence of any chosen source; exactly one valid source asks for that one alone."""
    chosen = [s for s in sources if s in SOURCES]
    out = F.lit(False)
    for s in chosen:
        out = out | (F.col(f"n_{s}") > 0)
    return out


def page(rows: DataFrame, sort: str = "median", descending: bool = True, number: int = 1, size: int = 10) -> DataFrame:
    """One page: by median (nulls last) or name, ties by chem; unknown sort columns mean the name. ``rank`` counts over all pages."""
    by = F.col("median") if sort == "median" else F.lower("chem")
    order = [by.desc_nulls_last() if descending else by.asc_nulls_last(), F.col("chem").asc()]
    top = rows.orderBy(*order).limit(number * size)  # only the rows up to the page's end are gathered
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("rank") > (number - 1) * size)


def counts(rows: DataFrame) -> DataFrame:
    """``kind, key, n``: pairs per class (several classes count in each, none as n/a) and per source."""
    per_class = rows.select(F.explode(F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array(F.lit("n/a")))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    one = rows.agg(*(F.count_if(F.col(f"n_{s}") > 0).alias(s) for s in SOURCES))
    per_source = one.select(F.explode(F.map_entries(F.create_map(*(x for s in SOURCES for x in (F.lit(s), F.col(s)))))).alias("e")).select("e.key", F.col("e.value").alias("n"))
    return per_class.select(F.lit("class").alias("kind"), "key", "n").unionByName(per_source.select(F.lit("source").alias("kind"), "key", "n"))


def profile(rows: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """``bucket, chem, median, place``: chemicals by class bucket, ordered by median, nulls last."""
    table = F.create_map(*(F.lit(x) for kv in buckets.items() for x in kv))
    flat = rows.withColumn("class", F.explode("classes")).withColumn("bucket", F.try_element_at(table, F.col("class"))).filter("bucket is not null").select("bucket", "chem", "median").distinct()
    w = Window.partitionBy("bucket").orderBy(F.col("median").desc_nulls_last(), "chem")
    return flat.withColumn("place", F.row_number().over(w))


def foods_of(rows: DataFrame) -> DataFrame:
    """``chem, food, has_median, evidence_count``: foods of a chemical with and without a median."""
    return rows.select("chem", "food", F.col("median").isNotNull().alias("has_median"), sum((F.col(f"n_{s}") for s in SOURCES), F.lit(0)).alias("evidence_count"))


def scoped_siblings(rows: DataFrame, siblings: DataFrame) -> DataFrame:
    """Rows (``id``) with the siblings (``id, siblings``) that occur among the rows themselves, in order."""
    flat = siblings.select("id", F.explode("siblings").alias("s")).join(rows.select(F.col("id").alias("s")).distinct(), "s", "left_semi")
    kept = flat.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("siblings"))
    return rows.join(kept, "id", "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))


def scoped_groups(rows: DataFrame) -> DataFrame:
    """Rows (``id, group``, ids distinct) with the other ids of their group among the rows themselves, in order; none without a group.

    A group's ids are listed once and meet its rows where these are, so what is
    shuffled grows with the rows and not with the pairs.
    """
    lists = rows.filter("group is not null").groupBy("group").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count(F.lit(1)).alias("__n"))
    joined = join_hot(rows, store(lists, "groups"), "group", "__n", rows.count(), "left")
    return joined.select("id", "group", F.coalesce(F.array_remove("ids", F.col("id")), F.array().cast("array<string>")).alias("siblings"))


def evidence_count(*arrays: str) -> Column:
    """Lengths of arrays added up, null as 0."""
    return sum((F.coalesce(F.when(F.col(a).isNotNull(), F.size(a)), F.lit(0)) for a in arrays), F.lit(0))


def score_distribution(scores: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, pct``: scores in half-open bins, the last one closed; errors (negative) left out."""
    valid = scores.filter("score >= 0")
    binned = valid.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = valid.agg(F.count(F.lit(1)).alias("__all"))
    return binned.join(F.broadcast(total)).select("bin", "n", F.round(F.col("n") * 100 / F.col("__all"), 6).alias("pct"))


def score_summary(scores: DataFrame, limits: tuple[float, ...] = (0.1, 0.2, 0.33, 0.4, 0.5, 0.67, 0.9)) -> DataFrame:
    """Count, errors, least, median, mean, greatest, and how many are at or below each limit."""
    s = F.when(F.col("score") >= 0, F.col("score"))
    return scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < 0).alias("errors"), F.min(s).alias("least"), F.median(s).alias("median"), F.avg(s).alias("mean"), F.max(s).alias("greatest"), *(F.count_if(s <= t).alias(f"at_most_{round(t * 100)}") for t in limits))


def search(entities: DataFrame, term: str, limit: int = 10, number: int = 1) -> DataFrame:
    """Ranked search over ``entity_id, name, token_text, tokens, associations``.

    A row matches where its token text contains the term; an exact token comes
    first, then more associations, then higher similarity, then the id.
    """
    from ..functions.names import similarity

    wanted = term.lower()
    found = entities.filter(F.col("token_text").contains(wanted))
    found = found.withColumns({"exact": F.array_contains("tokens", wanted), "similarity": similarity(F.col("name"), F.lit(wanted))})
    order = [F.col("exact").desc(), F.col("associations").desc(), F.col("similarity").desc(), F.col("entity_id").asc()]
    top = found.orderBy(*order).limit(limit * number)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > limit * (number - 1))


def association_counts(*tables: tuple[DataFrame, str]) -> DataFrame:
    """``entity_id, associations``: row counts by the named column of each table, added up."""
    parts = [t.groupBy(F.col(c).alias("entity_id")).agg(F.count(F.lit(1)).alias("n")) for t, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id").agg(F.sum("n").alias("associations"))
