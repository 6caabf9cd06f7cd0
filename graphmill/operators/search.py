"""Ranked search over a stored index of trigrams, instead of a scan of all names.

Entities are banded by their number of associations, which ranks matches: every
entity of a band has more than any of a lower one, so a search goes through the
bands from the top and stops at the one that completes the page. Within a band
the postings of a trigram are rows, bucketed by trigram; a term's rarest
trigrams are intersected and what remains is compared with the term itself. The
index is one version of a versioned table, and a search reads the parts that it
needs and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import similarity
from ..sources import versions
from ..storage import store

#: Parts that trigrams, tokens and entities are dealt into, per band.
GRAM_BUCKETS, TOKEN_BUCKETS, ENTITY_BUCKETS = 64, 16, 16
#: Trigrams of a term whose postings are intersected.
RAREST = 3
#: Tables of terms and candidates with at most so many rows are broadcast.
BROADCAST_ROWS = 200_000

POSTINGS = "gram string, entity_id string"
GRAMS = "gram string, band int, n long"
TOKENS = "token string, entity_id string"
ENTITIES = "entity_id string, name string, token_text string, associations long, band int"


def band_of(associations: Column) -> Column:
    """Bands hold 0 to 2, 3 to 14, 15 to 62 associations and so on: a band's entities have less than four times as many, and all fewer than the next band's."""
    return F.floor((F.length(F.bin(associations + 1)) - 1) / 2).cast("int")


def grams_of(text: Column) -> Column:
    """Distinct stretches of three characters; a text that contains a term has all of the term's."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("string")


def build_index(entities: DataFrame, root: str) -> versions.Snapshot:
    """Index ``entity_id, name, token_text, tokens, associations`` as a new version below ``root``."""
    rows = store(entities.select("entity_id", "name", "token_text", "tokens", F.coalesce("associations", F.lit(0)).cast("long").alias("associations")).withColumn("band", band_of(F.col("associations"))), "entities")
    postings = rows.select("band", "entity_id", F.explode(grams_of(F.col("token_text"))).alias("gram"))
    tokens = rows.select("band", "entity_id", F.explode(F.array_distinct("tokens")).alias("token"))
    spark, part = rows.sparkSession, lambda of: F.concat_ws("-", F.col("band").cast("string"), of)

    def write(base: versions.Snapshot) -> dict[str, dict[str, str]]:
        return {
            "entities": versions.write_parts(rows.select("entity_id", "name", "token_text", "associations", "band"), root, part(_bucket(F.col("entity_id"), ENTITY_BUCKETS))),
            "postings": versions.write_parts(postings, root, part(_bucket(F.col("gram"), GRAM_BUCKETS))),
            "tokens": versions.write_parts(tokens, root, part(_bucket(F.col("token"), TOKEN_BUCKETS))),
            "grams": versions.write_parts(postings.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("n")), root, _bucket(F.col("gram"), GRAM_BUCKETS)),
        }

    return versions.update(spark, root, write, replace=True)


def _fit(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _buckets(df: DataFrame, bucket: Column) -> list[str]:
    return [r[0] for r in df.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets


def bands(seen: versions.Snapshot) -> list[int]:
    """The bands of an index, highest first."""
    return sorted({int(p.split("-")[0]) for p in seen.tables.get("entities", {})}, reverse=True)


def search_index(spark: SparkSession, root: str, terms: DataFrame, limit: int = 10, number: int = 1, seen: versions.Snapshot | None = None) -> DataFrame:
    """Page ``number`` of the matches of every term (column ``term``): ``term, rank, entity_id, name, exact, associations, similarity``.

    Matches contain the lower-cased term in their token text, wildcards are
    literal. Those with the term as a whole token come first, then those with
    more associations, then more similar names, then by id. Terms shorter than a
    trigram read the entities of a band instead of postings. Repeated terms are
    one, null and empty terms match nothing.
    """
    seen = seen or versions.snapshot(spark, root)
    need = limit * number
    wanted = store(terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct().withColumn("grams", grams_of(F.col("term"))), "terms")
    get = lambda table, schema, parts: versions.read(spark, root, table, schema, seen, parts)
    shown = ["entity_id", "name", "token_text", "associations"]

    def entities(keys: DataFrame, band: int) -> DataFrame:
        """The band's entities that ``keys`` (``term, entity_id``) name."""
        parts = [f"{band}-{b}" for b in _buckets(keys, _bucket(F.col("entity_id"), ENTITY_BUCKETS))]
        return get("entities", ENTITIES, parts).select(*shown).join(_fit(keys), "entity_id").select("term", *shown)

    def unfinished(terms: DataFrame, found: list[DataFrame]) -> DataFrame:
        if not found:
            return terms
        done = reduce(DataFrame.unionByName, found).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)
        return store(terms.join(done, "term", "left_anti"), "open")

    exact: list[DataFrame] = []
    open_terms = wanted
    for band in bands(seen):
        parts = [f"{band}-{b}" for b in _buckets(open_terms, _bucket(F.col("term"), TOKEN_BUCKETS))]
        keys = store(get("tokens", TOKENS, parts).join(_fit(open_terms), F.col("token") == F.col("term")).select("term", "entity_id"), "exact")
        exact.append(store(entities(keys, band), "exact-found"))
        open_terms = unfinished(wanted, exact)
        if open_terms.isEmpty():
            break

    # what is still open is completed by matches that are not exact
    rest = open_terms
    grams = rest.select("term", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    counts = get("grams", GRAMS, _buckets(grams, _bucket(F.col("gram"), GRAM_BUCKETS))).join(grams, "gram")
    by = Window.partitionBy("term", "band")
    plan = counts.withColumns({"have": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy("n", "gram"))}).filter((F.col("have") == F.col("all")) & (F.col("place") <= RAREST))
    plan = store(plan.select("term", "band", "gram", F.least("all", F.lit(RAREST)).alias("asked")), "search-plan")
    short = rest.filter(F.size("grams") == 0).select("term")
    has_short = not short.isEmpty()
    partial: list[DataFrame] = []
    for band in bands(seen):
        if open_terms.isEmpty():
            break
        chosen = store(plan.filter(F.col("band") == band).join(open_terms.select("term"), "term", "left_semi").drop("band"), "chosen")
        parts = [f"{band}-{b}" for b in _buckets(chosen, _bucket(F.col("gram"), GRAM_BUCKETS))]
        keys = get("postings", POSTINGS, parts).join(_fit(chosen), "gram").groupBy("term", "entity_id", "asked").agg(F.count(F.lit(1)).alias("n")).filter("n = asked")
        found = entities(store(keys.select("term", "entity_id"), "candidates"), band)
        if has_short:
            every = get("entities", ENTITIES, [p for p in seen.tables["entities"] if p.split("-")[0] == str(band)]).select(*shown)
            few = _fit(store(short.join(open_terms.select("term"), "term", "left_semi"), "short"))
            found = found.unionByName(every.join(few, F.col("token_text").contains(F.col("term"))).select("term", *shown))
        found = found.filter(F.col("token_text").contains(F.col("term")))
        known = reduce(DataFrame.unionByName, exact).select("term", "entity_id") if exact else None
        partial.append(store(found if known is None else found.join(known, ["term", "entity_id"], "left_anti"), "partial"))
        open_terms = unfinished(rest, [*exact, *partial])
    sides = [x.withColumn("exact", F.lit(True)) for x in exact] + [x.withColumn("exact", F.lit(False)) for x in partial]
    if not sides:
        return spark.createDataFrame([], "term string, rank int, entity_id string, name string, exact boolean, associations long, similarity double")
    scored = reduce(DataFrame.unionByName, sides).withColumn("similarity", similarity(F.col("name"), F.col("term")))
    order = Window.partitionBy("term").orderBy(F.desc("exact"), F.desc("associations"), F.desc("similarity"), "entity_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= need) & (F.col("rank") > need - limit))
    return ranked.select("term", "rank", "entity_id", "name", "exact", "associations", "similarity")
