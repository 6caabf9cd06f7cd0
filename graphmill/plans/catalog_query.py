"""Query-surface entries: composition, trust, pages, counts, search, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..storage import store
from . import composition as comp
from . import testgraph as tg

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _scored(spark: SparkSession, d: str) -> DataFrame:
    scores = comp.latest_scores(tg.signals(spark, d), "view", "subject")
    return tg.claims(spark, d, scores)


ROLLUP = """count(*) FILTER (source = 'fdc') AS n_fdc, count(*) FILTER (source = 'dmd') AS n_dmd, count(*) FILTER (source = 'lit') AS n_lit,
  median(conc) FILTER (unit = 'mg/100g' AND conc <> 0) AS median"""
COMPOSITION = f"composition AS (SELECT food, chem, {ROLLUP} FROM claims GROUP BY food, chem)"
SCORED = "scored AS (SELECT c.*, s.score, coalesce(s.score, 1.0) <= 0.4 AS low FROM claims c LEFT JOIN scores s USING (subject))"
WITH_SCORED = f"WITH {tg.CLAIMS}, {tg.SIGNALS}, {tg.SCORES}, {SCORED}"
WITH_COMPOSITION = f"WITH {tg.CLAIMS}, {COMPOSITION}"


@query(f"{WITH_COMPOSITION} SELECT * FROM composition")
def composition_median(spark, d):
    """A01 A02 A04 J02 F08"""
    return comp.rollup(comp.drop_zero(tg.claims(spark, d)))


@query(f"""WITH {tg.CLAIMS} SELECT food, part AS chem, {ROLLUP} FROM claims GROUP BY food, part""")
def composition_expanded(spark, d):
    """From triplets down to attestations and evidence, then rolled up"""
    from ..operators import build

    # kept once, or the joins behind the claims would be shuffled for each of the three tables
    c = store(tg.claims(spark, d).select("food", "part", "source", "attestation_id", "conc", "unit", F.concat(F.lit("ev"), "reference").alias("evidence_id"), "reference"), "claims")
    triplets = build.merge_triplets(c.select(F.col("food").alias("head_id"), F.lit("r1").alias("relationship_id"), F.col("part").alias("tail_id"), "source", "attestation_id"))
    # an attestation belongs to one triplet; order and line number are not unique together with part and supplier
    attestations = c.select("attestation_id", "evidence_id", "source", "conc", "unit")
    evidence = c.select("evidence_id", "reference").dropDuplicates(["evidence_id"])  # its reference is part of the id; one shuffle serves the join too
    flat = comp.expand(triplets, attestations, evidence).filter("reference is not null")
    return comp.rollup(flat.withColumnsRenamed({"head_id": "food", "tail_id": "chem"}))


@query(f"{WITH_SCORED} SELECT food, chem, {ROLLUP} FROM scored WHERE NOT low GROUP BY food, chem")
def composition_trust_default(spark, d):
    """C19 W01"""
    return comp.rollup(comp.trust_filter(_scored(spark, d), "default"))


@query(f"{WITH_SCORED} SELECT food, chem, {ROLLUP} FROM scored WHERE low GROUP BY food, chem")
def composition_trust_low_only(spark, d):
    return comp.rollup(comp.trust_filter(_scored(spark, d), "low_only"))


@query(f"{WITH_SCORED} SELECT food, chem, {ROLLUP}, count(*) FILTER (low) AS n_low FROM scored GROUP BY food, chem")
def composition_trust_show_all(spark, d):
    return comp.rollup(comp.trust_filter(_scored(spark, d), "show_all"), None, F.count_if("low").alias("n_low"))


@query(f"WITH {tg.SIGNALS} SELECT subject AS user_id, signal_kind, score, created_at AS ts FROM signals WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY subject, signal_kind ORDER BY created_at DESC, signal_id DESC) = 1")
def latest_signal(spark, d):
    """W01, as a window over all kinds"""
    w = Window.partitionBy("subject", "signal_kind").orderBy(F.desc("created_at"), F.desc("signal_id"))
    rows = tg.signals(spark, d).filter("score >= 0").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return rows.select(F.col("subject").alias("user_id"), "signal_kind", "score", F.col("created_at").alias("ts"))


@query(f"WITH {tg.CLAIMS} SELECT food, chem, premise, min(reference) AS first_ref, count(*) AS n FROM claims WHERE source = 'lit' GROUP BY food, chem, premise")
def evidence_by_premise(spark, d):
    """A03"""
    return comp.premises(tg.claims(spark, d))


@query(f"""WITH {tg.CLAIMS}, e AS (SELECT food, chem, source, CASE WHEN source = 'lit' THEN premise ELSE '' END AS premise, count(*) AS n, min(reference) AS r FROM claims GROUP BY ALL)
SELECT food, chem, nullif(count(*) FILTER (source = 'fdc'), 0) AS fdc, nullif(count(*) FILTER (source = 'dmd'), 0) AS dmd, nullif(count(*) FILTER (source = 'lit'), 0) AS lit,
  sum(n)::BIGINT AS extractions, string_agg(source || ':' || premise || ':' || r, '|' ORDER BY source || ':' || premise || ':' || r) AS refs FROM e GROUP BY food, chem""")
def evidence_lists(spark, d):
    """Nested evidence"""
    nested = comp.evidence_lists(tg.claims(spark, d))
    size = lambda s: F.size(s).cast("long")
    deep = lambda s: F.coalesce(F.aggregate(s, F.lit(0), lambda n, e: n + F.size(e["extraction"])), F.lit(0))
    none = F.array().cast("array<string>")
    named = lambda s: F.coalesce(F.transform(s, lambda e: F.concat_ws(":", F.lit(s), e["premise"], e["reference"])), none)
    refs = F.concat(*map(named, comp.SOURCES))
    return nested.select("food", "chem", *(F.when(F.col(s).isNotNull(), size(s)).alias(s) for s in comp.SOURCES), sum((deep(s) for s in comp.SOURCES), F.lit(0)).cast("long").alias("extractions"), F.array_join(F.array_sort(refs), "|").alias("refs"))


PAGE = "row_number() OVER (ORDER BY median DESC NULLS LAST, chem) AS rank, food, chem, median"


@query(f"{WITH_COMPOSITION} SELECT * FROM (SELECT {PAGE} FROM composition WHERE food = 's1' AND contains(lower(chem), 'brand#1') AND n_fdc > 0 AND median IS NOT NULL) WHERE rank BETWEEN 3 AND 4")
def composition_page(spark, d):
    """O01 F06 F07 C18"""
    rows = comp.rollup(tg.claims(spark, d).filter("food = 's1'"))
    rows = rows.filter(comp.search_predicate("Brand#1", name_col="chem") & comp.source_predicate(["fdc"]) & F.col("median").isNotNull())
    return comp.page(rows, number=2, size=2).select("rank", "food", "chem", "median")


CLASSES = "classes AS (SELECT p_brand AS chem, list_sort(list_distinct(list(p_type))) AS classes FROM part GROUP BY p_brand)"


def _with_classes(spark, d) -> DataFrame:
    part = tg.table(spark, d, "part").groupBy(F.col("p_brand").alias("chem")).agg(F.array_sort(F.collect_set("p_type")).alias("classes"))
    return comp.rollup(tg.claims(spark, d)).join(part, "chem", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))


@query(f"""{WITH_COMPOSITION}, {CLASSES}, x AS (SELECT c.*, coalesce(k.classes, []) AS classes FROM composition c LEFT JOIN classes k USING (chem) WHERE food IN ('s1', 's2', 's3')),
f AS (SELECT unnest(CASE WHEN len(classes) > 0 THEN classes ELSE ['n/a'] END) AS key FROM x)
SELECT 'class' AS kind, key, count(*) AS n FROM f GROUP BY key
UNION ALL SELECT 'source', 'fdc', count(*) FILTER (n_fdc > 0) FROM x UNION ALL SELECT 'source', 'dmd', count(*) FILTER (n_dmd > 0) FROM x UNION ALL SELECT 'source', 'lit', count(*) FILTER (n_lit > 0) FROM x""")
def composition_counts(spark, d):
    """A07"""
    return comp.counts(_with_classes(spark, d).filter(F.col("food").isin("s1", "s2", "s3")))


BUCKETS = {"ECONOMY": "macro", "SMALL": "micro", "LARGE": "other", "PROMO": "flavor"}


@query(f"""{WITH_COMPOSITION}, {CLASSES}, x AS (SELECT food, chem, median, unnest(classes) AS class FROM composition JOIN classes USING (chem) WHERE food = 's1'),
b AS (SELECT DISTINCT CASE class WHEN 'ECONOMY' THEN 'macro' WHEN 'SMALL' THEN 'micro' WHEN 'LARGE' THEN 'other' WHEN 'PROMO' THEN 'flavor' END AS bucket, chem, median FROM x)
SELECT bucket, chem, median, row_number() OVER (PARTITION BY bucket ORDER BY median DESC NULLS LAST, chem) AS place FROM b WHERE bucket IS NOT NULL""")
def profile_buckets(spark, d):
    """A08"""
    return comp.profile(_with_classes(spark, d).filter("food = 's1'"), BUCKETS)


@query(f"{WITH_COMPOSITION} SELECT chem, food, median IS NOT NULL AS has_median, n_fdc + n_dmd + n_lit AS evidence_count FROM composition")
def chem_foods_split(spark, d):
    """O04 C31"""
    return comp.foods_of(comp.rollup(tg.claims(spark, d)))


@query("""WITH page AS (SELECT 'p' || p_partkey AS id, p_name FROM part WHERE p_size % 2 = 1)
SELECT a.id, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS siblings FROM page a LEFT JOIN page b ON a.p_name = b.p_name AND a.id <> b.id GROUP BY a.id""")
def scoped_siblings(spark, d):
    """J14 J15"""
    page = tg.table(spark, d, "part").filter("p_size % 2 = 1").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("group"))
    out = comp.scoped_groups(page)
    return out.select("id", F.array_join("siblings", ",").alias("siblings"))


@query(f"{WITH_COMPOSITION} SELECT food, row_number() OVER (PARTITION BY chem ORDER BY median DESC, food) AS rank, chem, median FROM composition WHERE median >= 0")
def concentration_rank(spark, d):
    """O08 O07"""
    w = Window.partitionBy("chem").orderBy(F.desc("median"), "food")
    return comp.rollup(tg.claims(spark, d)).filter("median >= 0").select("food", F.row_number().over(w).alias("rank"), "chem", "median")


@query(f"""{WITH_SCORED} SELECT attestation_id, food, score FROM scored WHERE food = 's7' AND source = 'lit' ORDER BY score NULLS LAST, attestation_id""")
def claim_inspection(spark, d):
    """J17"""
    return _scored(spark, d).filter("food = 's7' and source = 'lit'").select("attestation_id", "food", "score").distinct().orderBy(F.asc_nulls_last("score"), "attestation_id")


@query(f"""WITH {tg.SIGNALS}, v AS (SELECT least(floor(score * 10), 9)::INT AS bin FROM signals WHERE score >= 0 AND signal_kind = 'view')
SELECT bin, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM v), 6) AS pct FROM v GROUP BY bin""")
def score_distribution(spark, d):
    """A19 J18"""
    return comp.score_distribution(tg.signals(spark, d).filter("signal_kind = 'view'"))


@query(f"""WITH {tg.SIGNALS}, x AS (SELECT score AS raw, CASE WHEN score >= 0 THEN score END AS s FROM signals)
SELECT count(*) AS n, count(*) FILTER (raw < 0) AS errors, min(s) AS least, median(s) AS median, round(avg(s), 9) AS mean, max(s) AS greatest,
  {', '.join(f'count(*) FILTER (s <= {t}) AS at_most_{round(t * 100)}' for t in (0.1, 0.2, 0.33, 0.4, 0.5, 0.67, 0.9))} FROM x""")
def score_summary(spark, d):
    """A19"""
    return comp.score_summary(tg.signals(spark, d)).withColumn("mean", F.round("mean", 9))


@query(f"WITH {tg.SIGNALS} SELECT signal_id, CASE WHEN score < 0.33 THEN 'implausible' WHEN score < 0.67 THEN 'suspicious' ELSE 'plausible' END AS label FROM signals WHERE score >= 0")
def score_labels(spark, d):
    """C20"""
    return tg.signals(spark, d).filter("score >= 0").select("signal_id", names.score_label(F.col("score")).alias("label"))


@query(f"""{WITH_SCORED}, x AS (SELECT food, chem, premise, bool_or(low) AS low, bool_or(len(part) > 4) AS amb, max(conc) AS top FROM scored WHERE source = 'lit' GROUP BY food, chem, premise)
SELECT food, chem, count(*) FILTER (amb) AS n_ambiguous, count(*) FILTER (low) AS n_low, string_agg(premise, '|' ORDER BY top DESC, premise) AS ordered FROM x GROUP BY food, chem""")
def evidence_filtered(spark, d):
    """Badges and order of evidence"""
    s = _scored(spark, d).filter("source = 'lit'")
    x = F.struct(F.coalesce("score", F.lit(1.0)).alias("score"), (F.length("part") - 3).alias("candidates"), "conc")
    lists = s.groupBy("food", "chem", "premise").agg(F.collect_list(x).alias("extraction")).groupBy("food", "chem").agg(F.collect_list(F.struct("premise", "extraction")).alias("e"))
    flagged = comp.flag_evidence(lists, "e", F.lit(comp.LOW_TRUST))
    return flagged.select("food", "chem", F.col("n_ambiguous").cast("long"), F.col("n_low").cast("long"), F.array_join(F.transform(comp.order_evidence("e"), lambda e: e["premise"]), "|").alias("ordered"))


@query(f"""WITH {tg.CLAIMS}, {tg.CORRELATIONS}, h AS (SELECT DISTINCT chem, disease, rel FROM direct)
SELECT entity_id, count(*) AS associations FROM (SELECT food AS entity_id FROM (SELECT DISTINCT food, part FROM claims)
  UNION ALL SELECT part FROM (SELECT DISTINCT food, part FROM claims) UNION ALL SELECT chem FROM h UNION ALL SELECT disease FROM h) GROUP BY entity_id""")
def association_counts(spark, d):
    """A05"""
    pairs = tg.claims(spark, d).select("food", "part").distinct()
    corr = tg.correlations(spark, d).select("chem", "disease", "rel").distinct()
    return comp.association_counts((pairs, "food"), (pairs, "part"), (corr, "chem"), (corr, "disease"))


def _tokens(df: DataFrame) -> DataFrame:
    t = names.search_tokens(F.col("entity_type"), F.col("common_name"), F.col("scientific_name"), F.col("synonyms"), F.col("external_ids"))
    return df.withColumn("tokens", t).withColumn("token_text", F.array_join("tokens", "    "))


TOKENS = f"""{tg.ENTITIES}, tokens AS (SELECT entity_id, entity_type, common_name, list_transform(list_concat(list_concat([entity_type, common_name], synonyms),
  list_transform(ids, lambda x: CASE WHEN contains(x, '/') THEN split_part(x, '/', -1) ELSE x END)), lambda x: lower(x)) AS t FROM entities),
distinct_tokens AS (SELECT entity_id, any_value(common_name) AS name, string_agg(x, '    ' ORDER BY i) AS token_text FROM
  (SELECT entity_id, common_name, x, min(i) AS i FROM (SELECT entity_id, common_name, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tokens) GROUP BY ALL) GROUP BY entity_id)"""


@query(f"WITH {TOKENS} SELECT entity_id, token_text AS tokens FROM distinct_tokens")
def search_tokens(spark, d):
    """B15 C12"""
    return _tokens(tg.entities(spark, d)).select("entity_id", F.col("token_text").alias("tokens"))


def _gram_sql(text: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH {TOKENS}, {tg.CLAIMS}, a AS (SELECT entity_id, count(*) AS associations FROM (SELECT food AS entity_id FROM claims UNION ALL SELECT part FROM claims) GROUP BY 1),
f AS (SELECT entity_id, name, list_contains(string_split(token_text, '    '), 'red ring') AS exact, coalesce(associations, 0) AS associations,
  round(len(list_intersect({_gram_sql('name')}, {_gram_sql("'red ring'")}))::DOUBLE / len(list_distinct(list_concat({_gram_sql('name')}, {_gram_sql("'red ring'")}))), 6) AS similarity
  FROM distinct_tokens LEFT JOIN a USING (entity_id) WHERE contains(token_text, 'red ring'))
SELECT row_number() OVER (ORDER BY exact DESC, associations DESC, similarity DESC, entity_id) AS rank, * FROM f ORDER BY rank LIMIT 10""")
def search_ranked(spark, d):
    """O03 C17"""
    c = tg.claims(spark, d)
    e = _tokens(tg.entities(spark, d)).withColumn("name", F.col("common_name"))
    e = e.join(comp.association_counts((c, "food"), (c, "part")), "entity_id", "left").withColumn("associations", F.coalesce("associations", F.lit(0)))
    return comp.search(e, "red ring").select("rank", "entity_id", "name", "exact", "associations", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {tg.CLAIMS}, {tg.CORRELATIONS}, {tg.EDGES}, h AS (SELECT DISTINCT chem, disease, rel FROM direct), up(node) AS (
  SELECT DISTINCT disease FROM h UNION SELECT e.tail FROM up u JOIN edges e ON e.head = u.node)
SELECT 'foods' AS field, count(DISTINCT food) AS n FROM claims UNION ALL SELECT 'chemicals', count(DISTINCT part) FROM claims
UNION ALL SELECT 'diseases', count(*) FROM up
UNION ALL SELECT 'associations', (SELECT count(*) FROM (SELECT DISTINCT food, part FROM claims)) + (SELECT count(*) FROM h) + (SELECT count(*) FROM edges e WHERE e.head IN (SELECT node FROM up) AND e.tail IN (SELECT node FROM up))
UNION ALL SELECT 'publications', count(DISTINCT reference) FROM claims WHERE source = 'lit'""")
def graph_statistics(spark, d):
    """A06 J16 F19"""
    from ..operators import graph

    c = store(tg.claims(spark, d).select("food", "part", "source", "reference", "subject", "status"), "claims")
    corr = store(tg.correlations(spark, d, c).select("chem", "disease", "rel").distinct(), "correlations")
    e = store(tg.edges(spark, d), "edges")
    seeds = corr.select(F.col("disease").alias("node")).distinct()
    scope = store(seeds.unionByName(graph.ancestors_of_set(e, seeds)).distinct(), "scope")
    one = lambda field, df, expr: df.agg(expr.alias("n")).select(F.lit(field).alias("field"), "n")
    parts = c.select("food", "part").distinct().agg(F.count(F.lit(1)).alias("n")).unionByName(corr.agg(F.count(F.lit(1)).alias("n"))).unionByName(graph.edges_within(e, scope))
    out = one("foods", c, F.count_distinct("food"))
    for x in (one("chemicals", c, F.count_distinct("part")), one("diseases", scope, F.count(F.lit(1))), one("associations", parts, F.sum("n")), one("publications", c.filter("source = 'lit'"), F.count_distinct("reference"))):
        out = out.unionByName(x)
    return out


@query(f"""WITH RECURSIVE {tg.CLAIMS}, {tg.CORRELATIONS}, {tg.EDGES}, {tg.CLOSURE}, h AS (SELECT DISTINCT chem, disease, rel FROM direct),
eaten AS (SELECT DISTINCT part AS chem FROM claims WHERE source = 'lit'),
r AS (SELECT chem, chem AS source_chem, disease, rel FROM h UNION ALL SELECT anc, chem, disease, rel FROM h JOIN closure ON node = chem WHERE chem IN (SELECT chem FROM eaten))
SELECT r.chem, r.source_chem, r.disease, r.rel, e.sources, e.evidence_count FROM r JOIN (
  SELECT chem, disease, rel, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT reference) AS evidence_count FROM direct GROUP BY ALL) e
ON e.chem = r.source_chem AND e.disease = r.disease AND e.rel = r.rel""")
def correlation_rows(spark, d):
    """G05 A20 A26 J03"""
    return _correlation_rows(spark, d)


def _correlation_rows(spark, d) -> DataFrame:
    from ..operators import graph

    # three joins of whole tables, read once and used five times
    claims = store(tg.claims(spark, d).select("part", "source", "reference", "subject", "status"), "claims")
    corr = store(tg.correlations(spark, d, claims), "correlations")
    evidence = corr.groupBy(F.col("chem").alias("source_chem"), "disease", "rel").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("reference").alias("evidence_count"))
    evidence = store(evidence, "correlation-evidence")
    direct = evidence.select(F.col("source_chem").alias("chem"), "disease", "rel")
    closure = graph.ancestors(tg.edges(spark, d), direct.select(F.col("chem").alias("node")).distinct())
    eaten = claims.filter("source = 'lit'").select(F.col("part").alias("chem"))
    return graph.propagate_correlations(direct, closure, eaten).join(evidence, ["source_chem", "disease", "rel"]).select("chem", "source_chem", "disease", "rel", "sources", "evidence_count")


@query(f"""WITH {tg.CLAIMS}, {tg.CORRELATIONS}, x AS (SELECT disease, count(DISTINCT reference) AS evidence_count FROM direct WHERE chem = 'p12' AND rel = 'r4' GROUP BY disease)
SELECT * FROM (SELECT row_number() OVER (ORDER BY evidence_count DESC, disease) AS rank, disease, evidence_count FROM x) WHERE rank BETWEEN 1 AND 10""")
def correlation_page(spark, d):
    """O02"""
    x = tg.correlations(spark, d).filter("chem = 'p12' and rel = 'r4'").groupBy("disease").agg(F.count_distinct("reference").alias("evidence_count"))
    top = x.orderBy(F.desc("evidence_count"), "disease").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("evidence_count"), "disease")).alias("rank"), "disease", "evidence_count")


@query(f"""{WITH_COMPOSITION}, {CLASSES}, x AS (SELECT c.*, coalesce(k.classes, []) AS classes FROM composition c LEFT JOIN classes k USING (chem))
SELECT food, chem FROM x WHERE food = 's2' AND (list_has_any(classes, ['SMALL', 'PROMO']) OR len(classes) = 0)""")
def composition_by_class(spark, d):
    """class filter with n/a"""
    return _with_classes(spark, d).filter("food = 's2'").filter(comp.class_predicate(["SMALL", "PROMO", "n/a"])).select("food", "chem")


@query("SELECT 's' || s_suppkey AS entity_id, 'food' AS entity_type, lower(s_name) AS common_name FROM supplier WHERE lower(s_name) = 'supplier#000000007'")
def entity_metadata(spark, d):
    """F05"""
    return tg.entities(spark, d).filter("common_name = 'supplier#000000007'").select("entity_id", "entity_type", "common_name")


@query(f"WITH {tg.ENTITIES} SELECT entity_id, entity_type, common_name FROM entities WHERE entity_id IN ('p5', 's3', 'n2', 'p999999')")
def id_lookup(spark, d):
    """F17 F20"""
    wanted = spark.createDataFrame([("p5",), ("s3",), ("n2",), ("p999999",)], "entity_id string")
    return tg.entities(spark, d).join(F.broadcast(wanted), "entity_id", "left_semi").select("entity_id", "entity_type", "common_name")


@query(f"WITH {tg.CLAIMS} SELECT food, part, attestation_id FROM claims WHERE food = 's4' AND part = 'p104' UNION ALL SELECT food, part, attestation_id FROM claims WHERE food = 's5'")
def triplet_lookup(spark, d):
    """by both ends, by head"""
    c = tg.claims(spark, d).select("food", "part", "attestation_id")
    return c.filter("food = 's4' and part = 'p104'").unionByName(c.filter("food = 's5'"))


@query(f"WITH {tg.CLAIMS} SELECT attestation_id FROM claims WHERE (source LIKE 'li%' OR source LIKE 'dm%') AND unit = 'mg/100g' ORDER BY attestation_id LIMIT 50")
def signal_candidates(spark, d):
    """The first 50 candidates"""
    c = tg.claims(spark, d).filter((F.col("source").startswith("li") | F.col("source").startswith("dm")) & (F.col("unit") == "mg/100g"))
    return c.select("attestation_id").orderBy("attestation_id").limit(50)


@query(f"""WITH {tg.CLAIMS}, {tg.CORRELATIONS} SELECT part AS id, 'contained' AS role FROM claims GROUP BY part UNION ALL SELECT id, 'both' FROM (SELECT chem AS id FROM direct INTERSECT SELECT part FROM claims) UNION ALL SELECT disease, 'disease' FROM direct GROUP BY disease""")
def scope_ids(spark, d):
    """J13 U03 B14"""
    c, corr = tg.claims(spark, d).select(F.col("part").alias("id")), tg.correlations(spark, d)
    role = lambda df, r: df.distinct().withColumn("role", F.lit(r))
    return role(c, "contained").unionByName(role(corr.select(F.col("chem").alias("id")).intersect(c), "both")).unionByName(role(corr.select(F.col("disease").alias("id")), "disease"))


@query("""WITH m AS (SELECT l_suppkey, l_discount, round(avg(l_discount) OVER (PARTITION BY l_suppkey), 3) AS mean FROM lineitem)
SELECT l_suppkey AS supplier, round(max(l_discount), 3) AS greatest, min(mean) AS mean, round(sqrt(avg((l_discount - mean) ** 2)), 3) AS spread FROM m GROUP BY l_suppkey""")
def citation_stats(spark, d):
    """A24"""
    from ..operators import build

    return build.citation_summary(tg.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_discount").alias("score")), "supplier")
