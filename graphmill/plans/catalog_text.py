"""Scalar functions, literature text and models on the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims as cl
from ..functions import concentration, names
from ..operators import build, text
from ..sources import tables
from ..storage import store
from . import composition as comp
from . import testgraph as tg

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'beta-' || lower(p_name) WHEN 1 THEN lower(p_name) || ' "x"' WHEN 2 THEN 'alpha->gamma ' || lower(p_name) ELSE lower(trim(p_name)) END AS name FROM part""")
def greek_standardize(spark, d):
    """C01 C29"""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("β‐"), n)).when(k == 1, F.concat(F.lit(" "), n, F.lit(" “x”"))).when(k == 2, F.concat(F.lit("α→Γ "), F.upper(n))).otherwise(F.concat(n, F.lit("­")))
    return tg.table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.standardize_name(raw).alias("name"))


def _raw_concentrations(spark, d):
    """Texts of seven kinds built from quantities, one kind per line number."""
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    raw = F.when(n == 1, F.concat(q, F.lit(" mg/g"))).when(n == 2, F.concat(q, F.lit(" to 60 mg/100g fw"))).when(n == 3, F.concat(q, F.lit("±0.5 µg/g DW"))).when(n == 4, F.concat(F.lit("<"), q, F.lit(" mg/kg"))).when(n == 5, F.concat(q, F.lit("%"))).when(n == 6, F.concat(q, F.lit(" mmol/l"))).otherwise(F.lit("present"))
    return tg.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), raw.alias("raw"))


@query("""WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, l_linenumber AS n, l_quantity::INT::VARCHAR AS q FROM lineitem)
SELECT key, CASE n WHEN 1 THEN q WHEN 2 THEN q || '-60' WHEN 3 THEN q || '±0.5' WHEN 4 THEN '<' || q WHEN 5 THEN q WHEN 6 THEN q END AS value,
  CASE n WHEN 1 THEN 'mg/g' WHEN 2 THEN 'mg/100g fw' WHEN 3 THEN 'µg/g dw' WHEN 4 THEN 'mg/kg' WHEN 5 THEN '%' WHEN 6 THEN 'mmol/l' END AS unit FROM x""")
def conc_parse(spark, d):
    """C03"""
    return _raw_concentrations(spark, d).withColumn("c", concentration.parse(F.col("raw"))).select("key", "c.value", "c.unit")


@query("""WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT key, round(CASE n WHEN 1 THEN q * 100 WHEN 2 THEN (q + 60) / 2 WHEN 3 THEN q * 0.1 WHEN 4 THEN q * 0.1 END, 6) AS value, CASE WHEN n = 7 THEN 'bad_conc' WHEN n IN (5, 6) THEN 'unconverted' END AS error FROM x""")
def conc_convert(spark, d):
    """C04 C27"""
    x = concentration.converted(_raw_concentrations(spark, d), "raw")
    return x.select("key", F.round("conc_value", 6).alias("value"), F.when(F.col("conc").isNull(), "bad_conc").when(F.col("conc_value").isNull(), "unconverted").alias("error"))


def _string(c):
    return F.col(c).cast("string").alias(c)


LINES = "(berry, skin, n-{turn},5-acid|other, {conv} mg/g)\nplain words\n(x, , y{turn}, )"


def _responses(spark, d):
    c = tg.table(spark, d, "conversations").select("conv_id", "turn")
    r = F.replace(F.replace(F.lit(LINES), F.lit("{turn}"), F.col("turn").cast("string")), F.lit("{conv}"), (F.col("conv_id") + 1).cast("string"))
    return c.select("conv_id", "turn", r.alias("response"))


@query("""SELECT conv_id, turn, 'berry' AS food, 'skin' AS part, 'n-' || turn || ',5-acid' AS chemical, (conv_id + 1) || ' mg/g' AS quantity, CASE WHEN conv_id < 1000 THEN (conv_id + 1) * 100.0 END::DOUBLE AS conc_value FROM conversations
UNION ALL SELECT conv_id, turn, 'x', '', 'y' || turn, '', NULL FROM conversations""")
def claim_tuples(spark, d):
    """Claims of response lines"""
    good, _ = cl.claims(_responses(spark, d))
    return good.select("conv_id", "turn", "food", "part", "chemical", "quantity", F.round("conc_value", 6).alias("conc_value"))


@query("""SELECT conv_id, turn, 'plain words' AS line, 'bad_tuple' AS error FROM conversations UNION ALL SELECT conv_id, turn, '(berry, skin, n-' || turn || ',5-acid|other, ' || (conv_id + 1) || ' mg/g)', 'unconverted' FROM conversations WHERE conv_id >= 1000""")
def claim_errors(spark, d):
    """The error channel"""
    _, bad = cl.claims(_responses(spark, d))
    return bad.select("conv_id", "turn", "line", "error")


@query("""SELECT conv_id, turn, 'berry|skin|n-' || turn || '|5-acid|other, ' || (conv_id + 1) || ' mg/g;plain words|||;x||y' || turn || '|' AS fields FROM conversations""")
def response_fields(spark, d):
    """C26"""
    r = _responses(spark, d).withColumn("f", cl.response_fields(F.col("response")))
    return r.select("conv_id", "turn", F.array_join(F.transform("f", lambda x: F.array_join(x, "|")), ";").alias("fields"))


@query("""SELECT p_partkey AS id, p_brand || '|' || p_type || ',' || p_name AS items FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '' FROM part WHERE p_size % 2 = 1""")
def set_field(spark, d):
    """C06"""
    p = tg.table(spark, d, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("{"), "p_brand", F.lit(',"'), "p_type", F.lit(","), "p_name", F.lit('",}'))).otherwise(F.lit("{}"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(names.set_field(raw), "|").alias("items"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN 2 ELSE 0 END AS n, CASE WHEN p_size > 5 THEN p_partkey + p_size END AS total FROM part""")
def pipe_list(spark, d):
    """C09"""
    raw = F.when(F.col("p_size") > 5, F.concat_ws("|", "p_partkey", "p_size"))
    items = F.transform(names.pipe_list(raw), lambda x: x.try_cast("bigint"))
    return tg.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(items).alias("n"), F.when(F.size(items) > 0, F.aggregate(items, F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, try_cast(regexp_extract(url, '/(\d+)[^/]*$', 1) AS BIGINT) AS number, page_id AS chebi, page_id::VARCHAR AS tail FROM pages""")
def id_extract(spark, d):
    """C07 C08"""
    p = tg.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/(\d+)[^/]*$", 1), F.lit("")).try_cast("bigint").alias("number"), names.chebi_number(F.concat(F.lit("http://x/CHEBI_"), "page_id")).alias("chebi"), names.after_colon(names.pmc_number(F.concat(F.lit("PMCa:"), "page_id"))).alias("tail"))


@query("""SELECT p_partkey AS id, lower(p_name) AS label, p_name AS literal, p_brand AS bare FROM part""")
def label_cleaning(spark, d):
    """C07"""
    n = F.col("p_name")
    return tg.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(names.clean_label(F.concat(F.lit("CDNO: "), n, F.lit(" (food part)")))).alias("label"), names.strip_literal(F.concat(n, F.lit("@en^^x"))).alias("literal"), names.strip_brackets(F.concat(F.lit("<"), "p_brand", F.lit(">"))).alias("bare"))


@query("""SELECT 'p' || p_partkey AS id, 'chebi' AS key, 'ChEBI' AS display, 'https://www.ebi.ac.uk/chebi/searchId.do?chebiId=CHEBI:' || p_partkey AS url FROM part
UNION ALL SELECT 'p' || p_partkey, 'foodon', 'FoodOn', 'http://x.org/' || p_size FROM part""")
def external_id_format(spark, d):
    """C13"""
    e = tg.entities(spark, d).filter("entity_type = 'chemical'").select(F.col("entity_id").alias("id"), F.explode(names.format_external_ids(F.col("external_ids"))).alias("key", "v"))
    return e.select("id", "key", F.col("v.display_name").alias("display"), F.get("v.ids", 0)["url"].alias("url"))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events""")
def json_props(spark, d):
    """JSON text to columns and lists; what is no list is empty"""
    from ..sources.tables import fill_defaults

    e = tg.table(spark, d, "events")
    listed = F.from_json(F.when(F.col("event_id") % 2 == 0, F.lit('["a"]')).otherwise(F.lit('{"a":1}')), "array<string>")
    out = fill_defaults(e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.filter(listed, lambda x: ~x.startswith("{")).alias("l")))
    return out.select("event_id", "k", F.size("l").alias("n"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 OR value > 100 THEN -1.0 ELSE value / 100 END AS score,
 CASE WHEN event_id % 5 = 0 THEN 'timeout' WHEN event_id % 5 = 1 THEN 'schema: no score' WHEN value > 100 THEN 'schema: score out of range' ELSE '' END AS error FROM events""")
def judge_validate(spark, d):
    """C25"""
    e = tg.table(spark, d, "events")
    k = F.col("event_id") % 5
    reply = F.when(k == 1, F.lit("not json")).otherwise(F.to_json(F.struct((F.col("value") / 100).alias("score"), F.lit("fine").alias("reason"))))
    v = cl.judge_reply(reply, F.when(k == 0, F.lit("timeout")))
    return e.select(F.col("event_id").alias("id"), v.alias("v")).select("id", "v.score", F.col("v.error_text").alias("error"))


@query("""SELECT doc_id AS id, 'r' || (row_number() OVER (ORDER BY doc_id) - 1) AS custom_id, length('Judge ' || source || ' in ' || lang) AS prompt_chars FROM documents""")
def request_render(spark, d):
    """The position comes from ranges of ids, not from one sorted task"""
    docs = tg.table(spark, d, "documents").select("doc_id", "source", "lang")
    numbered = build.assign_ids(docs, ["doc_id"], -1).withColumn("custom_id", F.concat(F.lit("r"), F.substring("entity_id", 2, 20)))
    prompt = cl.render("Judge {source} in {lang}", source=F.col("source"), lang=F.col("lang"))
    body = numbered.select("doc_id", cl.request(F.col("custom_id"), "any", prompt).alias("request"))
    return body.select(F.col("doc_id").alias("id"), F.get_json_object("request", "$.custom_id").alias("custom_id"), F.length(F.get_json_object("request", "$.body.messages[0].content")).alias("prompt_chars"))


SENTENCES = r"""sentences AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')) AS sentence FROM documents)"""


@query(f"WITH {SENTENCES} SELECT doc_id AS doc, count(*) FILTER (length(sentence) BETWEEN 20 AND 1000) AS n_sentences, count(*) AS n_all FROM sentences GROUP BY doc_id")
def sentence_filter(spark, d):
    """F09 X04"""
    s = text.sentences(tg.table(spark, d, "documents"), "text", ["doc_id"])
    return s.groupBy(F.col("doc_id").alias("doc")).agg(F.count_if(text.usable(F.col("sentence"))).alias("n_sentences"), F.count(F.lit(1)).alias("n_all"))


def _benchmark_terms(spark, d):
    """Runs of four words, over the whole text of every item."""
    b = tg.table(spark, d, "benchmark").select(F.split(F.regexp_replace("text", r"[.,!?]", ""), r"\s+").alias("w"))
    return b.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(4)), lambda k: F.array_join(F.slice("w", k, 4), " "))).alias("term"))


@query()
def term_match(spark, d):
    """Best term per usable sentence"""
    s = text.sentences(tg.table(spark, d, "documents"), "text", ["doc_id"]).filter(text.usable(F.col("sentence")))
    keyed = s.select(F.concat_ws("-", "doc_id", "sentence_no").alias("key"), "sentence")
    m = text.match_terms(keyed, _benchmark_terms(spark, d), "key")
    return m.select(F.substring_index("key", "-", 1).cast("long").alias("doc"), F.substring_index("key", "-", -1).cast("int").alias("sentence_no"), "term", "score")


@query()
def vocab_match(spark, d):
    """Distinct misspelt names against the vocabulary"""
    p = tg.table(spark, d, "part")
    raw = p.select(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.upper("p_name")).alias("raw"))
    return text.match_vocabulary(raw, p.select(F.col("p_name").alias("term")))


_SPELT = "lower(replace(replace(replace(replace({}, 'β', 'beta'), 'Γ', 'gamma'), 'γ', 'gamma'), '–', '-'))"


@query(f"""WITH m AS (SELECT o.p_partkey AS id, ['β-', 'beta–', 'Γ-', 'gamma-', ''][1 + o.p_partkey % 5] || upper(o.p_name) AS a, ['gamma–', 'Beta-', '', 'γ-', 'β–'][1 + n.p_partkey % 5] || n.p_name AS b
  FROM part o JOIN (SELECT p_name, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL) n ON o.p_size = n.p_size)
SELECT id, count(*) AS met, count(*) FILTER ({_SPELT.format('a')} = {_SPELT.format('b')}) AS same FROM m GROUP BY id""")
def greek_match(spark, d):
    """How many names of a size are equal to a part's up to the spelling of Greek letters and dashes"""
    p = tg.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    spell = lambda forms, key: F.get(F.array(*map(F.lit, forms)), (F.col(key) % 5).cast("int"))
    one = p.select("p_size", F.col("p_partkey").alias("id"), names.standardize_name(F.concat(spell(("β-", "beta–", "Γ-", "gamma-", ""), "p_partkey"), F.upper("p_name"))).alias("name"))
    two = p.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("k")).select("p_size", F.concat(spell(("gamma–", "Beta-", "", "γ-", "β–"), "k"), "p_name").alias("b"))
    # each name is spelt out once; equal ones are counted by size and met by equality, so no pair is made
    met = two.groupBy("p_size").agg(F.count(F.lit(1)).alias("met"))
    same = two.groupBy("p_size", names.standardize_name(F.col("b")).alias("name")).agg(F.count(F.lit(1)).alias("same"))
    return one.join(met, "p_size").join(same, ["p_size", "name"], "left").groupBy("id").agg(F.sum("met").alias("met"), F.sum(F.coalesce("same", F.lit(0))).alias("same"))


@query("""SELECT trim(u.t) AS term, count(*) AS n FROM part, unnest(string_split(p_name || ', ' || p_type || ',', ',')) AS u(t) WHERE trim(u.t) <> '' GROUP BY 1""")
def listed_terms(spark, d):
    """Comma lists of terms"""
    p = tg.table(spark, d, "part").select(F.concat_ws(",", F.concat("p_name", F.lit(", "), "p_type"), F.lit("")).alias("list"))
    return tables.split_terms(p, "list").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id AS doc, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality >= 1 AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def threshold_unseen(spark, d):
    """F10 J12 T03"""
    labels = tg.table(spark, d, "labels")
    rows = tg.table(spark, d, "documents").select("doc_id").join(labels, "doc_id").filter("quality >= 1")
    return text.unseen(rows, labels.filter("toxic = 1"), ["doc_id"]).select(F.col("doc_id").alias("doc"), "quality")


@query("SELECT max(ts)::DATE::VARCHAR AS low FROM events WHERE event_type <> 'error'")
def incremental_low(spark, d):
    """T02"""
    e = tg.table(spark, d, "events").select(F.to_date("ts").alias("run_date"), (F.col("event_type") != "error").alias("finished"))
    return text.since(e, "1900-01-01").select(_string("low"))


@query("""WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'm' || o_custkey END AS pmid, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 7 = 0 THEN 'wrong' END AS pmcid FROM orders)
SELECT k, coalesce(pmid, CASE WHEN c1.c_custkey IS NOT NULL THEN 'm' || substr(pmcid, 2) END) AS pmid, coalesce(pmcid, CASE WHEN c2.c_custkey IS NOT NULL THEN 'c' || substr(pmid, 2) END) AS pmcid, coalesce(pmcid = 'wrong', false) AS violation
FROM x LEFT JOIN customer c1 ON pmcid = 'c' || c1.c_custkey LEFT JOIN customer c2 ON pmid = 'm' || c2.c_custkey""")
def id_reconcile(spark, d):
    """J21"""
    k = F.col("o_orderkey")
    rows = tg.table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 != 0, F.concat(F.lit("m"), "o_custkey")).alias("pmid"), F.when(k % 3 == 0, F.concat(F.lit("c"), "o_custkey")).when(k % 7 == 0, "wrong").alias("pmcid"))
    pairs = tg.table(spark, d, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("pmid"), F.concat(F.lit("c"), "c_custkey").alias("pmcid"))
    good, bad = text.reconcile_ids(rows, pairs)
    mark = lambda df, v: df.withColumn("violation", F.lit(v)).select("k", "pmid", "pmcid", "violation")
    return mark(good, False).unionByName(mark(bad, True))


@query("SELECT user_id AS pmid, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS queries FROM events GROUP BY user_id")
def query_merge(spark, d):
    """A21 S20"""
    e = tg.table(spark, d, "events").select(F.col("user_id").alias("pmid"), F.lit("").alias("pmcid"), F.col("event_type").alias("query"))
    return text.merge_queries(e).select("pmid", F.array_join("queries", ",").alias("queries"))


@query("""SELECT p_partkey AS id, CASE WHEN p_retailprice / 734567.0 = 0 THEN '0' WHEN p_retailprice / 734567.0 < 0.01 THEN printf('%.2e', p_retailprice / 734567.0) ELSE printf('%.2f', p_retailprice / 734567.0) END AS small, printf('%.2f', p_retailprice) AS price, replace(lower(p_name), ' ', '--') AS slug FROM part""")
def number_format(spark, d):
    """C28"""
    p = tg.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), names.concise_number(F.col("p_retailprice") / 734567.0).alias("small"), names.concise_number(F.col("p_retailprice")).alias("price"), names.slug(F.col("p_name")).alias("slug"))


@query("""SELECT p_partkey AS id, p_name || ',' || p_brand AS shown FROM part""")
def display_synonyms(spark, d):
    """Cut at the first plural of its predecessor"""
    n = names.display_synonyms(F.array(F.col("p_name"), F.col("p_brand"), names.plural(F.col("p_brand")), F.lit("never")))
    return tg.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(n, ",").alias("shown"))


@query(f"""WITH {tg.CLAIMS} SELECT attestation_id, CASE WHEN source = 'lit' THEN part ELSE 'entity ' || food END AS shown, conc::INT || ' ' || unit AS raw, 'https://pubmed.ncbi.nlm.nih.gov/' || subject AS url FROM claims""")
def display_names(spark, d):
    """C14 C16"""
    c = tg.claims(spark, d)
    pub = names.publication(F.col("subject").cast("string"), F.lit(None).cast("string"))
    return c.select("attestation_id", names.display_name(F.col("source"), F.col("part"), F.concat(F.lit("entity "), "food")).alias("shown"), names.raw_concentration(F.col("conc").cast("int").cast("string"), F.col("unit")).alias("raw"), pub["url"].alias("url"))


@query("SELECT doc_id AS doc, round(least(1.0, length(text) / 5000.0), 9) AS p FROM documents")
def batch_scores(spark, d):
    """An injected model over batches"""

    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc": batch["doc_id"], "p": (batch["text"].str.len() / 5000.0).clip(upper=1.0).round(9)})

        return model

    return text.score_batches(tg.table(spark, d, "documents").select("doc_id", "text"), "doc long, p double", load)


def _classified(spark, d):
    docs, labels = tg.table(spark, d, "documents"), tg.table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("key"), "text", F.col("quality").cast("double").alias("label"))


@query()
def classifier_metrics(spark, d):
    """Held-out metrics of the quality classifier"""
    _, out = text.train_classifier(_classified(spark, d))
    return out


@query()
def classifier_scores(spark, d):
    """Every document scored"""
    from pyspark.ml.functions import vector_to_array

    model, _ = text.train_classifier(_classified(spark, d))
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return model.transform(docs).select("doc", F.get(vector_to_array("probability"), 1).alias("p"))


@query(f"""WITH {tg.CLAIMS}, usual AS (SELECT chem, quantile_cont(conc, 0.05) AS lo, quantile_cont(conc, 0.95) AS hi FROM claims WHERE unit = 'mg/100g' GROUP BY chem)
SELECT chem, count(*) AS n, count(*) FILTER (conc BETWEEN lo AND hi) AS n_high, round(min(CASE WHEN conc < lo THEN 0.5 * conc / lo WHEN conc > hi THEN 0.5 * hi / conc ELSE 1 END), 6) AS lowest
FROM claims JOIN usual USING (chem) WHERE source = 'lit' AND unit = 'mg/100g' GROUP BY chem""")
def judge_stage(spark, d):
    """Select, render, score, validate, merge; the judge knows what is usual of each chemical from all claims"""
    from ..schemas import TRUST_SIGNALS

    c = store(tg.claims(spark, d).filter("unit = 'mg/100g'").select("attestation_id", "source", "food", "chem", "conc"), "claims")
    att = c.select("attestation_id", "source", F.col("food").alias("head_name_raw"), F.col("chem").alias("tail_name_raw"), F.col("conc").alias("conc_value"))
    usual = c.groupBy("chem").agg(F.percentile("conc", [0.05, 0.95]).alias("q"))
    if usual.count() > text.BROADCAST_TOKENS:
        raise ValueError("too many chemicals for a judge that every task holds")
    known = spark.sparkContext.broadcast({r.chem: tuple(r.q) for r in usual.collect()})

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        parts = batch["prompt"].str.extract(r"^Is (?P<value>[-+.\dE]+) mg of (?P<chem>.*) in 100 g of .* plausible\?$")

        def score(chem: str, value: float) -> float:
            lo, hi = known.value[chem]
            return 0.5 * value / lo if value < lo else 0.5 * hi / value if value > hi else 1.0

        replies = ['{"score": %.9f, "reason": "against the usual range"}' % score(k, float(v)) for k, v in zip(parts["chem"], parts["value"])]
        return pd.DataFrame({"attestation_id": batch["attestation_id"], "reply": replies, "error": None})

    out = text.judge(att, spark.createDataFrame([], TRUST_SIGNALS), ["lit"], scorer, "Is {value} mg of {tail} in 100 g of {head} plausible?", "judge", "v1", "h")
    named = out.join(c.select("attestation_id", "chem"), "attestation_id")
    return named.groupBy("chem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0.5).alias("n_high"), F.round(F.min("score"), 6).alias("lowest"))


@query("SELECT doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 3")
def first_per_group(spark, d):
    """W05"""
    w = Window.partitionBy("lang").orderBy("doc_id")
    return tg.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query(f"WITH {tg.CLAIMS} SELECT attestation_id, len(part)::BIGINT - 1 + 0 AS n FROM claims WHERE len(part) > 3 AND source = 'dmd'")
def ambiguous_attestations(spark, d):
    """more than one candidate at either end"""
    c = tg.claims(spark, d).filter("source = 'dmd'").select("attestation_id", F.array("food").alias("head_candidates"), F.filter(F.split("part", ""), lambda x: x != "p").alias("tail_candidates"))
    out = build.ambiguous_attestations(c.withColumn("tail_candidates", F.when(F.size("tail_candidates") > 2, F.col("tail_candidates")).otherwise(F.array(F.lit("x")))))
    return out.select("attestation_id", F.size("tail_candidates").cast("long").alias("n"))


@query(f"""WITH {tg.CLAIMS} SELECT food, chem, count(DISTINCT source) FILTER (source <> 'lit') + count(DISTINCT coalesce(premise, '')) FILTER (source = 'lit') AS n FROM claims GROUP BY food, chem""")
def evidence_count(spark, d):
    """Lengths of nested arrays, null as 0"""
    e = comp.evidence_lists(tg.claims(spark, d))
    return e.select("food", "chem", comp.evidence_count(*comp.SOURCES).cast("long").alias("n"))
