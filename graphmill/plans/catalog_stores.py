"""Stored indexes and versions, upkeep of derived tables, learnt sentence boundaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves, ledger, pages, reach, releases, search, select, sentences
from ..sources import keyfilter, versions
from ..storage import work_path
from . import catalog_query as cq
from . import composition as comp
from . import testgraph as tg

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


TERMS_SQL = """terms AS (SELECT DISTINCT lower(x) AS term FROM (
  SELECT unnest(string_split(p_name, ' ')) AS x FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT substr(p_type, 2, 4) FROM part UNION ALL SELECT substr(s_name, 16) FROM supplier
  UNION ALL SELECT n_name FROM nation UNION ALL SELECT right(p_name, 2) FROM part UNION ALL SELECT 'no such name') WHERE x <> '')"""


@query(f"""WITH {cq.TOKENS}, {tg.CLAIMS}, {TERMS_SQL}, a AS (SELECT entity_id, count(*) AS associations FROM (SELECT food AS entity_id FROM claims UNION ALL SELECT part FROM claims) GROUP BY 1),
f AS (SELECT term, entity_id, name, list_contains(string_split(token_text, '    '), term) AS exact, coalesce(associations, 0) AS associations,
  round(len(list_intersect({cq._gram_sql('name')}, {cq._gram_sql('term')}))::DOUBLE / len(list_distinct(list_concat({cq._gram_sql('name')}, {cq._gram_sql('term')}))), 6) AS similarity
  FROM distinct_tokens JOIN terms ON contains(token_text, term) LEFT JOIN a USING (entity_id))
SELECT term, rank, entity_id, name, exact, associations, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY exact DESC, associations DESC, similarity DESC, entity_id) AS rank FROM f) WHERE rank BETWEEN 6 AND 10""")
def search_index(spark, d):
    """The second page of five for every word, name and stretch of names, from the stored index"""
    c = tg.claims(spark, d)
    e = cq._tokens(tg.entities(spark, d)).withColumn("name", F.col("common_name"))
    e = e.join(comp.association_counts((c, "food"), (c, "part")), "entity_id", "left")
    root = work_path(spark, "search-index")
    seen = search.build_index(e, root)
    part, s = tg.table(spark, d, "part"), tg.table(spark, d, "supplier")
    words = part.select(F.explode(F.array_union(F.split("p_name", " "), F.array("p_name", F.substring("p_type", 2, 4), F.expr("right(p_name, 2)")))).alias("term"))
    terms = words.union(s.select(F.expr("substr(s_name, 16)"))).union(tg.table(spark, d, "nation").select("n_name")).union(spark.createDataFrame([("no such name",)], "term string"))
    return search.search_index(spark, root, terms, 5, 2, seen).withColumn("similarity", F.round("similarity", 6))


def _sentences_sql() -> str:
    """The learnt boundaries in SQL, by the same formulas."""
    core = "regexp_replace(x, '^[\"''(\\[{«“‘]+|[\"'')\\]}»”’\\s]+$', '', 'g')"
    base = lambda c: f"CASE WHEN regexp_matches(lower(regexp_replace({c}, '\\.$', '')), '^[+-]?[0-9][0-9.,/-]*$') THEN '##' ELSE lower(regexp_replace({c}, '\\.$', '')) END"
    log = lambda x: f"ln(greatest({x}, 1e-12))"
    fit = lambda k, n, q: f"({k} * {log(q)} + ({n} - {k}) * {log(f'1 - {q}')})"

    def collocation(one, two, both, total):
        p, p1, p2 = f"({two} / {total})", f"({both} / {one})", f"(({two} - {both}) / greatest({total} - {one}, 1))"
        return f"CASE WHEN {p1} > {p} THEN -2 * ({fit(both, one, p)} + {fit(f'({two} - {both})', f'({total} - {one})', p)} - {fit(both, one, p1)} - {fit(f'({two} - {both})', f'({total} - {one})', p2)}) ELSE 0 END"

    letters = "length(replace(base, '.', ''))"
    dots, ellipsis = "(regexp_matches(core, '.\\.$') OR regexp_matches(core, '…$'))", "regexp_matches(core, '\\.\\.$|…$')"
    initial = "regexp_matches(base, '^\\p{L}$')"
    return f"""
WITH pieces AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+\\s*') AS l FROM documents)),
cores AS (SELECT doc_id, pos, x, {core} AS core FROM pieces),
words AS MATERIALIZED (
  SELECT doc_id, pos, x, core, {base('core')} AS base, {dots} AS dot, {ellipsis} AS ellipsis, {base('nxt')} AS word, regexp_matches(nxt, '^\\p{{Lu}}') AS upper, regexp_matches(nxt, '^\\p{{Ll}}') AS lower, nxt
  FROM (SELECT *, lead(core) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM cores)),
counts AS MATERIALIZED (SELECT base, count(*) FILTER (dot)::DOUBLE AS dots, count(*) FILTER (NOT dot)::DOUBLE AS plain FROM words GROUP BY base),
totals AS (SELECT sum(dots + plain) AS total, sum(dots) AS all_dots FROM counts),
abbreviations AS MATERIALIZED (
  SELECT base FROM counts, totals WHERE dots >= {sentences.LEAST_SEEN} AND base <> '##' AND regexp_matches(base, '\\p{{L}}')
  AND -2 * (dots * {log('all_dots / total')} + plain * {log('1 - all_dots / total')} - dots * ln(0.99) - plain * ln(0.01)) * exp(-{letters}) * (length(base) - {letters} + 1) * pow(greatest({letters}, 1), -plain) >= {sentences.ABBREVIATION_SCORE}),
marked AS MATERIALIZED (
  SELECT w.*, a.base IS NOT NULL AS abbreviated, (regexp_matches(core, '[.!?…]$') AND NOT dot) OR (dot AND NOT ellipsis AND a.base IS NULL) AS ended, {initial.replace('base', 'w.base')} AS initial
  FROM words w LEFT JOIN abbreviations a ON w.base = a.base WHERE nxt IS NOT NULL),
counted AS MATERIALIZED (
  SELECT word, count(*)::DOUBLE AS n, count(*) FILTER (ended)::DOUBLE AS after_end, count(*) FILTER (lower) > 0 AS lower, count(*) FILTER (upper AND NOT ended AND NOT dot) > 0 AS upper_mid FROM marked GROUP BY word),
sums AS (SELECT sum(after_end) AS breaks, sum(n) AS every FROM counted),
vocabulary AS (
  SELECT word, lower, upper_mid, regexp_matches(word, '\\p{{L}}') AND NOT regexp_matches(word, '^\\p{{L}}$') AND after_end > 0 AND {collocation('breaks', 'n', 'after_end', 'every')} > {sentences.STARTER_SCORE} AS starter FROM counted, sums),
collocations AS (
  SELECT p.base, p.word FROM (SELECT base, word, count(*)::DOUBLE AS together FROM marked WHERE dot AND (abbreviated OR base = '##' OR initial) GROUP BY ALL HAVING count(*) > 1) p
  JOIN counts c ON p.base = c.base JOIN counted k ON p.word = k.word, sums WHERE c.dots > 0 AND {collocation('dots', 'n', 'together', 'every')} > {sentences.COLLOCATION_SCORE}),
joints AS (
  SELECT doc_id, pos FROM marked m LEFT JOIN vocabulary v ON m.word = v.word LEFT JOIN collocations c ON m.base = c.base AND m.word = c.word
  WHERE dot AND (abbreviated OR m.base = '##' OR initial OR ellipsis) AND (c.base IS NOT NULL
    OR ((abbreviated OR initial OR ellipsis) AND NOT (upper AND (v.starter OR (v.lower AND NOT v.upper_mid)))) OR (m.base = '##' AND (m.lower OR m.word = '##')))),
stops AS (SELECT w.doc_id, w.pos, w.x, regexp_matches(core, '[.!?…]$') AND j.pos IS NULL AS stop FROM words w LEFT JOIN joints j ON w.doc_id = j.doc_id AND w.pos = j.pos),
numbered AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM stops)
SELECT doc_id AS doc, no::INT AS sentence_no, regexp_replace(string_agg(x, '' ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS sentence FROM numbered GROUP BY doc_id, no"""


@query(_sentences_sql())
def sentence_boundaries(spark, d):
    """Boundaries learnt from all documents, then applied to them"""
    docs = tg.table(spark, d, "documents").select("doc_id", "text")
    return sentences.split_sentences(docs, "text", ["doc_id"], sentences.learn(docs)).withColumnRenamed("doc_id", "doc")


@query("""SELECT 'part' AS "table", 2 AS version, count(*) AS n, sum(p_size)::BIGINT AS total FROM part WHERE p_size <> 7 UNION ALL SELECT 'supplier', 2, count(*), sum(s_nationkey)::BIGINT FROM supplier
UNION ALL SELECT 'part', 1, count(*), sum(p_size)::BIGINT FROM part UNION ALL SELECT 'supplier', 1, count(*), sum(s_suppkey)::BIGINT FROM supplier""")
def release_tables(spark, d):
    """Two releases of two tables, each published as a whole, after one that dies half-way"""
    root, p, s = work_path(spark, "release"), tg.table(spark, d, "part"), tg.table(spark, d, "supplier")
    one = versions.publish_tables({"part": p.select(F.col("p_size").cast("long").alias("v")), "supplier": s.select(F.col("s_suppkey").alias("v"))}, root, "1")
    versions.write_parts(p.select(F.lit(0).cast("long").alias("v")), root)  # left behind by a release that never came to be
    two = versions.publish_tables({"part": p.filter("p_size <> 7").select(F.col("p_size").cast("long").alias("v")), "supplier": s.select(F.col("s_nationkey").cast("long").alias("v"))}, root, "2")
    out = None
    for seen in (one, two):
        for name in ("part", "supplier"):
            x = versions.read(spark, root, name, "v long", versions.snapshot(spark, root, seen.number)).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
            x = x.select(F.lit(name).alias("table"), F.lit(int(seen.note)).alias("version"), "n", "total")
            out = x if out is None else out.unionByName(x)
    return out


FINAL_EDGES = """final AS (SELECT * FROM edges WHERE NOT (head LIKE 'p%' AND tail LIKE 't:S%') UNION SELECT 'n' || n_nationkey, 'coast' FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'coast', 'chem')"""


@query(f"""WITH RECURSIVE {tg.EDGES}, {FINAL_EDGES}, closure(node, anc) AS (SELECT head, tail FROM final UNION SELECT c.node, e.tail FROM closure c JOIN final e ON e.head = c.anc) SELECT node, anc FROM closure""")
def closure_upkeep(spark, d):
    """A stored closure after edges of three kinds were deleted and others inserted, in two versions"""
    root, e = work_path(spark, "closure"), tg.edges(spark, d)
    reach.create_closure(e, root)
    none = spark.createDataFrame([], reach.EDGES)
    gone = e.filter("head like 'p%' and tail like 't:S%'")
    reach.change_closure(spark, root, spark.createDataFrame([("coast", "chem")], reach.EDGES), gone)
    coast = tg.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("head"), F.lit("coast").alias("tail"))
    reach.change_closure(spark, root, coast, none)
    return reach.read_closure(spark, root)


@query(f"""WITH RECURSIVE {tg.EDGES}, {tg.CLOSURE}, asked AS (SELECT 'p' || l_partkey AS node, 'b:' || p_brand AS anc FROM lineitem JOIN part ON p_partkey = l_suppkey UNION SELECT 's' || l_suppkey, 'r' || (l_linenumber % 5) FROM lineitem
  UNION SELECT 'p' || l_partkey, 'chem' FROM lineitem UNION SELECT 'p' || l_partkey, 't:' || p_type FROM lineitem JOIN part ON p_partkey = l_suppkey UNION SELECT 'b:' || p_brand, 't:' || p_type FROM part)
SELECT a.node, a.anc, c.node IS NOT NULL AS below FROM asked a LEFT JOIN closure c ON a.node = c.node AND a.anc = c.anc""")
def reach_labels(spark, d):
    """Is one node below another, decided by labels and without pairs"""
    e, li, part = tg.edges(spark, d), tg.table(spark, d, "lineitem"), tg.table(spark, d, "part")
    named = li.join(part, F.col("p_partkey") == F.col("l_suppkey"))
    me, seller = F.concat(F.lit("p"), "l_partkey").alias("node"), F.concat(F.lit("s"), "l_suppkey").alias("node")
    asked = named.select(me, F.concat(F.lit("b:"), "p_brand").alias("anc")).union(named.select(me, F.concat(F.lit("t:"), "p_type"))).union(li.select("l_partkey").distinct().select(me, F.lit("chem"))).union(li.select("l_suppkey", (F.col("l_linenumber") % 5).cast("string").alias("r")).distinct().select(seller, F.concat(F.lit("r"), "r"))).union(part.select(F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("t:"), "p_type")))
    return reach.is_below(asked, e, reach.reach_labels(e))


@query("""WITH x AS (SELECT 'flag ' || l_returnflag || l_linestatus AS key, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'part ' || l_partkey, l_extendedprice FROM lineitem UNION ALL SELECT 'all', CASE WHEN l_linenumber < 7 THEN l_discount END FROM lineitem)
SELECT key, median(v) AS median FROM x GROUP BY key""")
def group_medians(spark, d):
    """Exact medians of large and small groups together, the large ones by selection"""
    li = tg.table(spark, d, "lineitem")
    flag = li.select(F.concat(F.lit("flag "), "l_returnflag", "l_linestatus").alias("key"), F.col("l_extendedprice").alias("v"))
    rows = flag.union(li.select(F.concat(F.lit("part "), "l_partkey"), "l_extendedprice")).union(li.select(F.lit("all"), F.when(F.col("l_linenumber") < 7, F.col("l_discount"))))
    return select.group_medians(rows, ["key"], "v", 2000)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank, count(*) OVER () AS total, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)
SELECT rank, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE (rank - 1) // 10 IN (0, total // 20 - 1, (total - 1) // 10)""")
def deep_pages(spark, d):
    """The first, the middle and the last page of ten, each from the parts that hold it"""
    li, root = tg.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), work_path(spark, "pages")
    pages.build_order(li, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], root, 5000)
    held = pages.Order(spark, root, li.schema)
    wanted = sorted({1, held.total // 20, (held.total - 1) // 10 + 1})
    out = None
    for number in wanted:
        x = held.page(number, 10).select("rank", "l_orderkey", "l_linenumber", "l_extendedprice")
        out = x if out is None else out.unionByName(x)
    return out


@query("""WITH new AS (SELECT p_partkey, CASE WHEN p_size = 3 THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_name FROM part WHERE p_size <> 7 UNION ALL SELECT 1000000000 + s_suppkey, s_acctbal, s_name FROM supplier)
SELECT coalesce(o.p_partkey, n.p_partkey) AS id, CASE WHEN o.p_partkey IS NULL THEN 'new' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM part o FULL JOIN new n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_retailprice <> n.price""")
def release_digests(spark, d):
    """New, removed and changed rows of two releases, read from the buckets whose digests differ"""
    root, part, s = work_path(spark, "digests"), tg.table(spark, d, "part"), tg.table(spark, d, "supplier")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))
    new = part.filter("p_size <> 7").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 3, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_name").alias("name"))
    new = new.union(s.select(F.col("s_suppkey") + 1000000000, "s_acctbal", "s_name"))
    one, two = releases.write_release(old, ["id"], root, 256, "old"), releases.write_release(new, ["id"], root, 256, "new")
    return releases.diff_releases(spark, root, ["id"], "id long, price double, name string", one, two)


WORDS_SQL = """labelled AS (SELECT d.doc_id, quality AS label, ('0x' || substr(md5(text), 1, 8))::BIGINT % 4 AS fold, text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
words AS (SELECT doc_id, label, fold, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS word FROM labelled),
counts AS (SELECT word, fold, sum(label) AS pos, sum(1 - label) AS neg FROM words GROUP BY ALL), sums AS (SELECT word, sum(pos) AS tp, sum(neg) AS tn FROM counts GROUP BY word),
folds AS (SELECT fold, sum(label) AS pos, sum(1 - label) AS neg FROM labelled GROUP BY fold), total AS (SELECT sum(pos) AS p, sum(neg) AS n FROM folds)"""


def _labelled(spark, d):
    docs, labels = tg.table(spark, d, "documents").select("doc_id", "text"), tg.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.filter("text is not null").join(labels, "doc_id").withColumn("fold", curves.fold_of(F.col("text"), 4))


@query(f"""WITH {WORDS_SQL}, around AS (SELECT fold, p - pos AS p, n - neg AS n FROM folds, total),
weights AS (SELECT word, a.fold, ln((tp - coalesce(pos, 0) + 1) / (p + 2)) - ln((tn - coalesce(neg, 0) + 1) / (n + 2)) AS weight FROM sums JOIN around a ON true LEFT JOIN counts c USING (word, fold)
  WHERE tp - coalesce(pos, 0) + tn - coalesce(neg, 0) >= 5),
scored AS (SELECT l.doc_id, any_value(label) AS label, round(any_value(ln(p + 1) - ln(n + 1)) + coalesce(8 * avg(weight), 0), 9) AS score FROM labelled l JOIN around a ON l.fold = a.fold
  LEFT JOIN (SELECT doc_id, weight FROM words w JOIN weights USING (word, fold)) k ON l.doc_id = k.doc_id GROUP BY l.doc_id),
t AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored GROUP BY score),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(neg * (tp - pos / 2)) / max(positives * negatives), 9) AS auc, round(sum(pos * tp / (tp + fp)) / max(positives), 9) AS average_precision, round(max(2 * tp / (tp + fp + positives)), 9) AS best_f1,
  max(positives + negatives)::BIGINT AS n, max(positives)::BIGINT AS positives FROM u""")
def classifier_curve(spark, d):
    """Measures over all thresholds of the quality classifier, each document scored by the folds that hold no copy of it"""
    rows = _labelled(spark, d)
    weights, priors = curves.word_weights(*curves.word_counts(rows), 5, True)
    scored = curves.bayes_scores(rows, "doc_id", weights, priors).withColumn("score", F.round("score", 9)).join(rows.select("doc_id", "label"), "doc_id")
    found = curves.score_curve(scored)
    return found.select(*(F.round(c, 9).alias(c) for c in ("auc", "average_precision", "best_f1")), "n", "positives")


BAYES_SQL = f"""{WORDS_SQL}, weights AS (SELECT word, ln((tp + 1) / (p + 2)) - ln((tn + 1) / (n + 2)) AS weight FROM sums, total WHERE tp + tn >= 5),
known AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS word FROM documents)
SELECT d.doc_id AS doc, round(any_value(ln(p + 1) - ln(n + 1)) + coalesce(8 * avg(weight), 0), 6) AS score
FROM documents d JOIN total ON true LEFT JOIN (SELECT doc_id, weight FROM known JOIN weights USING (word)) k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


@query(f"WITH {BAYES_SQL}")
def bayes_scores(spark, d):
    """Every document scored by a model of word odds trained on the labels"""
    weights, priors = curves.word_weights(*curves.word_counts(_labelled(spark, d)), 5, False)
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.lit(-1).alias("fold"))
    return curves.bayes_scores(docs, "doc", weights, priors).withColumn("score", F.round("score", 6))


#: Words of a model that is sent to every task; a larger one is joined instead (``curves.bayes_scores``).
MODEL_WORDS = 500_000


@query(f"WITH {BAYES_SQL}")
def resumable_scores(spark, d):
    """The same model run over batches of chunks, stopped after one wave and taken up again"""
    weights, priors = curves.word_weights(*curves.word_counts(_labelled(spark, d)), 5, False)
    docs = tg.table(spark, d, "documents").select("doc_id", "text")
    if weights.count() > MODEL_WORDS:
        raise ValueError("the model has too many words to be sent to every task; join it by bayes_scores")
    odds, prior = {r.word: r.weight for r in weights.collect()}, priors.first().prior
    held = spark.sparkContext.broadcast(odds)

    def load():
        import pandas as pd
        import regex

        other, table = regex.compile(r"[^\p{L}\p{N}]+"), held.value

        def score(text: str | None) -> float:
            known = [table[w] for w in set(other.split((text or "").lower())) if w in table]
            return round(prior + (8 * sum(known) / len(known) if known else 0.0), 6)

        return lambda batch: pd.DataFrame({"doc": batch["doc_id"], "score": batch["text"].map(score).astype(float)})

    root, schema = work_path(spark, "ledger"), "doc long, score double"
    ledger.score_resumably(docs, "doc_id", root, schema, load, waves=1)
    ledger.score_resumably(docs, "doc_id", root, schema, load)
    return ledger.read_scores(spark, root, schema)


@query("""WITH asked AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2)
SELECT 'CHEBI:' || l_orderkey AS target, l_partkey::VARCHAR AS cid, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM asked) GROUP BY ALL""")
def key_filter(spark, d):
    """Rows of a few keys from a large map of many files, those without them spared by the filter beside them"""
    path = work_path(spark, "map")
    li = tg.table(spark, d, "lineitem").select(F.concat(F.lit("CHEBI:"), "l_orderkey").alias("target"), F.col("l_partkey").cast("string").alias("cid"))
    li.repartition(32, "target").write.option("sep", "\t").csv(f"{path}/map")
    schema = "target string, cid string"
    keyfilter.build_filter(spark.read.schema(schema).option("sep", "\t").csv(f"{path}/map"), "target", f"{path}/filter")
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    asked = tg.table(spark, d, "orders").withColumn("k", F.row_number().over(best)).filter("k <= 2").select(F.concat(F.lit("CHEBI:"), "o_orderkey").alias("target"))
    files = keyfilter.candidate_files(spark, f"{path}/filter", asked, "target")
    rows = spark.read.schema(schema).option("sep", "\t").csv(files)
    return rows.join(asked, "target", "left_semi").groupBy("target", "cid").agg(F.count(F.lit(1)).alias("n"))
