"""Literature text: sentences, term matching, classifier, judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store
from .skew import fit as fit_rows

SECTIONS = ("TITLE", "ABSTRACT", "INTRO", "METHODS", "RESULTS", "DISCUSS", "CONCL")
PASSAGE_TYPES = ("paragraph", "abstract")
LEAST_CHARS, MOST_CHARS = 20, 1000
#: Characters of which the longer of two texts may hold more, at this least similarity.
TERM_SCORE = 91.0


def sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``sentence_no``, ``sentence``: texts split after ``.``, ``!`` or ``?`` and white space, or at line ends."""
    marked = F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\n")
    return df.select(*keep, F.posexplode(F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")).alias("sentence_no", "sentence"))


def usable(sentence: Column) -> Column:
    return F.length(sentence).between(LEAST_CHARS, MOST_CHARS)


def usable_passage(section: Column, kind: Column) -> Column:
    return section.isin(*SECTIONS) & kind.isin(*PASSAGE_TYPES)


def passages(articles: DataFrame) -> DataFrame:
    """``article_id, section, kind, text`` of article JSON (documents of passages)."""
    docs = articles.select(F.explode("documents").alias("d"))
    flat = docs.select(F.col("d.id").alias("article_id"), F.explode("d.passages").alias("p"))
    return flat.select("article_id", F.col("p.infons.section_type").alias("section"), F.col("p.infons.type").alias("kind"), F.col("p.text").alias("text"))


def tokens(text: Column) -> Column:
    """Distinct lower-case words without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda t: t != ""))


def _indel(a: str, b: str) -> float:
    """100 times (1 - insertions and deletions over total length)."""
    if not a and not b:
        return 100.0
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_score(sentence: list[str], term: list[str]) -> float:
    """Best similarity among shared tokens, shared with each side's rest; a side whole in the other gives 100, no shared token 0."""
    a, b = set(sentence), set(term)
    both = " ".join(sorted(a & b))
    if not both:
        return 0.0
    if a <= b or b <= a:
        return 100.0
    one, two = f"{both} {' '.join(sorted(a - b))}", f"{both} {' '.join(sorted(b - a))}"
    return max(_indel(one, two), 200.0 * len(both) / (len(both) + len(one)), 200.0 * len(both) / (len(both) + len(two)))


def _letters(words: Column) -> Column:
    """64 bits: of each of 32 classes of characters, whether the words hold one, and whether they hold two.

    Bits that differ between two texts count at most the insertions and deletions between them.
    """
    text = F.split(F.array_join(words, ""), "")
    return F.aggregate(F.transform(text, lambda c: F.call_function("ascii", c) % 32), F.lit(0).cast("long"), _with_letter)


def _with_letter(held: Column, place: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return held.bitwiseOR(F.when(held.bitwiseAND(bit) == 0, bit).otherwise(F.call_function("shiftleft", bit, F.lit(32))))


#: Term lists with at most so many tokens are broadcast.
BROADCAST_TOKENS = 500_000


def match_terms(sents: DataFrame, terms: DataFrame, key: str, least: float = TERM_SCORE) -> DataFrame:
    """``key, term, score``: the best term per sentence at or above ``least`` by ``token_set_score``, ties by term.

    All pairs that can reach the score meet, never all pairs. With
    ``ratio = least / (200 - least)`` a pair reaches it in three ways: the shared
    tokens hold ``ratio`` of the term's characters, or of the sentence's, or both
    texts are so close in length that their difference must be measured.

    1. Of the term: one of its rarest tokens must be shared, as many as hold more
       than the characters that may be absent.
    2. Of the sentence: likewise from its side, after sentences that hold too many
       characters of tokens unknown to all terms are gone.
    3. Close lengths: pairs that share a token and nearly all letters, each met at
       its least token.

    Sentences of the same words meet the terms once. Lengths, letters and shared
    tokens are compared inside Spark; only pairs of close lengths and few edits
    are scored in Python. Tokens of the terms are broadcast if few, so sentences
    stay where they are.
    """
    ratio = least / (200 - least)
    chars = lambda c: F.length(F.array_join(c, " "))
    # explode keeps the optimiser from cutting the words anew for the filter and the digest
    said = sents.select(F.col(key).alias("__of"), F.explode(F.array(tokens(F.col("sentence")))).alias("words")).filter(F.size("words") > 0)
    said = store(said.withColumn("__words", F.sha2(F.array_join("words", " "), 256)), "said")
    # sentences of the same words are matched once; the numbers are fixed where they are stored
    s = store(said.select("__words", "words").distinct().withColumn(key, F.monotonically_increasing_id()), "texts")
    numbers, s = s.select("__words", key), s.select(key, "words")
    t = terms.select("term", tokens(F.col("term")).alias("term_words")).filter(F.size("term_words") > 0).distinct()
    t = store(t.withColumns({"t_chars": chars(F.col("term_words")), "t_letters": _letters(F.col("term_words"))}), "terms")
    size, longest = t.agg(F.coalesce(F.sum(F.size("term_words")), F.lit(0)), F.coalesce(F.max("t_chars"), F.lit(0))).first()
    s = s.withColumn("s_chars", chars(F.col("words")))
    s = store(s.withColumn("s_letters", F.when(F.col("s_chars") * ratio <= longest, _letters(F.col("words")))), "sentences")
    fit = F.broadcast if size <= BROADCAST_TOKENS else (lambda df: df)
    spread = s.select(key, "words", "s_chars", "s_letters", F.explode("words").alias("word"))
    of_terms = t.select("term", "term_words", "t_chars", "t_letters", F.explode("term_words").alias("word"))
    often = store(spread.select("word").join(fit(of_terms.select("word").distinct()), "word").groupBy("word").agg(F.count(F.lit(1)).alias("often")), "often")
    weight = F.length("word") + 1
    allowed = lambda c: F.col(c) * (1 - ratio) + 1

    by_term = Window.partitionBy("term").orderBy(F.coalesce("often", F.lit(0)), "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = of_terms.join(fit(often), "word", "left").withColumn("before", F.coalesce(F.sum(weight).over(by_term), F.lit(0))).filter(F.col("before") <= allowed("t_chars")).drop("often", "before")
    first = spread.join(fit(store(rare, "rare")), "word")

    short = spread.filter(F.col("s_chars") * ratio <= longest)
    known = short.join(fit(often), "word")
    whole, by_sentence = Window.partitionBy(key), Window.partitionBy(key).orderBy("often", "word").rowsBetween(Window.unboundedPreceding, -1)
    strange = F.col("s_chars") + 1 - F.sum(weight).over(whole)
    known = known.withColumns({"strange": strange, "before": F.coalesce(F.sum(weight).over(by_sentence), F.lit(0))})
    second = known.filter(F.col("strange") + F.col("before") <= allowed("s_chars")).select(*spread.columns).join(fit(of_terms), "word").filter(F.col("t_chars") > F.col("s_chars"))

    edits = (1 - least / 100) * (F.col("s_chars") + F.col("t_chars")) + 1e-9
    near = F.least("s_chars", "t_chars") >= ratio * F.greatest("s_chars", "t_chars") - 1e-9
    third = short.join(fit(of_terms), "word").filter(near & (F.bit_count(F.col("s_letters").bitwiseXOR(F.col("t_letters"))) <= edits))
    third = third.withColumn("shared", F.array_intersect("words", "term_words")).filter(F.col("word") == F.array_min("shared"))
    # stored, so that the edit distance is worked out for these few pairs alone
    third = store(third.select(key, "words", "term", "term_words", "s_chars", "t_chars", "shared"), "close")
    # an insertion or deletion is one edit, so the edit distance of what is not shared bounds the score
    rest = lambda c: F.array_join(F.array_sort(F.array_except(c, F.col("shared"))), " ")
    third = third.filter(F.levenshtein(rest(F.col("words")), rest(F.col("term_words"))) <= edits)

    @F.pandas_udf("double")
    def measured(words: pd.Series, term_words: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(list(a), list(b)) for a, b in zip(words, term_words)], dtype=float)

    columns = [key, "words", "term", "term_words", "s_chars", "t_chars"]
    far = first.select(*columns).unionByName(second.select(*columns)).withColumn("shared", F.array_intersect("words", "term_words"))
    far = far.select(key, "term", "s_chars", "t_chars", F.size("shared").alias("n"), chars(F.col("shared")).alias("both"), F.least(F.size("words"), F.size("term_words")).alias("least_n"))
    inside = F.when(F.col("n") == F.col("least_n"), F.lit(100.0)).otherwise(200.0 * F.col("both") / (F.col("both") + F.least("s_chars", "t_chars")))
    far = far.select(key, "term", inside.alias("score"))
    close = third.select(key, "term", measured("words", "term_words").alias("score"))
    best = far.unionByName(close).filter(F.col("score") >= least).groupBy(key).agg(F.min_by(F.struct("term", "score"), F.struct(-F.col("score"), "term")).alias("b"))
    named = store(numbers.join(best, key).select("__words", "b.term", "b.score"), "matched")
    every = said.join(fit_rows(named), "__words").select(F.col("__of").alias(key), "term", "score")
    best = every.groupBy(key).agg(F.min_by(F.struct("term", "score"), F.struct(-F.col("score"), "term")).alias("b"))
    return best.select(key, "b.term", "b.score")


def match_vocabulary(raw: DataFrame, vocabulary: DataFrame, least: float = 90.0) -> DataFrame:
    """``raw, term, score``: the most similar vocabulary term of each distinct raw text, at or above ``least``.

    Equal texts match at once. Of the rest, only pairs that share a trigram and
    whose lengths allow the score meet, and only those whose edit distance, which
    insertions and deletions cannot fall below, allows it are scored: 100 times
    the normalised indel similarity of the lower-cased texts.
    """
    from ..functions.names import trigrams

    a = raw.select(F.col("raw")).distinct().withColumn("low", F.lower(F.trim("raw")))
    v = vocabulary.select("term").distinct().withColumn("term_low", F.lower(F.trim("term")))
    same = a.join(v, a.low == v.term_low).groupBy("raw").agg(F.min("term").alias("term")).withColumn("score", F.lit(100.0))
    left = a.join(same, "raw", "left_anti").withColumn("gram", F.explode(trigrams(F.col("low"))))
    right = v.withColumn("gram", F.explode(trigrams(F.col("term_low"))))
    pairs = left.join(right, "gram").filter(F.least(F.length("low"), F.length("term_low")) >= (least / (200 - least)) * F.greatest(F.length("low"), F.length("term_low"))).select("raw", "low", "term", "term_low").distinct()
    edits = (1 - least / 100) * (F.length("low") + F.length("term_low")) + 1e-9
    pairs = store(pairs.filter(F.levenshtein("low", "term_low") <= edits), "vocabulary-pairs")

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_indel(p, q) for p, q in zip(x, y)], dtype=float)

    scored = pairs.withColumn("score", score("low", "term_low")).filter(F.col("score") >= least)
    best = scored.groupBy("raw").agg(F.max_by(F.struct("term", "score"), F.struct(F.col("score"), -F.length("term"), "term")).alias("b")).select("raw", "b.term", "b.score")
    return same.unionByName(best)


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no earlier run has finished."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def score_batches(rows: DataFrame, schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Batch scoring: ``load`` runs once per task and gives the function that maps a batch to rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def train_classifier(rows: DataFrame, features: int = 1 << 12, seed: int = 7):
    """Fit hashed words against ``label`` (0 or 1); returns (model, metrics of the test part).

    Rows are split by hash of ``key`` into train, validation and test; of a few
    regularisation strengths the one with the best validation F1 is kept.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    part = F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(10))
    parts = [rows.filter(c) for c in (part < 6, (part >= 6) & (part < 8), part >= 8)]
    steps = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True)]
    best = None
    for strength in (0.001, 0.01, 0.1):
        model = Pipeline(stages=[*steps, LogisticRegression(regParam=strength, maxIter=30)]).fit(parts[0])
        f1 = metrics(model.transform(parts[1])).first()["f1"] or 0.0
        if best is None or f1 > best[0]:
            best = (f1, model)
    return best[1], metrics(best[1].transform(parts[2]))


def metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``f1, precision, recall, n`` of 0/1 predictions; 0 where nothing was predicted or true."""
    hit = F.count_if((F.col(label) == 1) & (F.col(prediction) == 1))
    said, true = F.count_if(F.col(prediction) == 1), F.count_if(F.col(label) == 1)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return scored.agg(share(2 * hit, said + true).alias("f1"), share(hit, said).alias("precision"), share(hit, true).alias("recall"), F.count(F.lit(1)).alias("n"))


def judge(attestations: DataFrame, signals: DataFrame, prefixes: list[str], scorer: Callable[[pd.DataFrame], pd.DataFrame], template: str, kind: str, version: str, config: str, limit: int | None = None) -> DataFrame:
    """The judge stage: select, render, score, validate, merge; returns the new signal table.

    Candidates have a concentration and a source with one of the prefixes; those
    already judged under this configuration are skipped, failed ones tried again.
    ``scorer`` maps a batch (``attestation_id, prompt``) to (``attestation_id,
    reply, error``); replies for unknown ids are dropped.
    """
    from ..functions.claims import judge_reply, render
    from .build import replace_run, signal_rows

    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("source").startswith(p)
    done = signals.filter((F.col("signal_kind") == kind) & (F.col("version") == version) & (F.col("config_hash") == config) & (F.col("score") >= 0))
    todo = attestations.filter(wanted & F.col("conc_value").isNotNull()).join(done, "attestation_id", "left_anti")
    if limit is not None:
        todo = todo.orderBy("attestation_id").limit(limit)
    asked = todo.select("attestation_id", render(template, head=F.col("head_name_raw"), tail=F.col("tail_name_raw"), value=F.col("conc_value")).alias("prompt"))
    replies = asked.mapInPandas(lambda batches: (scorer(b) for b in batches), "attestation_id string, reply string, error string")
    checked = replies.join(asked.select("attestation_id"), "attestation_id", "left_semi").withColumn("v", judge_reply(F.col("reply"), F.col("error")))
    rows = signal_rows(checked.select("attestation_id", "v.*"), kind, version, config).withColumns({"model": F.lit("injected"), "created_at": F.current_timestamp()})
    return replace_run(signals, rows.select(*signals.columns), ["signal_id"])


def reconcile_ids(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with missing ids filled, violations): ``pmid`` and ``pmcid`` against the id map; both given must agree with it."""
    by_pmid = pairs.select("pmid", F.col("pmcid").alias("__pmcid")).dropDuplicates(["pmid"])
    by_pmc = pairs.select("pmcid", F.col("pmid").alias("__pmid")).dropDuplicates(["pmcid"])
    both = rows.join(by_pmid, "pmid", "left").join(by_pmc, "pmcid", "left")
    wrong = F.col("pmid").isNotNull() & F.col("pmcid").isNotNull() & F.col("__pmcid").isNotNull() & (F.col("__pmcid") != F.col("pmcid"))
    cols = [c for c in rows.columns if c not in ("pmid", "pmcid")]
    filled = both.select(*cols, F.coalesce("pmid", "__pmid").alias("pmid"), F.coalesce("pmcid", "__pmcid").alias("pmcid"), wrong.alias("__wrong"))
    return filled.filter("not __wrong").drop("__wrong"), filled.filter("__wrong").drop("__wrong")


def merge_queries(hits: DataFrame) -> DataFrame:
    """``pmid, pmcid, queries``: the distinct queries that found each article."""
    return hits.groupBy("pmid", "pmcid").agg(F.array_sort(F.collect_set("query")).alias("queries"))


def since(runs: DataFrame, first: str) -> DataFrame:
    """``low``: the newest finished run's date, else ``first``; where the next search begins."""
    return runs.filter("finished").agg(F.coalesce(F.max("run_date"), F.lit(first).cast("date")).alias("low"))
