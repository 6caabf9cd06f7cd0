"""Sentence boundaries learnt from the corpus itself, after Kiss and Strunk (2006).

A period ends a sentence unless its word is an abbreviation, an initial or a
number that goes on. Abbreviations, sentence starters and collocations are found
by log-likelihood ratios over counts of the whole corpus; nothing is labelled.
Counting is grouped aggregation; the learnt tables are joined to the few words
in doubt, by broadcast where their counted rows allow it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import store

# fixed values: the thresholds of the published method
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
COLLOCATION_SCORE = 7.88
#: A word must be seen with a period so often before it may be an abbreviation.
LEAST_SEEN = 3
#: Learnt tables with at most so many rows are broadcast.
BROADCAST_ROWS = 500_000
NUMBER = "##"
#: White space as the patterns below know it, and what may close after an end mark.
SPACES = " \t\n\r\f\u000b"
CLOSERS = "\"')]}»”’"
_END = r"""[.!?…]["')\]}»”’]*"""
#: The last word of a stretch.
LAST = r"(?s).*(?<!\S)(\S+)"
#: A stretch of a text up to a word that may end a sentence, with the white space after it; the last one is what is left.
STRETCH = rf"(?s).*?{_END}(?:\s+|\z)|.+\z"
#: Control characters that mark a cut inside a row; a text in which a sentence goes on after a period and that holds this very sequence is cut there too.
CUT = "\u0001\u001e\u0001"


@dataclass(frozen=True)
class Boundaries:
    """What ``learn`` found: ``abbreviations`` (base), ``words`` (word, starter, lower, upper_mid), ``collocations`` (base, word)."""

    abbreviations: DataFrame
    words: DataFrame
    collocations: DataFrame


def _core(word: Column) -> Column:
    """A word without closing quotes, brackets and white space after it and opening ones before."""
    return F.ltrim(F.rtrim(word, F.lit(CLOSERS + SPACES)), F.lit("\"'([{«“‘"))


def _base(core: Column) -> Column:
    """Lower case without one final period; all numbers are one."""
    bare = F.lower(F.when(core.endswith("."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    return F.when(bare.rlike(r"^[+-]?[0-9][0-9.,/-]*$"), F.lit(NUMBER)).otherwise(bare)


def ends(core: Column) -> Column:
    """Whether a word may end a sentence."""
    return core.endswith(".") | core.endswith("!") | core.endswith("?") | core.endswith("…")


def in_doubt(core: Column) -> Column:
    """Ends in a period; exclamation and question marks are not in doubt."""
    return (core.endswith(".") & (F.length(core) > 1)) | (core.endswith("…") & (F.length(core) >= 1))


def dots(core: Column) -> Column:
    """Ends in several periods."""
    return core.endswith("..") | core.endswith("…")


def words_of(df: DataFrame, text: str) -> DataFrame:
    """One row per word of every text: ``word`` as it stands, and ``first``, whether it begins the text."""
    words = df.select(F.posexplode(F.split(F.ltrim(F.col(text), F.lit(SPACES)), r"\s+")).alias("at", "word"))
    return words.filter("word <> ''").select("word", (F.col("at") == 0).alias("first"))


def stretches(text: Column) -> Column:
    """A text cut after each word that may end a sentence; null has no stretches."""
    return F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0))


def stops_of(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """One row per word that may end a sentence and has a word after it: ``keep``, its number ``at`` among these, ``core`` and the ``next`` word's."""
    found = df.select(*keep, stretches(F.col(text)).alias("x"))  # computed once, not once per use below
    kept = [c for c in found.columns if c != "x"]
    rows = found.select(*kept, F.posexplode(F.arrays_zip("x", F.slice("x", F.lit(2), F.size("x")).alias("y"))).alias("at", "z")).filter("z.y is not null")
    return rows.select(*kept, "at", _core(F.regexp_extract("z.x", LAST, 1)).alias("core"), _core(F.regexp_extract("z.y", r"\S+", 0)).alias("next"))


def _upper(core: Column) -> Column:
    return core.rlike(r"^\p{Lu}")


def _lower(core: Column) -> Column:
    return core.rlike(r"^\p{Ll}")


def _fit(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def abbreviation_score(dots: Column, plain: Column, all_dots: Column, total: Column, base: Column) -> Column:
    """Log-likelihood of a word's periods being its own, scaled by its length, its inner periods and its uses without a period."""
    share = _share(all_dots, total)
    ratio = -2 * (dots * _log(share) + plain * _log(1 - share) - dots * _log(F.lit(0.99)) - plain * _log(F.lit(0.01)))
    letters = F.length(F.replace(base, F.lit("."), F.lit("")))
    return ratio * F.exp(-letters) * (F.length(base) - letters + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -plain)


def collocation_score(one: Column, two: Column, both: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two words occurring together; 0 where they do so less often than by chance."""
    p, p1, p2 = _share(two, total), _share(both, one), _share(two - both, F.greatest(total - one, F.lit(1)))
    fit = lambda k, n, q: k * _log(q) + (n - k) * _log(1 - q)
    ratio = -2 * (fit(both, one, p) + fit(two - both, total - one, p) - fit(both, one, p1) - fit(two - both, total - one, p2))
    return F.when(p1 > p, ratio).otherwise(F.lit(0.0))


def initial(base: Column) -> Column:
    return base.rlike(r"^\p{L}$")


def learn(df: DataFrame, text: str = "text") -> Boundaries:
    """Learn from all texts. Null and empty texts add nothing, repeated texts count as often as they occur; no texts give empty tables."""
    # words are counted as they stand, so their forms are described once each
    words = words_of(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("first")).select(_core(F.col("word")).alias("core"), "n", "first")
    words = store(words.groupBy("core").agg(F.sum("n").alias("n"), F.sum("first").alias("first")), "forms")
    dot = F.when(in_doubt(F.col("core")), F.col("n")).otherwise(F.lit(0))
    counts = store(words.groupBy(_base(F.col("core")).alias("base")).agg(F.sum(dot).alias("dots"), F.sum(F.col("n") - dot).alias("plain")), "words")
    total, all_dots = (x or 0 for x in counts.agg(F.sum(F.col("dots") + F.col("plain")), F.sum("dots")).first())
    score = abbreviation_score(F.col("dots"), F.col("plain"), F.lit(all_dots), F.lit(total), F.col("base"))
    found = counts.filter((F.col("dots") >= LEAST_SEEN) & (F.col("base") != NUMBER) & F.col("base").rlike(r"\p{L}")).filter(score >= ABBREVIATION_SCORE)
    abbreviations = store(found.select("base"), "abbreviations")

    # of the words before others only those that may end a sentence matter, and by name only those after which one may go on
    stops = stops_of(df, text).select(_base(F.col("core")).alias("base"), in_doubt(F.col("core")).alias("dot"), dots(F.col("core")).alias("dots"), "next")
    stops = stops.join(_fit(abbreviations.withColumn("abbreviated", F.lit(True))), "base", "left").withColumn("abbreviated", F.coalesce("abbreviated", F.lit(False)))
    ended = ~F.col("dot") | (~F.col("dots") & ~F.col("abbreviated"))
    open_ = F.col("dot") & (F.col("abbreviated") | (F.col("base") == NUMBER) | initial(F.col("base")))
    stops = stops.groupBy(F.when(open_, F.col("base")).alias("base"), "dot", ended.alias("ended"), "next").agg(F.count(F.lit(1)).alias("n"))
    stops = store(stops.withColumn("word", _base(F.col("next"))), "stops")

    # words that begin no text come after one; those not after a word that may end a sentence are what is left
    zero, n = F.lit(0).cast("long"), F.col("n")
    when = lambda c: F.when(c, n).otherwise(zero)
    own = words.withColumn("n", n - F.col("first")).select(_base(F.col("core")).alias("word"), "n", zero.alias("after_end"), when(_lower(F.col("core"))).alias("lower"), when(_upper(F.col("core"))).alias("upper_mid"), zero.alias("exposed"))
    less = stops.select("word", zero.alias("n"), when(F.col("ended")).alias("after_end"), zero.alias("lower"), (-when(_upper(F.col("next")))).alias("upper_mid"), when(F.col("dot")).alias("exposed"))
    counted = own.unionByName(less).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "after_end", "lower", "upper_mid", "exposed"))).filter("n > 0")
    counted = store(counted, "next-words")
    breaks, every = (x or 0 for x in counted.agg(F.sum("after_end"), F.sum("n")).first())
    starts = collocation_score(F.lit(breaks), F.col("n"), F.col("after_end"), F.lit(every))
    starter = F.col("word").rlike(r"\p{L}") & ~initial(F.col("word")) & (F.col("after_end") > 0) & (starts > STARTER_SCORE)
    vocabulary = store(counted.filter("exposed > 0").select("word", starter.alias("starter"), (F.col("lower") > 0).alias("lower"), (F.col("upper_mid") > 0).alias("upper_mid")), "vocabulary")

    pairs = stops.filter("base is not null").groupBy("base", "word").agg(F.sum("n").alias("both")).filter("both > 1")
    pairs = pairs.join(_fit(store(counts.filter("dots > 0").select("base", "dots"), "dotted")), "base").join(counted.select("word", "n"), "word")
    tied = collocation_score(F.col("dots"), F.col("n"), F.col("both"), F.lit(every)) > COLLOCATION_SCORE
    collocations = store(pairs.filter(tied).select("base", "word"), "collocations")
    return Boundaries(abbreviations, vocabulary, collocations)


def goes_on(abbreviated: Column, starter: Column, lower_seen: Column, upper_mid: Column, tied: Column) -> Column:
    """Whether a sentence goes on after a word with a period (``core, base``) before ``word`` that begins ``upper`` or ``lower``."""
    begins = F.col("upper") & (starter | (lower_seen & ~upper_mid))
    number = (F.col("base") == NUMBER) & (F.col("lower") | (F.col("word") == NUMBER))
    return tied | ((abbreviated | initial(F.col("base")) | dots(F.col("core"))) & ~begins) | number


def split_sentences(df: DataFrame, text: str, keep: list[str], learnt: Boundaries) -> DataFrame:
    """``keep``, ``sentence_no``, ``sentence``: sentences as they stand in the text, trimmed, in order from 0.

    The words after which a sentence goes on are found per distinct text and
    joined back, by broadcast where they are few; texts without such words are
    cut where they stand. Null and empty texts have no sentences; a text without
    an end mark is one; line ends are white space like any other.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    doubts = stops_of(df, text, F.md5(text).alias("__text")).filter(in_doubt(F.col("core"))).withColumn("base", _base(F.col("core")))
    doubts = doubts.join(_fit(learnt.abbreviations.withColumn("__a", F.lit(True))), "base", "left")
    open_ = known("__a") | (F.col("base") == NUMBER) | initial(F.col("base")) | dots(F.col("core"))
    doubts = doubts.filter(open_).select("*", _base(F.col("next")).alias("word"), _upper(F.col("next")).alias("upper"), _lower(F.col("next")).alias("lower"))
    doubts = doubts.join(_fit(learnt.words.withColumnsRenamed({"starter": "__s", "lower": "__l", "upper_mid": "__u"})), "word", "left")
    doubts = doubts.join(_fit(learnt.collocations.withColumn("__c", F.lit(True))), ["base", "word"], "left")
    on = doubts.filter(goes_on(known("__a"), known("__s"), known("__l"), known("__u"), known("__c")))
    joints = store(on.groupBy("__text").agg(F.collect_set("at").alias("__on")), "joints")
    rows = df.withColumn("__text", F.md5(text)).join(_fit(joints), "__text", "left")
    whole = stretches(F.col(text))
    marked = F.array_join(F.transform(whole, lambda x, i: F.when(F.array_contains("__on", i), x).otherwise(F.concat(x, F.lit(CUT)))), "")
    cut = F.when(F.col("__on").isNull(), whole).otherwise(F.split(marked, CUT))
    made = F.filter(F.transform(cut, lambda s: F.trim(s, F.lit(SPACES))), lambda s: s != "")
    return rows.select(*keep, F.posexplode(made).alias("sentence_no", "sentence"))
