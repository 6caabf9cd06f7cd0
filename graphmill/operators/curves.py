"""Classifier measures over all thresholds, and folds that keep groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store
from .skew import fit


def score_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``auc, average_precision, best_f1, n, positives`` of scores against 0/1 labels; one row.

    Rows of one score are one threshold, so ties count half in the area under the
    curve. Distinct scores are counted, range-partitioned and added up from the
    top, with one figure per partition at the driver. Null scores and labels are
    left out; without both labels the area is null, without positives precision.
    """
    rows = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    counted = store(rows.agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")), "thresholds")
    ranged = store(counted.repartitionByRange(F.desc("s")).sortWithinPartitions(F.desc("s")).withColumn("part", F.spark_partition_id()), "ranged")
    starts, pos, neg = [], 0, 0
    for r in sorted(ranged.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect(), key=lambda r: r.part):
        starts.append((r.part, pos, neg))
        pos, neg = pos + r.pos, neg + r.neg
    table = F.broadcast(ranged.sparkSession.createDataFrame(starts, "part int, pos0 long, neg0 long"))
    upto = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)  # a range at a time
    full = ranged.join(table, "part").withColumns({"tp": F.col("pos0") + F.sum("pos").over(upto), "fp": F.col("neg0") + F.sum("neg").over(upto)})
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return full.agg(
        share(area, F.lit(float(pos) * neg)).alias("auc"),  # pairs, beyond an integer
        share(F.sum(F.col("pos") * share(F.col("tp"), F.col("tp") + F.col("fp"))), F.lit(pos)).alias("average_precision"),
        F.max(share(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.lit(pos))).alias("best_f1"),
        F.lit(pos + neg).cast("long").alias("n"),
        F.lit(pos).cast("long").alias("positives"),
    )


def fold_of(group: Column, folds: int) -> Column:
    """The fold of a group: rows that share it, such as copies of a text, are never on both sides."""
    return F.pmod(F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def words_of(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def word_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``word, fold, pos, neg`` documents per word and fold, ``fold, pos, neg`` documents per fold) of ``text, label, fold``."""
    one, none = F.sum(F.col("label").cast("long")), F.sum(1 - F.col("label").cast("long"))
    words = rows.select("fold", "label", F.explode(words_of(F.col("text"))).alias("word"))
    return store(words.groupBy("word", "fold").agg(one.alias("pos"), none.alias("neg")), "word-counts"), store(rows.groupBy("fold").agg(one.alias("pos"), none.alias("neg")), "fold-counts")


def word_weights(words: DataFrame, folds: DataFrame, least: int, held_out: bool) -> tuple[DataFrame, DataFrame]:
    """(``fold, word, weight``, ``fold, prior``): naive Bayes log odds of words in at least ``least`` documents.

    With ``held_out`` a fold's weights are counted without the fold itself, which
    is the total less its own counts, so all folds take one pass; else there is
    one model, of fold -1.
    """
    total = folds.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = words.groupBy("word").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    if held_out:
        around = F.broadcast(folds.crossJoin(total).select("fold", (F.col("p") - F.col("pos")).alias("P"), (F.col("n") - F.col("neg")).alias("N")))  # a row per fold
        each = sums.crossJoin(F.broadcast(folds.select("fold"))).join(words, ["word", "fold"], "left")
        each = each.select("word", "fold", (F.col("tp") - F.coalesce("pos", F.lit(0))).alias("pos"), (F.col("tn") - F.coalesce("neg", F.lit(0))).alias("neg"))
    else:
        around = F.broadcast(total.select(F.lit(-1).alias("fold"), F.col("p").alias("P"), F.col("n").alias("N")))
        each = sums.select("word", F.lit(-1).alias("fold"), F.col("tp").alias("pos"), F.col("tn").alias("neg"))
    kept = each.filter(F.col("pos") + F.col("neg") >= least).join(around, "fold")
    odds = F.log((F.col("pos") + 1) / (F.col("P") + 2)) - F.log((F.col("neg") + 1) / (F.col("N") + 2))
    return store(kept.select("fold", "word", odds.alias("weight")), "word-weights"), around.select("fold", (F.log(F.col("P") + 1) - F.log(F.col("N") + 1)).alias("prior"))


def bayes_scores(rows: DataFrame, key: str, weights: DataFrame, priors: DataFrame) -> DataFrame:
    """``key, score``: log odds of every row (``key, text, fold``) by the words it holds; a text without known words has the prior.

    Weights are broadcast where their counted rows allow it. A score does not
    grow with the text: the mean weight of its known words, eight times, is added.
    """
    words = rows.select(key, "fold", F.explode(words_of(F.col("text"))).alias("word")).join(fit(weights), ["fold", "word"])
    summed = words.groupBy(key).agg((8 * F.avg("weight")).alias("__s"))
    return rows.select(key, "fold").join(F.broadcast(priors), "fold").join(summed, key, "left").select(key, (F.col("prior") + F.coalesce("__s", F.lit(0.0))).alias("score"))
