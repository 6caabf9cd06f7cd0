"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the mix takes the golden-ratio point ``i * phi mod 1``; the
cumulative target shares map the point to a source, so every stretch of the mix
holds the sources close to their shares. A slot is its source's r-th; the r-th
slot takes the r-th block of ``block_words`` words of the source's shuffled
documents laid end to end, beginning again after the last one. Blocks are cut by
words, so they are equal whatever the documents' lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, stored

BLOCK_WORDS = 1024
MAX_REPEATS = 3
SEED = 42
#: Sources are a driver-side table of a few numbers each, as targets depend on all of them; beyond this many the job is refused, not cut.
MAX_SOURCES = 1_000_000
SLOTS_PER_TASK = 1 << 20
#: 2**64 divided by the golden ratio: multiples of it, modulo 2**64, are the points.
GOLDEN = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets in proportion to weights that add up to all sizes, none above ``repeats`` times its own size."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(repeats * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(repeats * s) if c else left * w / weight for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > repeats * s for s, t, c in zip(sizes, out, capped)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over)]


class Mix:
    """Sizes, targets and document positions of one mix; built once, used by ``schedule`` and ``taken``."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED):
        self.spark, self.block = docs.sparkSession, block_words
        key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        narrow = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(key).alias("__key"))
        narrow = stored(narrow, "mix-sizes")  # range partitioning samples its input: words are counted once, not twice
        order = [F.col("source").asc_nulls_last(), F.col("__key").asc(), F.col("doc_id").asc_nulls_last(), F.col("size").asc()]
        ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            source, begun, before = None, False, 0
            for doc, name, size, _, row in rows:
                if not begun or name != source:
                    source, begun, before = name, True, 0
                yield doc, name, size, row, row >> 33, before
                before += size

        placed = stored(map_rows(ranged, run, f"doc_id {kind}, source string, size long, __row long, __part long, __before long", rows=4096), "mix-documents")
        # one row for each partition and source in it: partitions plus sources at most
        sums = placed.groupBy("source", "__part").agg(F.sum("size").alias("size"))
        if placed.select("source").distinct().count() > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        parts = sorted(((r[0] is None, r[0] or "", r[1], r[2]) for r in sums.collect()), key=lambda r: (r[0], r[1], r[2]))
        names = sorted({(r[0], r[1]) for r in parts})
        self.sizes = [0] * len(names)
        starts = []
        at = {name: k for k, name in enumerate(names)}
        for null, name, part, size in parts:
            k = at[null, name]
            starts.append((None if null else name, part, k, self.sizes[k]))
            self.sizes[k] += size
        self.targets = water_fill(self.sizes, [1 + k % 3 for k in range(len(names))])
        #: Words the mix takes from each source.
        self.words = [min(math.floor(t + 0.5), MAX_REPEATS * s) for t, s in zip(self.targets, self.sizes)]
        table = self.spark.createDataFrame([(n, p, k, s, self.sizes[k], self.targets[k], self.words[k]) for n, p, k, s in starts], "__name string, __p long, src int, __start long, source_size long, target double, source_words long")
        on = F.col("source").eqNullSafe(F.col("__name")) & (F.col("__part") == F.col("__p"))
        self.documents = placed.join(F.broadcast(table), on).select("__row", "doc_id", "source", "size", "src", (F.col("__start") + F.col("__before")).alias("at"), "source_size", "target", "source_words")

    def slots(self) -> DataFrame:
        """``slot, src, rank``: the schedule, each source's slots ranked from 0 and as many as its words need."""
        block, words, spark = self.block, self.words, self.spark
        need = np.array([-(-w // block) for w in words], np.int64)
        total = sum(words)
        if not total:
            return spark.createDataFrame([], "slot long, src int, rank long")
        edges = np.array([min(2**64 - 1, (sum(words[: k + 1]) << 64) // total) for k in range(len(words) - 1)], np.uint64)

        def sources(begin: int, end: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                points = np.arange(begin, end, dtype=np.uint64) * np.uint64(GOLDEN)
            return np.searchsorted(edges, points, side="right").astype(np.int32)

        least = min(w for w in words if w)
        slack = 8 + 2 * int(need.sum()).bit_length()
        length = int(need.sum()) + math.ceil(slack * total / least / block) + slack
        while True:
            tasks = -(-length // SLOTS_PER_TASK)
            size = -(-length // max(tasks, min(tasks * 8, 64)))  # few slots still keep several tasks busy
            count = -(-length // size)
            end = length

            def tally(rows: Iterator[tuple]) -> Iterator[tuple]:
                for (chunk,) in rows:
                    found = np.bincount(sources(chunk * size, min(end, (chunk + 1) * size)), minlength=len(need))
                    for k in np.flatnonzero(found):
                        yield chunk, int(k), int(found[k])

            counts = stored(map_rows(spark.range(0, count, 1, min(count, 64 * max(1, tasks))), tally, "chunk long, src int, n long"), "mix-slots")
            got = {r[0]: r[1] for r in counts.groupBy("src").agg(F.sum("n")).collect()}
            if all(got.get(k, 0) >= n for k, n in enumerate(need.tolist())):
                break
            length *= 2
        from pyspark.sql import Window

        before = F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        heads = counts.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("chunk").agg(F.collect_list("src").alias("srcs"), F.collect_list("before").alias("befores"))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, srcs, befores in zip(*(c.to_pylist() for c in batch.columns)):
                    first = np.zeros(len(need), np.int64)
                    first[srcs] = befores
                    begin = chunk * size
                    for low in range(begin, min(end, begin + size), 1 << 17):
                        src = sources(low, min(end, begin + size, low + (1 << 17)))
                        order = np.argsort(src, kind="stable")
                        here = np.bincount(src, minlength=len(need))
                        rank = np.empty(len(src), np.int64)
                        rank[order] = np.arange(len(src)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(first, here)
                        first += here
                        used = rank < need[src]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(src))[used]), pa.array(src[used]), pa.array(rank[used])], names=["slot", "src", "rank"])

        return heads.select("chunk", "srcs", "befores").mapInArrow(emit, "slot long, src int, rank long")

    def schedule(self) -> DataFrame:
        """``slot, source, epoch, doc_id, word, words, __row``: which words of which document each slot takes, in order."""
        block = self.block
        used = self.documents.filter("size > 0 and at < source_words")
        laps = used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("source_words") - 1 - F.col("at")) / F.col("source_size")).cast("long"))))
        begin = F.col("at") + F.col("epoch") * F.col("source_size")
        laps = laps.withColumns({"begin": begin, "end": F.least(begin + F.col("size"), F.col("source_words"))})
        div = lambda c: F.floor(c / F.lit(block)).cast("long")
        pieces = laps.withColumn("rank", F.explode(F.sequence(div(F.col("begin")), div(F.col("end") - 1))))
        low = F.greatest(F.col("begin"), F.col("rank") * block)
        high = F.least(F.col("end"), (F.col("rank") + 1) * block)
        pieces = pieces.select("src", "rank", "source", "epoch", "doc_id", (low - F.col("begin")).alias("word"), (high - low).alias("words"), "__row")
        # both sides grow with the corpus: they are merged, never broadcast
        return pieces.join(self.slots().hint("merge"), ["src", "rank"]).select("slot", "source", "epoch", "doc_id", "word", "words", "__row")

    def taken(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken`` of every document."""
        sums = self.schedule().groupBy("__row").agg(F.sum("words").alias("taken"))
        out = self.documents.join(sums.hint("merge"), "__row", "left")
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document.

    Sizes are words; null and empty texts have size 0 and are never taken.
    Sources sort by code point, null last, and weigh 1, 2, 3, repeating. Shuffle
    order depends on ``doc_id`` and ``seed`` alone; rows with the same id sort by
    size, and rows equal in both are interchangeable. An empty table gives an
    empty one; further columns are not read.
    """
    return Mix(docs, block_words, seed).taken().select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with every document as often as the mix takes it, to the nearest whole number; columns unchanged.

    Documents without words stand in no source's way and stay as they are. Rows
    that share an id, null included, are repeated alike, by what the mix takes of
    them together. An empty table stays empty; further columns may have any name.
    """
    counts = mix_documents(docs.select("doc_id", "source", "text"), block_words, seed)
    key, times, lap = (free_name(docs, c) for c in ("__id", "__times", "__lap"))
    sums = counts.groupBy(F.col("doc_id").alias(key)).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    sums = sums.select(key, whole.alias(times)).filter(F.col(times) > 0)
    joined = docs.join(sums, docs["doc_id"].eqNullSafe(sums[key]))
    return joined.withColumn(lap, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
