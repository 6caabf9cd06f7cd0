"""Toxicity by weak supervision.

Many weak voters (a fixed lexicon, surface patterns, and word stems mined from
labelled rows) vote on every document. A generative label model, fitted by
expectation maximisation over the votes of the whole corpus, estimates how often
each voter fires in either class and how voters correlate given the class; its
posterior labels train a linear classifier on hashed word features, which gives
the score. Labels of held-out rows are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Labelled rows used for mining stems and fitting the classifier, at most; rows are taken by hash of their id.
MAX_LABELLED = 20_000
#: Mined voters, at most: with the four fixed ones they fit a 64-bit vote mask. A size of the model, like ``BUCKETS``.
MAX_VOTERS = 56
#: Stems the greedy choice of voters considers, best first.
MAX_STEMS = 1000
#: Correlations below this are taken for none: weaker ones are common to all voters of one language.
LEAST_RHO = 0.5
BUCKETS = 1 << 15
THRESHOLD = 0.7
#: Documents whose word features are in memory at a time while the classifier is fitted.
BLOCK = 1024
#: Words remembered per task.
MEMO_WORDS = 150_000
EM_ROUNDS = 6
STEM = (3, 8)

# fixed values: general insults and abuse of the English language
LEXICON = (
    "idiot moron imbecile stupid dumb fool loser scum trash garbage vermin filth pathetic worthless "
    "disgusting clown liar coward pig bastard bitch whore slut shit fuck fucking asshole retard"
).split()

_word = re.compile(r"\w+")
_loud = re.compile(r"\b[A-Z]{3,}\b")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


class Voters:
    """Votes of one text as a bit mask.

    A mined stem ``run#2`` votes where at least two words of the text begin with
    ``run``; ``run$#1`` asks for the whole word.
    """

    def __init__(self, stems: list[str]):
        self.names = ["lexicon", "lexicon twice", "shouting", "exclaiming", *stems]
        self.lexicon = frozenset(LEXICON)
        self.bits: dict[str, list[tuple[int, int]]] = {}
        for k, s in enumerate(stems):
            stem, _, times = s.rpartition("#")
            self.bits.setdefault(stem, []).append((int(times), 1 << (4 + k)))
        self.lengths = sorted({len(s) for s in self.bits if not s.endswith("$")})
        self.memo: dict[str, tuple[tuple[str, ...], int, int, bool]] = {}

    def _about(self, word: str) -> tuple[tuple[str, ...], int, int, bool]:
        stems = tuple(s for s in (word + "$", *(word[:n] for n in self.lengths if len(word) >= n)) if s in self.bits)
        return stems, zlib.crc32(word[:4].encode()) % BUCKETS, zlib.crc32(b"w" + word.encode()) % BUCKETS, word in self.lexicon

    def words(self, text: str) -> list[tuple[tuple, int]]:
        """What is known of each distinct word, and how often it occurs."""
        memo, out = self.memo, []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word, n in Counter(_word.findall(text.lower())).items():
            about = memo.get(word)
            if about is None:
                about = memo[word] = self._about(word)
            out.append((about, n))
        return out

    def mask(self, words: list[tuple[tuple, int]], text: str) -> int:
        mask, named, total, times = 0, 0, 0, {}
        for about, n in words:
            total += n
            named += about[3]
            for stem in about[0]:
                times[stem] = times.get(stem, 0) + n
        for stem, n in times.items():
            for least, bit in self.bits[stem]:
                if n >= least:
                    mask |= bit
        mask |= (named > 0) | (named > 1) << 1
        if total > 4 and len(_loud.findall(text)) > 0.4 * total:
            mask |= 4
        if text.count("!!") > 3:
            mask |= 8
        return mask

    def read(self, text: str) -> tuple[int, np.ndarray]:
        """The mask, and the sorted distinct buckets of the text's words and word beginnings."""
        words = self.words(text)
        buckets = {b for about, _ in words for b in about[1:3]}
        return self.mask(words, text), np.array(sorted(buckets), np.uint16)


def mine_stems(sample: DataFrame, most: int) -> list[str]:
    """Stems that labelled toxic texts hold and clean ones hardly ever do.

    ``sample`` has distinct labelled texts (``text, toxic``), at most
    ``MAX_LABELLED``. Document counts are added up per partition, then by Spark;
    only stems beyond chance for the number of stems tried reach the driver.
    Stems are then taken greedily until each toxic text is covered three times.
    """

    def features(text: str) -> set[str]:
        times: Counter = Counter()
        for word, n in Counter(_word.findall(text.lower())).items():
            times[word + "$"] += n
            for size in range(STEM[0], min(STEM[1], len(word)) + 1):
                times[word[:size]] += n
        return {f"{stem}#{least}" for stem, n in times.items() for least in range(1, min(3, n) + 1)}

    def tally(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts = [Counter(), Counter()]
        for text, toxic in rows:
            counts[toxic].update(features(text))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield from ((k, n, y) for y in (0, 1) for k, n in counts[y].items())
                counts = [Counter(), Counter()]
        yield from ((k, n, y) for y in (0, 1) for k, n in counts[y].items())

    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    sums = map_rows(sample, tally, "stem string, n long, toxic int", rows=8192).groupBy("stem")
    sums = sums.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("g"))
    sums = sums.filter((F.col("b") >= 4) & (F.col("g") * bad * 20 <= F.col("b") * good))
    share = bad / (bad + good)
    # the chance that all but g of b + g texts are toxic, against the number of stems with such counts
    likely = F.col("b") * math.log(1 / share) - F.col("g") * 6
    found = [(r[0], r[1], r[2]) for r in sums.withColumn("gain", likely).filter("gain > 13").orderBy(F.desc("gain"), "stem").limit(MAX_STEMS).collect()]
    if not found:
        return []
    names = [s for s, _, _ in found]
    known = frozenset(names)

    def covers(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, toxic in rows:
            if toxic:
                yield (sorted(features(text) & known),)

    texts = [r[0] for r in map_rows(sample, covers, "stems array<string>", rows=1024).collect()]  # at most MAX_LABELLED rows
    holds: dict[str, set[int]] = {s: set() for s in names}
    for i, stems in enumerate(texts):
        for s in stems:
            holds[s].add(i)
    clean = {s: g for s, _, g in found}
    taken: list[str] = []
    covered = [0] * len(texts)
    while len(taken) < most:
        def gain(s):
            return sum(covered[i] < 3 for i in holds[s]) - 8 * clean[s] * bad / good
        best = max((s for s in names if s not in taken), key=lambda s: (gain(s), -len(s), s), default=None)
        if best is None or gain(best) < 2:
            break
        taken.append(best)
        for i in holds[best]:
            covered[i] += 1
    return taken


class LabelModel:
    """Two classes, voters that fire given the class, and how strongly they repeat each other.

    ``fire[y, j]`` is how often voter j fires in class y. A voter's evidence is
    divided by one plus its summed positive correlations with the others among
    toxic texts (its design effect), so voters that repeat each other do not
    count twice, neither in the posterior nor in the rounds that estimate the
    model. A voter that stays silent abstains: silence is evidence only where
    every voter is silent, for voters of one language say nothing about texts in
    another.
    """

    def __init__(self, fire: np.ndarray, prior: float, weight: np.ndarray):
        self.fire, self.prior, self.weight = fire, prior, weight

    def logit(self, votes: np.ndarray) -> np.ndarray:
        on = (np.log(self.fire[1]) - np.log(self.fire[0])) * self.weight
        off = (np.log1p(-self.fire[1]) - np.log1p(-self.fire[0])) * self.weight
        fired = votes.any(axis=1)
        return math.log(self.prior / (1 - self.prior)) + np.where(fired, votes @ on, off.sum())

    @staticmethod
    def unpack(masks: np.ndarray, n: int) -> np.ndarray:
        return ((masks[:, None] >> np.arange(n)) & 1).astype(np.float64)


def fit_label_model(patterns: DataFrame, sample_votes: np.ndarray, sample_toxic: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Fit over ``patterns`` (``votes, n``: each vote mask and its documents, of the whole corpus).

    Labelled votes start the model and stay as pseudo-counts, so that classes
    keep their meaning. Each round is one Spark aggregation that returns sums
    over voters and pairs of voters, one row per partition, and estimates firing
    rates, prior and correlations together.
    """
    k = sample_votes.shape[1]
    bad = sample_toxic.astype(np.float64)
    base = np.stack([(1 - bad) @ sample_votes, bad @ sample_votes])
    joint = (sample_votes * bad[:, None]).T @ sample_votes  # pairs of votes among texts labelled toxic
    size = np.array([(1 - bad).sum(), bad.sum()])

    def model(sums: np.ndarray, pairs: np.ndarray, mass: np.ndarray, floor: float) -> LabelModel:
        fire = np.clip((sums + 0.25) / (mass[:, None] + 1.0), floor, 1 - floor)
        rate = sums[1] / max(mass[1], 1.0)
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
        rho = (pairs / max(mass[1], 1.0) - np.outer(rate, rate)) / np.outer(spread, spread)
        np.fill_diagonal(rho, 0)
        # a correlation within three standard errors of none is none
        repeat = np.where(rho > max(LEAST_RHO, 3 / math.sqrt(max(mass[1], 1.0))), np.minimum(rho, 1), 0)
        return LabelModel(fire, float(np.clip(mass[1] / max(mass.sum(), 1.0), 1e-3, 0.5)), 1 / (1 + repeat.sum(1)))

    now = model(base, joint, size, 1e-5)
    for _ in range(rounds):

        def expect(rows: Iterator[tuple], model=now) -> Iterator[tuple]:
            sums = np.zeros(2 + 2 * k + k * k)

            def add(held):
                masks, n = (np.array(c) for c in zip(*held))
                votes = LabelModel.unpack(masks, k)
                q = n / (1 + np.exp(-model.logit(votes)))
                sums[:2] += (n - q).sum(), q.sum()
                sums[2 : 2 + k] += (n - q) @ votes
                sums[2 + k : 2 + 2 * k] += q @ votes
                sums[2 + 2 * k :] += ((votes * q[:, None]).T @ votes).ravel()

            held: list[tuple] = []
            for row in rows:
                held.append(row)
                if len(held) == 8192:
                    add(held)
                    held = []
            if held:
                add(held)
            if sums.any():
                yield (sums.tolist(),)

        total = sum((np.array(r[0]) for r in map_rows(patterns, expect, "sums array<double>").collect()), np.zeros(2 + 2 * k + k * k))
        now = model(total[2 : 2 + 2 * k].reshape(2, k) + base, total[2 + 2 * k :].reshape(k, k) + joint, total[:2] + size, 1e-6)
    return now


class LinearModel:
    """Logistic regression of a text's features, learned from posterior labels.

    Features are the text's votes and its hashed words; no output of the label
    model is among them. Votes are few and get Newton steps, words are many and
    get gradient steps; both shrink towards zero.
    """

    def __init__(self, k: int):
        self.dense, self.words = np.zeros(k + 2), np.zeros(BUCKETS)
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def features(votes: np.ndarray) -> np.ndarray:
        """A constant, whether nothing voted, and each vote."""
        return np.column_stack([np.ones(len(votes)), ~votes.any(axis=1), votes])

    def raw(self, votes: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        return self.scale * (self.features(votes) @ self.dense + _Block(buckets).sums(self.words)) + self.shift

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray, steps: int = 30) -> None:
        """Scale and shift the score so that it is the chance of the label among labelled texts; a score that tells nothing stays as it is."""
        bad, good = float(toxic.sum()), float((1 - toxic).sum())
        if not bad or not good:
            return
        aim = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
        x, at = np.column_stack([raw, np.ones(len(raw))]), np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            move = np.linalg.solve(bend, (p - aim) @ x)
            at = at - move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        if at[0] > 0:
            self.scale, self.shift = float(at[0]), float(at[1])

    def fit(self, votes: np.ndarray, buckets: list[np.ndarray], labels: np.ndarray, steps: int = 24, ridge: float = 0.05, shrink: float = 0.2) -> None:
        """Full-batch steps, block by block, so that working memory does not follow the sample."""
        n = len(labels)
        if not n:
            return
        blocks = [(slice(at, at + BLOCK), _Block(buckets[at : at + BLOCK]).compact()) for at in range(0, n, BLOCK)]
        for _ in range(steps):
            slope, lean, bend = np.zeros(BUCKETS), ridge * self.dense, ridge * np.eye(len(self.dense))
            for part, block in blocks:
                x = self.features(votes[part])
                p = 1 / (1 + np.exp(-np.clip(x @ self.dense + block.sums(self.words), -30, 30)))
                error = p - labels[part]
                lean = lean + error @ x
                bend = bend + (x * (p * (1 - p))[:, None]).T @ x
                slope += block.spread(error)
            move = np.linalg.solve(bend, lean)
            self.dense -= move * min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
            self.words -= 2.0 * (slope + shrink * self.words) / n


class _Block:
    """Sparse rows of some documents: distinct buckets, each weighing one over the root of their number."""

    def __init__(self, buckets: list[np.ndarray]):
        sizes = np.array([len(b) for b in buckets], np.int64)
        self.n, self.scale = len(buckets), 1 / np.sqrt(np.maximum(sizes, 1))
        self.flat = np.concatenate(buckets).astype(np.int64) if buckets else np.array([], np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)

    def compact(self) -> _Block:
        """The same in half the memory, to be kept."""
        self.flat, self.row = self.flat.astype(np.uint16), self.row.astype(np.uint16)
        return self

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.flat], minlength=self.n) * self.scale

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=(values * self.scale)[self.row], minlength=BUCKETS)


class Scorer:
    """What one corpus and its labels teach: the voters, the label model and the classifier.

    Labels are taken from rows that are not held out (``crc32`` of the id as
    text, modulo 3, is not 1), of at most ``limit`` such rows with distinct
    texts; labels other than 0 and 1 are left out, contradictory ones count as
    toxic. The votes of every document are counted by pattern. With ``keep`` each
    document's votes and word buckets are stored as ``seen`` (``doc_id, votes,
    buckets``) and its text is not read again; without it nothing is stored per
    document, and texts are read a second time for their scores.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, keep: bool = False):
        source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
        # at most ``limit`` rows of an id and a bit
        sample = source.join(F.broadcast(chosen), "doc_id").groupBy(F.md5("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
        sample = stored(sample, "labelled")
        self.stems = stems = mine_stems(sample, MAX_VOTERS)
        self.k = k = len(Voters(stems).names)

        def vote(rows: Iterator[tuple]) -> Iterator[tuple]:
            """Vote patterns and their numbers, added up per task."""
            own, counts = Voters(stems), Counter()
            for (text,) in rows:
                counts[own.mask(own.words(text), text)] += 1
                if len(counts) > 100_000:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()

        def teach(rows: Iterator[tuple]) -> Iterator[tuple]:
            own = Voters(stems)
            for first, text in rows:
                mask, buckets = own.read(text)
                yield first, mask, buckets.tobytes()

        if keep:
            kind = docs.schema["doc_id"].dataType.simpleString()
            self.seen = stored(map_rows(source, teach, f"doc_id {kind}, votes long, buckets binary", rows=4096), "votes")
            counted = self.seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
        else:
            counted = map_rows(source.select("text"), vote, "votes long, n long", rows=4096).groupBy("votes").agg(F.sum("n").alias("n"))
        patterns = stored(counted, "patterns")
        taught = [(r[0], r[1], r[2]) for r in map_rows(sample.select("toxic", "text"), teach, "toxic int, votes long, buckets binary", rows=1024).collect()]  # at most ``limit`` rows
        toxic = np.array([t for t, _, _ in taught], np.int64)
        votes = LabelModel.unpack(np.array([v for _, v, _ in taught], np.int64), k) if taught else np.zeros((0, k))
        self.model = fit_label_model(patterns, votes, toxic)
        self.linear = None
        if taught:  # otherwise the label model's posterior is the score
            linear, words = LinearModel(k), [np.frombuffer(b, np.uint16) for _, _, b in taught]
            linear.fit(votes, words, 1 / (1 + np.exp(-self.model.logit(votes))))
            linear.calibrate(np.concatenate([linear.raw(votes[at : at + BLOCK], words[at : at + BLOCK]) for at in range(0, len(taught), BLOCK)]), toxic)
            self.linear = linear

    def score(self, voters: Voters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, posterior, votes) of some texts."""
        read = [voters.read(t or "") for t in texts]
        return self.judge(np.array([m for m, _ in read], np.int64), [b for _, b in read])

    def judge(self, masks: np.ndarray, buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, posterior, votes) of texts read before."""
        votes = LabelModel.unpack(masks, self.k)
        posterior = self.model.logit(votes)
        raw = self.linear.raw(votes, buckets) if self.linear else posterior
        squash = lambda z: np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 9)
        return squash(raw), squash(posterior), np.bitwise_count(masks.astype(np.uint64)).astype(np.int32)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted, posterior, votes`` per document.

    Scores depend on the text alone: equal texts, equal scores. Null texts count
    as empty and get the score of a text without words. Null ids and repeated
    rows are kept; very long texts are read whole. Without usable labels only the
    fixed voters speak. Empty tables give empty results; further columns are not
    read. See ``Scorer`` for the labels used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scorer = Scorer(docs, labels, limit, keep=True)
    seen, scorer.seen = scorer.seen, None  # tasks take the models along, not the table

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        while held := list(islice(rows, 1024)):
            found = scorer.judge(np.array([m for _, m, _ in held], np.int64), [np.frombuffer(b, np.uint16) for *_, b in held])
            yield from zip([key for key, *_ in held], *(x.tolist() for x in found))

    out = map_rows(seen, run, f"doc_id {kind}, score double, posterior double, votes int", rows=4096)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "posterior", "votes")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, columns unchanged; no shuffle.

    A row is judged by its own text, so equal texts go or stay together whatever
    their ids, rows without an id included. Empty tables change nothing; further
    columns may have any name.
    """
    scorer = Scorer(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = Voters(scorer.stems)
        for texts in batches:
            held = texts.tolist()
            parts = [scorer.score(voters, held[at : at + 256])[0] for at in range(0, len(held), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.array([], np.float64))

    return docs.filter(score(F.col("text")) < threshold)
