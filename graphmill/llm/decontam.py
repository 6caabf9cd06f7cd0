"""Benchmark decontamination by spaced-seed hashing.

A mask marks which of a window's tokens count; the rest may be anything, so a
passage with substituted words still shares some masked window with its source.
Masked windows of the test items and of the documents meet on their hash, and
the whole diagonal of each meeting is searched for the stretch with the most
matching tokens of which four fifths match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, free_name, join_skewed, map_rows, row_key, stored

# fixed values: windows of 8 to 11 tokens of which 6 count. Every stretch of 12 to 22 tokens of which four fifths match holds a
# window that matches under one of them, wherever the others lie; so do longer ones, which can be cut into such stretches of
# which one has the share.
MASKS = ("11101011", "110110011", "1100110011", "1011100101", "11010000111")
#: Matching tokens that make an overlap, or all but a fifth of a shorter item.
LEAST_TOKENS = 12
LEAST_SHARE = 0.8
#: Up to this many test windows are sent to every task; beyond it the hashes are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000

_word = re.compile(r"\w+")
_mult = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(16)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word.encode())
        return value


class Windows:
    """Token hashes of a text and its masked windows."""

    def __init__(self, masks: tuple[str, ...] = MASKS):
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in masks]
        self.spans = [len(m) for m in masks]
        self.memo = _Hashes()

    def tokens(self, text: str) -> np.ndarray:
        if len(self.memo) > 500_000:
            self.memo.clear()
        words = _word.findall(text.lower())
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def hashes(self, tokens: np.ndarray, k: int) -> np.ndarray:
        """The hash of the window that begins at each place, under mask ``k``."""
        n = len(tokens) - self.spans[k] + 1
        if n <= 0:
            return np.array([], np.uint64)
        with np.errstate(over="ignore"):
            out = np.full(n, k + 1, np.uint64)
            for j, at in enumerate(self.masks[k]):
                x = (tokens[at : at + n] ^ (out >> np.uint64(29))) * _mult[j]
                out = (out + (x ^ (x >> np.uint64(32)))) * _mult[j + 6]
        return out


def verify(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matches, first, end) in the document of the stretch of one diagonal that holds most matches, ``LEAST_SHARE`` of it at least.

    Document place ``p`` faces item place ``p - shift``; the earliest such
    stretch, beginning and ending with a match; (0, 0, 0) without any match.
    """
    low, high = max(0, shift), min(len(doc), shift + len(item))
    same = doc[low:high] == item[low - shift : high - shift]
    matched = np.concatenate([[0], np.cumsum(same)])
    if not matched[-1]:
        return 0, 0, 0
    # a stretch from i to j has the share when score[j] >= score[i] (+1 match, -4 substitution); the first such i of each j
    score = 5 * matched - 4 * np.arange(len(matched))
    begin = np.searchsorted(-np.minimum.accumulate(score), -score)
    end = int((matched - matched[begin]).argmax())
    first = int(begin[end])
    return int(matched[end] - matched[first]), low + first + int(same[first:].argmax()), low + end


def accepted(matches: int, item: int) -> bool:
    return matches >= min(LEAST_TOKENS, LEAST_SHARE * item)


def best_overlap(doc: np.ndarray, item: np.ndarray, shifts: set[int]) -> tuple[int, int, int] | None:
    """(matches, first, end) of the best accepted overlap along any of the diagonals where windows met."""
    found = [verify(doc, item, shift) for shift in shifts]
    return min((x for x in found if accepted(x[0], len(item))), key=lambda x: (-x[0], *x[1:]), default=None)


def overlaps(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, item_id, matches, first_token, end_token, item_tokens``: the best verified overlap of each pair.

    Tokens are runs of word characters, lower-cased. A pair counts when at least
    ``LEAST_TOKENS`` tokens match (four fifths of shorter items) and four fifths
    of the stretch do; the masks lose none of these but overlaps with items of
    fewer than 12 tokens and some substitution. Items too short for every mask are found where all their
    tokens stand in a row, those without tokens nowhere. Null texts hold no
    token; rows without an id are reported under a null id; repeated rows are
    one pair; ties take the earliest place. Only the columns named are read.
    Empty tables give an empty result.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tests = stored(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")

    least = min(map(len, MASKS))

    def lengths(rows: Iterator[tuple]) -> Iterator[tuple]:
        windows = Windows()
        yield from ((n,) for n in {len(windows.tokens(text)) for (text,) in rows} if n < least)

    # items of fewer tokens than any mask spans get a mask that is as long as they are; fewer than ``least`` such masks
    short = sorted(r[0] for r in map_rows(tests.select("text"), lengths, "n int").distinct().collect() if r[0])
    masks = MASKS + tuple("1" * n for n in short)

    def indexed(windows: Windows, tokens: np.ndarray, k: int) -> np.ndarray:
        return windows.hashes(tokens, k) if k < len(MASKS) or len(tokens) == short[k - len(MASKS)] else np.array([], np.uint64)

    def seeds(rows: Iterator[tuple]) -> Iterator[tuple]:
        windows = Windows(masks)
        for item, sig, text in rows:
            tokens = windows.tokens(text)
            for k in range(len(masks)):
                for at, h in enumerate(indexed(windows, tokens, k).view(np.int64).tolist()):
                    yield item, sig, k, at, h

    seed_schema = f"item_id {item_kind}, item_sig string, mask int, item_at int, hash long"
    made = f"doc_id {kind}, item_id {item_kind}, matches int, first_token int, end_token int, item_tokens int"
    table = map_rows(tests.select("item_id", F.md5("text"), "text"), seeds, seed_schema, rows=4096)
    count = table.count()
    if count <= broadcast_windows:
        packed = [(r[0], r[1]) for r in tests.collect()] if count else []
        windows = Windows(masks)
        tokens = [windows.tokens(text) for _, text in packed]
        index = []
        for k in range(len(masks)):
            each = [indexed(windows, t, k) for t in tokens]
            h = np.concatenate(each) if each else np.array([], np.uint64)
            item = np.repeat(np.arange(len(each)), [len(x) for x in each])
            at = np.concatenate([np.arange(len(x)) for x in each]) if each else h
            order = np.argsort(h, kind="stable")
            index.append((h[order], item[order], at[order]))
        # one index for all tasks, of at most ``broadcast_windows`` windows
        held = docs.sparkSession.sparkContext.broadcast(([i for i, _ in packed], tokens, index))

        def near(rows: Iterator[tuple]) -> Iterator[tuple]:
            windows, (names, tokens, tables) = Windows(masks), held.value
            index = []
            for h, item, at in tables:
                bits = np.zeros(1 << 20, bool)  # most windows end at this table
                bits[h & np.uint64((1 << 20) - 1)] = True
                index.append((h, item, at, bits))
            for doc, text in rows:
                found = windows.tokens(text)
                shifts: dict[int, set[int]] = {}
                for k, (h, item, at, bits) in enumerate(index):
                    mine = windows.hashes(found, k)
                    places = np.flatnonzero(bits[mine & np.uint64((1 << 20) - 1)])
                    low = np.searchsorted(h, mine[places], "left")
                    high = np.searchsorted(h, mine[places], "right")
                    for p, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
                        for m in range(a, b):
                            shifts.setdefault(int(item[m]), set()).add(p - int(at[m]))
                for i, of in shifts.items():
                    if best := best_overlap(found, tokens[i], of):
                        yield doc, names[i], *best, len(tokens[i])

        pairs = map_rows(source, near, made, rows=4096)
    else:

        def spread(rows: Iterator[tuple]) -> Iterator[tuple]:
            windows = Windows(masks)
            for doc, sig, text in rows:
                tokens = windows.tokens(text)
                for k in range(len(masks)):
                    for at, h in enumerate(windows.hashes(tokens, k).view(np.int64).tolist()):
                        yield doc, sig, k, at, h

        # texts are told apart by a digest; pairs that met get both whole texts back
        signed = source.select("doc_id", F.md5("text").alias("sig"), "text")
        hits = map_rows(signed, spread, f"doc_id {kind}, sig string, mask int, doc_at int, hash long", rows=4096)
        met = hits.join(table, ["mask", "hash"]).groupBy("doc_id", "sig", "item_id", "item_sig").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
        met = stored(met, "met")
        item_texts = tests.select(F.md5("text").alias("item_sig"), F.col("text").alias("item_text")).dropDuplicates(["item_sig"])
        item_texts = stored(item_texts.join(met.groupBy("item_sig").agg(F.count(F.lit(1)).alias("n")), "item_sig"), "item-texts")
        facing = join_skewed(met, item_texts, "item_sig", "n", met.count(), "inner").withColumnsRenamed({"doc_id": "__id", "sig": "__sig"})
        whole = facing.join(signed, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__sig") == F.col("sig")))

        def check(rows: Iterator[tuple]) -> Iterator[tuple]:
            windows = Windows()
            for doc, text, item, item_text, shifts in rows:
                a, b = windows.tokens(text), windows.tokens(item_text)
                if best := best_overlap(a, b, set(shifts)):
                    yield doc, item, *best, len(b)

        pairs = map_rows(whole.select("doc_id", "text", "item_id", "item_text", "shifts"), check, made, rows=4096)
    place = F.struct((-F.col("matches")).alias("m"), "first_token", "end_token", "item_tokens")
    best = pairs.groupBy("doc_id", "item_id").agg(F.min(place).alias("p"))
    return best.select("doc_id", "item_id", (-F.col("p.m")).alias("matches"), "p.first_token", "p.end_token", "p.item_tokens")


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a verified overlap, columns unchanged.

    Every row is judged by its own text: rows without an id and rows that share
    one with another text included. Null and empty texts stay, repeated rows
    share their fate, empty tables change nothing; further columns may have any
    name.
    """
    key = row_key()
    found = overlaps(docs.select(key.alias("doc_id"), "text"), items)
    name = free_name(docs, "__key")
    bad = stored(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(checked(bad), key == bad[name], "left_anti").select(*docs.columns)
