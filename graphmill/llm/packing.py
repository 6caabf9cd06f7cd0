"""Packing of documents into training windows with lexical neighbours.

Documents are encoded once. Whole windows of a long document are sequences of
their own; what remains of each document, its tail, is packed with others. Tails
are range-partitioned by a lexical key, so that related ones are neighbours and
no group, however large, is one task. A shard is a run of tails within a
partition. It has an inverted index with BM25 weights (document frequencies are
those of all tails of the corpus): a seed document retrieves unused neighbours by
score, which greedily fill its window; the one that does not fit is cut and its
rest seeds the next window. What is left over at the end of a partition is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

WINDOW = 1024
#: The id that ends every document.
END = 0
#: Tails of a shard, the documents that one index holds.
SHARD = 2048
#: Terms of a seed by which it retrieves, those of largest weight.
QUERY_TERMS = 24
#: Neighbours ranked for a seed at once; more are ranked when they do not fill the window.
RANKED = 32
K1, B = 1.2, 0.75
#: Terms name a lexical key only if so many documents have them, or a key would gather nobody.
LEAST_FREQUENCY = 64
#: Characters of a text that are encoded at once.
SLICE_CHARS = 1 << 20
#: Characters of the texts whose units are looked up together.
BATCH_CHARS = 1 << 22
#: Marks the first stretch of a text, which has nothing in front; a unit begins with no white space but a line end.
FIRST = "\r"
#: Units that are encoded as one text.
JOINED = 1024
#: Entries kept in a worker's table of units before it starts afresh.
MEMO_ENTRIES = 1_500_000

#: White space other than the space itself and the line end, as Python knows it.
BLANKS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_beside = re.compile(r" \s|\s ")


def unsafe(text: str) -> bool:
    """Whether some space of a text has white space, or the text's edge, beside it, or the text ends in white space."""
    if text[:1] == " " or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in BLANKS) and _beside.search(text) is not None


class Encoder:
    """Token ids of whole texts, by memoised units.

    A unit is a stretch between single spaces, led by its space: a space with no
    white space on either side always begins a pre-token, and no token crosses
    pre-tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        #: Tokens that begin with a space or a line end; byte-level vocabularies spell them so.
        self.led = {}
        for lead, mark in ((" ", "\u0120"), ("\n", "\u010a")):
            self.led[lead] = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.led[lead][[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(mark)]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, given to the library as the words of one input, which it treats apart."""
        out: list[bytes] = []
        parts = [texts[k : k + JOINED] for k in range(0, len(texts), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch(parts, is_pretokenized=True, add_special_tokens=False)):
            out += self._cut(np.array(e.ids, self.kind), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(1, len(part) + 1)))
        return out

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _units(self, units: list[str], lead: str = " ") -> list[bytes]:
        """The ids of units, each led by its space or line end and without another: joined they are one text, cut where a token begins so."""
        out: list[bytes] = []
        parts = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([lead + lead.join(part) for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            begin = np.flatnonzero(self.led[lead][ids])
            if len(begin) == len(part):
                out += self._cut(ids, np.append(begin[1:], len(ids)))
            else:
                out += self._each([lead + u for u in part])
        return out

    def _stretches(self, text: str) -> list[str] | str:
        """A text as its first stretch, marked, and the units after it; white space other than single spaces stays inside them.

        A text whose spaces all begin units is one string, still to be cut at them.
        """
        if not unsafe(text):
            # a lone line end is a pre-token of its own and begins a unit
            return FIRST + (text.replace("\n", " \n") if "\n" in text and "\n\n" not in text else text)
        units, out = (every := text.split(" "))[1:], every[:1]
        for u in units:
            if u and out[-1] and not u[0].isspace() and not out[-1][-1].isspace():
                out.append(u)
            else:
                out[-1] += " " + u
        self.odd.update(u for u in out[1:] if not u or " " in u or u[-1].isspace())
        out[0] = FIRST + out[0]
        return out

    def _learn(self, units: list[str]) -> None:
        """Put units into the memory that are not yet in it."""
        firsts, lines, odd, plain = [], [], [], []
        kinds = {FIRST: firsts, "\n": lines}
        for u in units:
            (odd if u in self.odd else kinds.get(u[:1], plain)).append(u)
        self.memo.update(zip(firsts, (np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([u[len(FIRST) :] for u in firsts], add_special_tokens=False))))
        self.memo.update(zip(lines, self._units([u[1:] for u in lines], "\n")))
        self.memo.update(zip(odd, self._each([" " + u for u in odd])))
        self.memo.update(zip(plain, self._units(plain)))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as the library gives them, special strings inside texts included.

        Units are cut and numbered by Arrow; the memory is asked once for each
        distinct unit of the texts, and ids are gathered by number.
        """
        memo, self.odd = self.memo, set()
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        parts = [[self._stretches(x) for x in slices(t, SLICE_CHARS)] for t in texts]
        flat = [x for p in parts for x in p]
        whole = [isinstance(x, str) for x in flat]
        cut = pc.split_pattern(pa.array([x for x, w in zip(flat, whole) if w], pa.large_string()), " ")
        listed = pa.array([x for x, w in zip(flat, whole) if not w], pa.list_(pa.large_string()))
        units = pa.concat_arrays([cut.flatten(), listed.flatten()]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(memo.get, distinct))
        if missing := [k for k, ids in enumerate(found) if ids is None]:
            self._learn([distinct[k] for k in missing])
            for k in missing:
                found[k] = memo[distinct[k]]
        blob, n = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        codes = units.indices.to_numpy()
        sizes = n[codes]
        ends = np.cumsum(sizes)
        ids = blob[np.repeat((np.cumsum(n) - n)[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        # where each part's ids lie: the whole ones come first
        lengths = np.concatenate([c.value_lengths().to_numpy() for c in (cut, listed)]).astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        stretches = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        one, other = iter(stretches[: len(cut)]), iter(stretches[len(cut) :])
        each = iter([next(one) if w else next(other) for w in whole])
        return [got[0] if len(got) == 1 else np.concatenate(got) for got in ([next(each) for _ in p] for p in parts)]


def slices(text: str, size: int) -> Iterator[str]:
    """Consecutive stretches of a text that the tokenizer treats apart: cut before single spaces, the spaces left with the later stretch."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:  # no such space that near: take the next one, however far
            cut = text.find(" ", at + size)
            while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its memory of units, per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Stored: ``at, doc_id, doc_tokens, crcs, first, tail``, and per task one row with null ``at`` whose ``tail`` counts documents by term.

    ``crcs`` are the checks of the document's whole windows, numbered from
    ``first``; ``tail`` holds the ids after them. Texts are read here and nowhere
    else. Rows are numbered by task and place, so all have numbers of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        enc = encoder(path)
        size = enc.tokenizer.get_vocab_size() + 1
        seen, frequency = np.zeros(size, bool), np.zeros(size, np.int64)
        place = TaskContext.get().partitionId() << 33
        number = place

        def flush(held):
            nonlocal place, number
            for (key, _), ids in zip(held, enc.encode_all([t for _, t in held])):
                ids = np.append(ids, enc.kind.type(END))
                whole = len(ids) // window
                tail = ids[whole * window :]
                seen[tail] = True
                terms = np.flatnonzero(seen)
                frequency[terms] += 1
                seen[terms] = False
                yield place, key, len(ids), [crc(w) for w in ids[: whole * window].reshape(whole, window)], number, tail.tobytes()
                place, number = place + 1, number + whole

        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += len(row[1])
            if weight > BATCH_CHARS:
                yield from flush(held)
                held, weight = [], 0
        yield from flush(held)
        yield None, None, 0, [], 0, frequency.tobytes()

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stored(map_rows(source, run, f"at long, doc_id {kind}, doc_tokens long, crcs array<long>, first long, tail binary", rows=1024), "encoded")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per term over the whole corpus, and the number of documents. The driver receives one figure per term of the vocabulary."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for (counts,) in rows:
            own = np.frombuffer(counts, np.int64)
            total = own if total is None else total + own
        if total is not None:
            used = np.flatnonzero(total)
            yield from zip(used.tolist(), total[used].tolist())

    counted = map_rows(rows.filter("at is null").select("tail"), run, "term int, n long", rows=65536).groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = rows.filter("at is not null").count()
    out = np.zeros(max((r.term for r in counted), default=0) + 1, np.int64)
    for r in counted:
        out[r.term] = r.n
    return out, n


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)


class Index:
    """A BM25 inverted index over the tails of one shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in tails])
        codes = np.sort(np.concatenate(tails).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(tails), dtype=np.uint64), sizes))
        lead = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[lead, len(codes)])
        self.docs = (codes[lead] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        terms = (codes[lead] >> np.uint64(32)).astype(np.int64)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.docs] / max(mean, 1.0)))
        self.weight = weight = weight.astype(np.float32)
        self.names, self.begin = np.unique(terms, return_index=True)
        self.end = np.r_[self.begin[1:], len(terms)]
        self.n = len(tails)
        # each document's terms, largest weight first; equal ones stay in their order
        of = np.repeat(np.arange(len(self.names)), self.end - self.begin)
        order = np.lexsort((-weight, self.docs))
        starts = np.searchsorted(self.docs[order], np.arange(self.n + 1))
        self.terms_of = [of[order[a : min(b, a + QUERY_TERMS)]] for a, b in zip(starts[:-1], starts[1:])]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the seed's leading terms."""
        lists = [slice(self.begin[t], self.end[t]) for t in self.terms_of[seed]]
        if not lists:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[s] for s in lists]), np.concatenate([self.weight[s] for s in lists]), self.n)


class Packer:
    """Fills windows shard by shard; yields pieces ``(doc_id, start, length, crc, doc_tokens, sequence, offset)``."""

    def __init__(self, idf: np.ndarray, mean: float, window: int = WINDOW, shard: int = SHARD, task: int = 0):
        self.idf, self.mean, self.window, self.shard = idf, mean, window, shard
        self.sequence, self.filled, self.open = task << 33, 0, []
        self.held: list[tuple] = []

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        self.held.append((key, start, ids, total))
        if len(self.held) == self.shard:
            yield from self._pack()

    def _put(self, tail: tuple) -> tuple[tuple | None, list[tuple]]:
        """Put a tail into the window; return its rest and, when the window is full, the window's pieces."""
        key, start, ids, total = tail
        room = min(self.window - self.filled, len(ids))
        self.open.append((key, start, ids[:room], total))
        self.filled += room
        done = self._close() if self.filled == self.window else []
        return ((key, start + room, ids[room:], total) if room < len(ids) else None), done

    def _close(self) -> list[tuple]:
        out, offset = [], 0
        for key, start, ids, total in self.open:
            out.append((key, start, len(ids), crc(ids), total, 2 * self.sequence + 1, offset))
            offset += len(ids)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1
        return out

    def _pack(self) -> Iterator[tuple]:
        tails, self.held = self.held, []
        index = Index([t[2] for t in tails], self.idf, self.mean)
        unused = np.ones(len(tails), bool)
        after = 0
        while True:
            while after < len(tails) and not unused[after]:
                after += 1
            if after == len(tails):
                return
            seed, last = after, None
            # the seed, then its neighbours, until a window closes; who is cut there seeds the next
            while seed is not None:
                unused[seed] = False
                rest, done = self._put(tails[seed])
                yield from done
                while rest is not None:
                    rest, done = self._put(rest)
                    yield from done
                if done and not self.open:
                    break
                scores = np.where(unused, index.scores(seed), 0.0)
                seed, ranked, closed = None, RANKED, False
                while not closed:
                    found = np.argsort(-scores, kind="stable")[:ranked] if ranked >= len(tails) else self._best(scores, ranked)
                    found = found[scores[found] > 0]
                    for k in found.tolist():
                        unused[k] = False
                        scores[k] = 0.0
                        rest, done = self._put(tails[k])
                        if done:
                            yield from done
                            if rest is not None:
                                rest, more = self._put(rest)
                                yield from more
                                last = k
                            closed = True
                            break
                    if len(found) < ranked:
                        break
                if closed and last is not None and self.open:
                    seed, last = self._next(index, unused, last), None
                elif not closed:
                    break  # no neighbour shares a term: the next unused document continues the window

    @staticmethod
    def _best(scores: np.ndarray, n: int) -> np.ndarray:
        top = np.argpartition(-scores, n)[:n]
        return top[np.lexsort((top, -scores[top]))]

    @staticmethod
    def _next(index: Index, unused: np.ndarray, seed: int) -> int | None:
        """The best unused neighbour of the document whose rest opened the window."""
        scores = np.where(unused, index.scores(seed), 0.0)
        best = int(scores.argmax()) if len(scores) else 0
        return best if len(scores) and scores[best] > 0 else None

    def finish(self) -> Iterator[tuple]:
        """Pack what is held; cut the last, partly filled window into sequences whose lengths are powers of two."""
        if self.held:
            yield from self._pack()
        waiting, left = self.open, self.filled
        self.open, self.filled, window = [], 0, self.window
        for tail in waiting:
            rest = tail
            while rest is not None:
                if not self.open:
                    self.window = 1 << (left.bit_length() - 1)
                    left -= self.window
                rest, done = self._put(rest)
                yield from done
        self.window = window


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece of a document in a sequence.

    Every id of every document, and the end id after it, lies in exactly one
    piece; pieces of a sequence are gapless from offset 0 and at most ``window``
    ids long together. ``path`` is a tokenizers JSON file present on every
    executor. A null text is empty and leaves its end id alone; null ids are
    kept; repeated rows are packed as often as they occur, told apart by their
    place; an empty table gives an empty one; texts of any length are encoded in
    slices; further columns are not read.
    """
    rows = encoded(docs, path, window)
    frequency, n = frequencies(rows)
    idf = inverse_frequency(frequency, n)
    # a term as common as a shard is large, or rarer, gathers those that have it
    rare = np.where(frequency >= min(LEAST_FREQUENCY, max(1, n // 16)), idf, -1.0).astype(np.float32)
    tails = rows.filter("at is not null and length(tail) > 0")
    mean = tails.agg(F.avg(F.col("doc_tokens") - F.size("crcs") * window)).first()[0] or 1.0
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = _id_width(path)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The term of largest weight that is not too rare, of each tail."""
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("tail")).to_pylist()
            if texts:
                ids = np.frombuffer(b"".join(texts), width)
                sizes = np.array([len(t) // width.itemsize for t in texts])
                begin = np.cumsum(sizes) - sizes
                weight = rare[ids]
                top = np.maximum.reduceat(weight, begin)
                at = np.flatnonzero(weight == np.repeat(top, sizes))
                owner = np.repeat(np.arange(len(texts)), sizes)[at]
                lead = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[at[lead]].astype(np.int32))], names=[*batch.schema.names, "term"])

    fields = f"at long, doc_id {kind}, doc_tokens long, tail binary, term int"
    placed = tails.select("at", "doc_id", "doc_tokens", "tail").mapInArrow(keyed, fields)
    placed = placed.repartitionByRange("term", "at").sortWithinPartitions("term", "at")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        packer = Packer(idf, mean, window, shard, TaskContext.get().partitionId())
        for key, total, tail in rows:
            ids = np.frombuffer(tail, width)
            yield from packer.add(key, total - len(ids), ids, total)
        yield from packer.finish()

    pieces = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = map_rows(placed.select("doc_id", "doc_tokens", "tail"), run, pieces, rows=65536)
    whole = rows.filter("size(crcs) > 0").select("doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (2 * (F.col("first") + F.col("k"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def _id_width(path: str) -> np.dtype:
    return encoder(path).kind
