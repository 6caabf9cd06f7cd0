"""Compression of vectors to code strings: product quantisation whose assignments are Orchard searches.

Every entry of a codebook keeps the other entries in order of their distance to
it. A search walks the list of the best entry so far; a better entry makes it
jump to that entry's list, entries already measured are marked and skipped, and
it ends where the list is further away than twice the current distance: by the
triangle inequality nothing beyond can be nearer. All arithmetic is on integers,
so results are exact and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries measured first, spread over the codebook; the walk begins at the best of them.
STARTS = 16
#: Neighbours read from a list at once.
STEP = 16
#: Scaled components beyond this would let sums of squares leave 64 bits; they are refused.
LARGEST = 1 << 23
BATCH = 4096
FAR = np.iinfo(np.int64).max


class Orchard:
    """Exact nearest entries of one codebook, ``entries`` an integer matrix with a row per entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries = np.ascontiguousarray(entries, np.int64)
        self.doubles, self.largest = entries.astype(np.float64), int(np.abs(entries).max()) if entries.size else 0
        n = len(entries)
        norms = (entries * entries).sum(1)
        self.apart = norms[:, None] + norms[None, :] - 2 * (entries @ entries.T)
        self.near = np.empty((n, max(0, n - 1)), np.int64)
        for k in range(n):
            order = np.argsort(self.apart[k], kind="stable")
            self.near[k] = order[order != k]
        self.reach = np.take_along_axis(self.apart, self.near, 1)
        self.starts = np.unique(np.linspace(0, n - 1, min(n, STARTS)).astype(np.int64))

    def _distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of rows to some entries each. In doubles where all sums stay below 2 to the 53, so either way exact."""
        delta = x[:, None, :] - (self.doubles if x.dtype == np.float64 else self.entries)[entries]
        return np.einsum("ijk,ijk->ij", delta, delta).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row of ``x``, its squared distance, and how many distances were measured."""
        n, last = len(x), self.near.shape[1]
        largest = max(int(np.abs(x).max()) if x.size else 0, self.largest)
        if 4 * largest * largest * max(1, x.shape[1]) < 1 << 53:
            x = x.astype(np.float64)
        rows = np.arange(n)
        seen = np.zeros((n, len(self.entries)), bool)
        seen[:, self.starts] = True
        first = self._distances(x, np.broadcast_to(self.starts, (n, len(self.starts))))
        at = first.argmin(1)
        best, found, measured = first[rows, at], self.starts[at], first.size
        place = np.zeros(n, np.int64)
        active = rows
        while len(active):
            # a place at the end of the list, or a neighbour beyond twice the distance, ends the walk; equality may still be a tie
            active = active[place[active] < last]
            active = active[self.reach[found[active], place[active]] <= 4 * best[active]]
            if not len(active):
                break
            columns = np.minimum(place[active, None] + np.arange(STEP), last - 1)
            cand = self.near[found[active, None], columns]
            fresh = ~seen[active[:, None], cand] & (self.reach[found[active, None], columns] <= 4 * best[active, None])
            place[active] += STEP
            some = fresh.any(1)
            who, cand, fresh = active[some], cand[some], fresh[some]
            if not len(who):
                continue
            seen[who[:, None], cand] |= fresh
            measured += int(fresh.sum())
            d = np.where(fresh, self._distances(x[who], cand), FAR)
            least = d.min(1)
            what = np.where(d == least[:, None], cand, len(self.entries)).min(1)
            better = (least < best[who]) | ((least == best[who]) & (what < found[who]))
            who = who[better]
            best[who], found[who], place[who] = least[better], what[better], 0
        return found, best, measured


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Consecutive parts, equal where ``parts`` divides ``width``."""
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vec``: rows whose vector is whole and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(vector_col).cast("array<double>")
    return df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")).filter(~F.exists("vec", bad))


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer vectors of a batch that have ``width`` components, and the rows that bear them."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    rows = np.flatnonzero(sizes == width)
    if len(rows) < len(sizes):
        column = column.take(pa.array(rows))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(SCALE))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST / SCALE} in size; its squared distances would leave 64 bits")
    return flat.astype(np.int64).reshape(len(rows), width), rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, ascending; equal ids by their components, null ids last."""
    scaled = F.transform("vec", lambda x: F.floor(x * SCALE))
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), scaled).limit(entries).select(scaled.alias("q")).collect()  # ``entries`` rows
    if not rows:
        return [np.zeros((0, 0), np.int64)] * PARTS
    width = len(rows[0].q)
    whole = np.array([r.q for r in rows if len(r.q) == width], np.int64).reshape(-1, width)
    return [whole[:, a:b] for a, b in cuts(width)]


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: every entry becomes the floor of its parts' mean; unused entries stay.

    A task sends one sum per entry and component, whatever its rows; sums are
    added up by Spark, and the driver receives as many figures as a codebook has.
    """
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in _chunks(batches):
            q, _ = _matrix(batch.column(0), width)
            for k, (a, b) in enumerate(cuts(width)):
                found, _, _ = searches[k].nearest(q[:, a:b])
                order = np.argsort(found, kind="stable")
                used, begin = np.unique(found[order], return_index=True)
                if len(used):
                    sums[k][used] += np.add.reduceat(q[order, a:b], begin, axis=0)
                    counts[k] += np.bincount(found, minlength=len(counts[k]))
        for k, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            cells = [(k, e, d, v) for e in used.tolist() for d, v in enumerate([int(n[e]), *s[e].tolist()])]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "dim", "value"])

    cells = vectors.select("vec").mapInArrow(run, "part int, entry int, dim int, value long").groupBy("part", "entry", "dim").agg(F.sum("value").alias("value"))
    totals = {(r.part, r.entry, r.dim): r.value for r in cells.collect()}  # at most entries x (components + parts) figures
    out = [b.copy() for b in books]
    for (part, entry, dim), value in totals.items():
        if dim:
            out[part][entry, dim - 1] = value // totals[part, entry, 0]
    return out


def assigned(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of every vector; those of another width than the codebooks get null code and error."""
    width = sum(b.shape[1] for b in books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        for batch in _chunks(batches):
            q, rows = _matrix(batch.column(2), width)
            codes, error = np.zeros((len(q), PARTS), np.uint8), np.zeros(len(q), np.int64)
            for k, (a, b) in enumerate(cuts(width)):
                found, distance, _ = searches[k].nearest(q[:, a:b])
                codes[:, k], error = found, error + distance
            shown, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for r, c, e in zip(rows.tolist(), codes, error.tolist()):
                shown[r], errors[r] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 over all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every whole and finite vector.

    Vectors that are null or hold nulls, NaN or infinities are left out. The
    width is that of the vector with the smallest id; a vector of another width
    gets null ``code`` and ``error`` and takes no part in the codebooks. Fewer
    vectors than entries make smaller codebooks. Null ids sort last, equal ids by
    their components; repeated rows count as often as they occur; null labels are
    one label. A width that four does not divide is cut as evenly as it can be.
    An empty table gives an empty one; further columns are not read. Components
    beyond ``LARGEST / SCALE`` in size are refused with an error.
    """
    vectors = kept_vectors(df, id_col, vector_col, label_col)
    books = first_codebooks(vectors)
    for _ in range(rounds):
        books = refined(vectors, books)
    out = stored(assigned(vectors, books), "codes").withColumn("same", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    labels = stored(out.groupBy("same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-errors")
    named = join_skewed(out, labels, "same", "rows", out.count(), "inner")
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


