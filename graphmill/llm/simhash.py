"""SimHash near-duplicates by exact tiled comparison.

Texts become 64-bit fingerprints; distinct fingerprints are packed into tiles of
equal population count, and tiles meet only when their counts differ by no more
than the radius, since the Hamming distance is at least that difference. Inside
a pair of tiles numpy compares all fingerprints by exclusive-or and bit count.
Each task sends on a spanning forest of the links it finds, so a large group of
near copies costs rows in proportion to its size, and components are found by
label propagation with pointer jumping over stored tables.

Where a similarity is asked for (``similar_groups``), tiles of all fingerprints
would meet too often: there texts meet only where the least hashes of their
shingles meet (``proposals``). Fingerprints then only propose: within the
components of a wide radius each link is decided on the five-word shingles
themselves. Texts are near copies at a similarity of 0.8 or more: of
their shingle sets (Jaccard), or, where at least half of these are shared, of
their words, a word counting as shared when a shared shingle covers it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, join_skewed, map_rows, stored

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Wide fingerprints: 512 bits over distinct five-word shingles. They differ in an arc cosine of the cosine similarity: where
#: half of all shingles are shared in 137 bits on average (standard deviation 10), in 187 where three tenths are, in 256 else.
WIDE_WORDS = 5
WIDE_BITS = 512
WIDE_RADIUS = 88
#: Texts are near copies when so much of their distinct five-word shingles is shared (Jaccard), or at least ``LEAST_SHARED``
#: of these and so much of their words.
LEAST_SHARE = 0.8
LEAST_SHARED = 0.5
#: Pairs up to this distance are compared exactly: 4.8 standard deviations beyond the mean at ``LEAST_SHARED``.
CANDIDATE_RADIUS = 185
#: Texts meet by the least of their shingle hashes, so many at most. Near copies share ``SKETCH_SHARED`` of these at least, or what
#: short texts can: certainly up to some 120 shingles, beyond but for a chance of 2.4e-15 a pair at a share of one half.
SKETCH, SKETCH_SHARED = 64, 4
#: Shingles that more sketches hold count as common: a line of many texts.
COMMON = 256
#: Shingle sets compared at once in a task: so many, and so many bytes of them.
SET_TILE, SET_BYTES = 1024, 2 << 20
TILE = 8192
#: Tiles per cell: two classes of many tiles meet in as many join keys as they have pairs of cells.
CELL = 2
ROWS_AT_ONCE = 32
WIDE_ROWS_AT_ONCE = 8


def _shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles, repeats included; fewer words make one shingle, none make none."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [joined] if tokens else []
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes whose bits are set where over half of the rows have them set."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        ones += np.unpackbits(hashes[at : at + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text: majority bits over its word shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    shingles = _shingles(text, words)
    if not shingles:
        return 0
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    return int(_majority(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def _spread(hashes: np.ndarray) -> np.ndarray:
    """``WIDE_BITS`` pseudo-random bits of each hash, as rows of bytes."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.astype("<u8").view(np.uint8).reshape(len(hashes), -1)


def shingle_hashes(text: str | None, words: int = WIDE_WORDS) -> np.ndarray:
    """The 64-bit hashes of all shingles in order; texts without words have one empty shingle."""
    from xxhash import xxh3_64_intdigest

    shingles = _shingles(text, words) or [b""]
    return np.fromiter(map(xxh3_64_intdigest, shingles), np.uint64, len(shingles))


def shingle_list(text: str | None, words: int = WIDE_WORDS) -> tuple[bytes, np.ndarray]:
    """``WIDE_BITS`` of SimHash and ``shingle_hashes``."""
    hashes = shingle_hashes(text, words)
    return _majority(_spread(np.unique(hashes))).tobytes(), hashes


def wide_fingerprint(text: str | None, words: int = WIDE_WORDS) -> bytes:
    """``WIDE_BITS`` of SimHash; texts without words share a value far from all others."""
    return shingle_list(text, words)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """``doc_id, fp, ones``: one row per document, ``fp`` as a signed long or, if ``wide``, 64 bytes. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            if wide:
                fp = wide_fingerprint(text)
                yield key, fp, int(np.bitwise_count(np.frombuffer(fp, np.uint8)).sum())
            else:
                fp = fingerprint(text)
                yield key, fp - (1 << 64) if fp >> 63 else fp, fp.bit_count()

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, fp {'binary' if wide else 'long'}, ones int", rows=4096)


class Forest:
    """Union-find over array positions; links are merged in bulk and only roots matter."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        parent = self.parent
        while True:
            a, b = parent[u], parent[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) that span the components of two tiles' fingerprints (``b`` None: one tile with itself).

    Tiles have a row of 64-bit words per fingerprint; results are row numbers in
    ``a`` followed by ``b``.
    """
    other, shift, n = (a, 0, len(a)) if b is None else (b, len(a), len(a) + len(b))
    forest, width = Forest(n), a.shape[1]
    step = ROWS_AT_ONCE if width == 1 else WIDE_ROWS_AT_ONCE
    words = [np.ascontiguousarray(other[:, k]) for k in range(width)]
    differ = lambda at, begin, k: np.bitwise_count(a[at : at + step, k : k + 1] ^ words[k][None, begin:])
    for at in range(0, len(a), step):
        begin = at + 1 if b is None else 0
        if width == 1:
            near = differ(at, begin, 0) <= radius
        else:  # one half of the bits differs in at most half of the radius, or the sum exceeds it (256 counts as 0 and is sorted out below)
            near = False
            for half in (range(width // 2), range(width // 2, width)):
                apart = differ(at, begin, half[0])
                for k in half[1:]:
                    apart += differ(at, begin, k)
                near |= apart <= radius // 2
        if near.any():
            i, j = np.nonzero(near)
            i, j = i + at, j + begin
            if b is None:
                i, j = i[j > i], j[j > i]
            if width > 1:
                close = np.bitwise_count(a[i] ^ other[j]).sum(1, dtype=np.int64) <= radius
                i, j = i[close], j[close]
            forest.link(i, j + shift)
    child = np.flatnonzero(forest.parent != np.arange(n))
    return child, forest.parent[child]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """``fp_a, fp_b``: links that connect exactly what all links within ``radius`` connect.

    ``distinct`` has one row per fingerprint: ``fp, ones``. Classes of population
    counts are as wide as keeps their number small; the only collected figures
    are the counts per class, 65 at most. Tiles of a class are dealt into cells
    of ``cell`` tiles, and every pair of cells is a join key of its own, so no
    task holds more than the tiles of some cells, whatever the class's size.
    """
    spark = distinct.sparkSession
    kind = distinct.schema["fp"].dataType.simpleString()
    width = 1 if kind == "bigint" else WIDE_BITS // 64
    counted = distinct.select("fp", F.floor(F.col("ones") / (4 * width if width > 1 else 1)).cast("int").alias("ones"))
    reach = radius if width == 1 else -(-radius // (4 * width))
    sizes = {r[0]: r[1] for r in counted.groupBy("ones").count().collect()}
    made = f"fp_a {kind}, fp_b {kind}"
    if not sizes:
        return spark.createDataFrame([], made)
    tiles_of = {k: -(-n // tile) for k, n in sizes.items()}
    table = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    per_class, cells_of = table(tiles_of), table({k: -(-n // cell) for k, n in tiles_of.items()})
    tiles = counted.withColumn("sub", F.pmod(F.xxhash64("fp", F.lit(7)), F.element_at(per_class, F.col("ones")))).groupBy("ones", "sub").agg(F.collect_list("fp").alias("fps"))
    tiles = stored(tiles.withColumn("cell", F.floor(F.col("sub") / cell).cast("int")), "tiles")

    def meets(low: int, high: int):
        """Every cell of the classes that are so far away."""
        classes = F.filter(F.sequence(F.col("ones") + low, F.col("ones") + high), lambda c: c.isin(list(sizes)))
        return F.explode(F.flatten(F.transform(classes, lambda c: F.transform(F.sequence(F.lit(0), F.element_at(cells_of, c) - 1), lambda q: F.struct(c.alias("ones"), q.cast("int").alias("cell"))))))

    left = tiles.select(F.col("ones").alias("a_ones"), F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.col("fps").alias("a"), meets(0, reach).alias("m"))
    right = tiles.select(F.col("ones").alias("b_ones"), F.col("cell").alias("b_cell"), F.col("sub").alias("b_sub"), F.col("fps").alias("b"), meets(-reach, 0).alias("m"))
    left = left.select("a_ones", "a_cell", "a_sub", "a", F.col("m.ones").alias("b_ones"), F.col("m.cell").alias("b_cell"))
    right = right.select("b_ones", "b_cell", "b_sub", "b", F.col("m.ones").alias("a_ones"), F.col("m.cell").alias("a_cell"))
    upper = (F.col("a_ones") < F.col("b_ones")) | (F.col("a_cell") <= F.col("b_cell"))  # one of both orders within a class
    keys = ["a_ones", "a_cell", "b_ones", "b_cell"]
    pairs = sum(n * tiles_of.get(k + d, 0) for k, n in tiles_of.items() for d in range(reach + 1))
    tasks = min(10_000, max(8, pairs // 4))
    met = left.filter(upper).repartition(tasks, *keys).join(right.filter(upper).repartition(tasks, *keys).hint("shuffle_hash"), keys).filter((F.col("a_ones") < F.col("b_ones")) | (F.col("a_sub") <= F.col("b_sub")))
    met = met.select("a", F.when((F.col("a_ones") < F.col("b_ones")) | (F.col("a_sub") < F.col("b_sub")), F.col("b")).alias("b"))

    def run(batches):
        import pyarrow as pa

        def words(cell) -> np.ndarray:
            if width == 1:
                return cell.values.to_numpy().view(np.uint64)[:, None]
            return np.frombuffer(b"".join(cell.as_py()), np.uint64).reshape(-1, width)

        found: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            u, v = (np.concatenate(x) for x in zip(*found))
            names, at = np.unique(np.concatenate([u, v]), axis=0, return_inverse=True)
            at = at.reshape(-1)
            forest = Forest(len(names))
            forest.link(at[: len(u)], at[len(u) :])
            child = np.flatnonzero(forest.parent != np.arange(len(names)))
            return names[child], names[forest.parent[child]]

        for batch in batches:
            for k in range(batch.num_rows):
                a, cell = words(batch.column(0)[k]), batch.column(1)[k]
                b = words(cell) if cell.is_valid else None
                child, root = tile_forest(a, b, radius)
                if len(child):
                    both = a if b is None else np.concatenate([a, b])
                    found.append((both[child], both[root]))
                    if sum(len(x) for x, _ in found) > 1 << 20:
                        found[:] = [merged()]
        if found:
            sides = merged()
            for at in range(0, len(sides[0]), 65536):
                part = [x[at : at + 65536] for x in sides]
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64) if width == 1 else [r.tobytes() for r in x]) for x in part], names=["fp_a", "fp_b"])

    return met.mapInArrow(run, made)


def _mark(df: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and sums over two hashes."""
    return df.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2))).first()


def components(edges: DataFrame) -> DataFrame:
    """``fp, root``: for each vertex of ``edges`` (``fp_a, fp_b``) the least vertex it can reach.

    Alternating stars: a large star moves a vertex's greater neighbours to its
    least one, a small star joins its lesser neighbours to the least of them,
    until every vertex hangs on the least of its component. Minima are combined
    before they are shuffled, and the edges of hubs meet theirs where they are
    (``join_skewed``). Tables are stored between rounds, so a lost executor costs
    one round.
    """
    found = stored(edges.filter("fp_a <> fp_b").select(F.greatest("fp_a", "fp_b").alias("u"), F.least("fp_a", "fp_b").alias("v")).distinct(), "edges")
    mark = _mark(found)
    while mark[0]:
        around = found.select("v", F.col("u").alias("other"), F.lit(1).alias("up")).union(found.select("u", "v", F.lit(0)))
        least = stored(around.groupBy("v").agg(F.least(F.min("other"), F.col("v")).alias("m"), F.sum("up").alias("n")).filter("n > 0"), "large-star")
        large = stored(join_skewed(found, least, "v", "n", mark[0], "inner").select("u", F.col("m").alias("v")).distinct(), "large-stars")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small-star")
        moved = join_skewed(large, least, "u", "n", large.count(), "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = stored(moved.union(least.select("u", "m")).distinct(), "small-stars")
        before, mark = mark, _mark(found)
        if mark == before:
            break
    return found.toDF("fp", "root").union(found.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, wide: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    ``fingerprint`` is lower-case hex digits, 16 or, if ``wide``, 128;
    ``component_id`` the least ``doc_id`` reachable over links of at most
    ``radius`` differing bits. Null and empty texts have one fingerprint (zero,
    if not ``wide``) and link like any other. Repeated rows are kept; a null
    ``doc_id`` never names a component unless all its members are null. An empty
    table gives an empty one; further columns are not read.
    """
    marked = stored(fingerprints(docs, wide=wide), "fingerprints")
    groups = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("ones").alias("ones")), "groups")
    total = marked.count()
    roots = components(links(groups, radius))
    rooted = stored(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "first", "rows", "root"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    named = stored(join_skewed(rooted, least, "root", "n", groups.count(), "inner").select("fp", "component_id", "rows"), "named")
    out = join_skewed(marked, named, "fp", "rows", total, "inner")
    shown = F.lower(F.hex("fp")) if wide else F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", shown.alias("fingerprint"), "component_id")


def sketch(kinds: np.ndarray, shared_least: float = LEAST_SHARED) -> tuple[bytes, int]:
    """The least of a text's distinct shingle hashes (``kinds``, ascending), 8 bytes each, and how many of them any near copy's sketch holds too.

    A near copy shares at least ``shared_least`` of the distinct shingles of
    either text, so that many places before the end of any common order the
    sketches must have met; ``SKETCH`` of them are kept.
    """
    overlap = max(1, math.ceil(shared_least * len(kinds) - 1e-9))
    need = min(SKETCH_SHARED, overlap)
    return kinds[: min(SKETCH, len(kinds) - overlap + need)].tobytes(), need


def bucket_links(bucket: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) of ids that span what is within ``radius`` in one bucket; equal ``bucket`` values stand together."""
    names, at = np.unique(ids, return_inverse=True)
    forest, first, apart = Forest(len(names)), np.arange(len(ids)), 1
    while True:
        first = first[first + apart < len(ids)]
        first = first[bucket[first] == bucket[first + apart]]
        if not len(first):
            break
        for begin in range(0, len(first), 65536):
            u = first[begin : begin + 65536]
            u = u[np.bitwise_count(fps[u] ^ fps[u + apart]).sum(1, dtype=np.int64) <= radius]
            forest.link(at[u], at[u + apart])
        apart += 1
    child = np.flatnonzero(forest.parent != np.arange(len(names)))
    return names[child], names[forest.parent[child]]


def proposals(texts: DataFrame, radius: int) -> DataFrame:
    """``fp_a, fp_b``: links of ids that connect all near copies within ``radius`` bits.

    ``texts`` is a stored table of distinct ``id, fp, sketch, need``. Texts that
    share a hash of their sketches meet in its bucket, where fingerprints are
    compared. A bucket of at most ``COMMON`` texts is compared whole, so that
    work follows the texts. Near copies that share no such hash share common
    ones alone, ``need`` of them at least: texts with fewer do not meet there,
    and the others only in their rarest buckets, as many as must have one in
    common. Such buckets are cut into tiles that meet pairwise in tasks of their
    own; their work is quadratic in texts made of the same common lines, not in all texts.
    """
    import pyarrow as pa

    made = "fp_a long, fp_b long"
    link = lambda child, root: pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["fp_a", "fp_b"])

    def spread(batches):
        for batch in batches:
            held = batch.column("sketch").to_pylist()
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) // 8 for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(held), np.int64)), pa.array(ids)], names=["h", "id"])

    postings = texts.select("id", "sketch").mapInArrow(spread, "h long, id long")
    often = postings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(postings.join(often, "h"), "shared")
    fps = texts.select("id", "fp", "need")

    def near(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column("h").to_numpy(), batch.column("id").to_numpy(), np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(batch.num_rows, -1)]
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            end = np.searchsorted(rows[0], rows[0][-1])  # the last bucket may go on
            held = [x[end:] for x in rows]
            yield link(*bucket_links(*(x[:end] for x in rows), radius))
        if held:
            yield link(*bucket_links(*held, radius))

    rare = shared.filter(F.col("n") <= COMMON).select("h", "id").join(fps.select("id", "fp"), "id").select("h", "id", "fp")
    found = rare.repartition("h").sortWithinPartitions("h").mapInArrow(near, made)

    lists = shared.filter(F.col("n") > COMMON).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("hs"))
    lists = lists.join(fps, "id").filter(F.size("hs") >= F.col("need"))
    lists = lists.select("id", "fp", F.explode(F.slice("hs", F.lit(1), F.size("hs") - F.col("need") + 1)).alias("s"))
    members = stored(lists.select("s.h", "id", "fp"), "common-members")
    sizes = stored(members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "common-sizes")
    pairs = sizes.agg(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2)).first()[0]
    if not pairs:
        return found
    cut = members.join(checked(sizes.select("h", "tiles")), "h").withColumn("tile", F.pmod(F.xxhash64("id", F.lit(13)), F.col("tiles")).cast("int"))
    tiles = stored(cut.groupBy("h", "tiles", "tile").agg(F.collect_list(F.struct("id", "fp")).alias("m")), "common-tiles")
    left = tiles.select("h", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.col("m").alias("a"))
    right = tiles.select("h", F.col("tile").alias("j"), F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("m").alias("b"))
    right = right.withColumn("b", F.when(F.col("i") < F.col("j"), F.col("b")))  # a tile meets itself once
    keys, tasks = ["h", "i", "j"], min(10_000, max(8, int(pairs) // 4))
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_hash"), keys).select("a", "b")

    def across(batches):
        def side(cell) -> tuple[np.ndarray, np.ndarray]:
            ids, words = cell.values.flatten()
            return ids.to_numpy(), np.frombuffer(b"".join(words.to_pylist()), np.uint64).reshape(len(ids), -1)

        for batch in batches:
            for k in range(batch.num_rows):
                (ids, a), cell = side(batch.column(0)[k]), batch.column(1)[k]
                b = None
                if cell.is_valid:
                    more, b = side(cell)
                    ids = np.concatenate([ids, more])
                child, root = tile_forest(a, b, radius)
                yield link(ids[child], ids[root])

    return found.union(met.mapInArrow(across, made))


def covered(shared: np.ndarray, words: int = WIDE_WORDS) -> int:
    """Words that shared shingles cover; ``shared`` has a flag per shingle, in order."""
    at = np.flatnonzero(shared)
    return int(np.minimum(np.diff(at), words).sum()) + words if len(at) else 0


def similar_links(one: list[dict], two: list[dict] | None, share: float, shared_least: float, radius: int) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """Links (signature pairs) that connect what all near copies within ``radius`` connect, and each member's group.

    Members are ``sig, fp, shingles, part``, the shingles in order: those of a
    list that have one ``part`` are connected already. ``two`` None compares
    ``one`` with itself. Pairs already connected are not compared again; a member
    meets the others in growing blocks, whose shared shingles are counted at
    once. What shares too little for ``share`` but ``shared_least`` is decided by
    the words that shared shingles cover.
    """
    both = one + (two or [])
    lengths = np.array([len(m["shingles"]) // 8 for m in both])
    ends_of = np.cumsum(lengths)
    _, code = np.unique(np.frombuffer(b"".join(m["shingles"] for m in both), np.uint64), return_inverse=True)
    text = lambda k: code[ends_of[k] - lengths[k] : ends_of[k]]
    # distinct shingles of each member
    kinds = np.unique(np.repeat(np.arange(len(both)), lengths).astype(np.int64) << 40 | code)
    sizes = np.bincount(kinds >> 40, minlength=len(both))
    starts, kinds = np.cumsum(sizes) - sizes, kinds & ((1 << 40) - 1)
    held, other = np.zeros(int(code.max()) + 1, bool), np.zeros(int(code.max()) + 1, bool)
    fps = np.frombuffer(b"".join(m["fp"] for m in both), np.uint64).reshape(len(both), -1)
    root = np.array([m["part"] for m in one] + [m["part"] + len(one) for m in two or []])
    found = []

    def alike(i: int, j: int, n: int) -> bool:
        if n >= share * (sizes[i] + sizes[j] - n):
            return True
        theirs = kinds[starts[j] : starts[j] + sizes[j]]
        other[theirs] = True
        common = covered(held[text(j)]) + covered(other[text(i)])
        other[theirs] = False
        return common >= share * (lengths[i] + lengths[j] + 2 * (WIDE_WORDS - 1))

    for i in range(len(one)):
        begin = i + 1 if two is None else len(one)
        others = np.flatnonzero(root[begin:] != root[i]) + begin
        others = others[np.minimum(sizes[i], sizes[others]) >= shared_least * np.maximum(sizes[i], sizes[others])]
        others = others[np.bitwise_count(fps[i] ^ fps[others]).sum(1, dtype=np.int64) <= radius]
        if not len(others):
            continue
        mine, block = kinds[starts[i] : starts[i] + sizes[i]], 1
        held[mine] = True
        while len(others):
            some, others = others[:block], others[block:]
            ends = np.cumsum(sizes[some])
            at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes[some]), sizes[some])
            shared = np.add.reduceat(held[kinds[at]], ends - sizes[some], dtype=np.int64)
            enough = shared >= shared_least * (sizes[i] + sizes[some] - shared)
            for j, n in zip(some[enough].tolist(), shared[enough].tolist()):
                if root[i] != root[j] and alike(i, j, n):
                    found.append((both[i]["sig"], both[j]["sig"]))
                    root[root == root[j]] = root[i]
            others, block = others[root[others] != root[i]], min(4 * block, 256)
        held[mine] = False
    return found, root


def _signature(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def similar_groups(docs: DataFrame, share: float = LEAST_SHARE, shared_least: float = LEAST_SHARED, radius: int = CANDIDATE_RADIUS) -> DataFrame:
    """``doc_id, sig, component_id, first_sig`` for every document: components of near copies.

    A pair is one where at least ``share`` of the distinct five-word shingles is
    shared (Jaccard), or at least ``shared_least`` of them and these cover
    ``share`` of the words of both. Pairs within ``radius`` bits are candidates;
    each is decided by its shingles, unless other pairs connect it already. Large candidate groups
    are cut into tiles; a tile finds its own groups first, then tiles meet
    pairwise. ``sig`` stands for the shingles in their order; ``first_sig`` is the least
    ``sig`` that bears ``component_id`` in the component. Null, empty and
    repeated rows count as in ``near_duplicates``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")

    def mark(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            hashes = shingle_hashes(text)
            kinds = np.unique(hashes)
            yield key, _signature(hashes), _majority(_spread(kinds)).tobytes(), len(hashes), *sketch(kinds, shared_least)

    marked = stored(map_rows(source, mark, f"doc_id {kind}, sig binary, fp binary, size int, sketch binary, need int", rows=4096), "marked")
    of_sig = [F.min(c).alias(c) for c in ("fp", "sketch", "need")]  # equal in all rows of one
    sigs = marked.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("size").cast("long").alias("size"), *of_sig)
    sigs = stored(sigs.withColumn("id", F.monotonically_increasing_id()), "signatures")
    total, texts = marked.count(), sigs.count()
    roots = components(proposals(sigs.select("id", "fp", "sketch", "need"), radius)).withColumnRenamed("fp", "id")
    rooted = stored(sigs.select("id", "sig", "first", "size").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).select("sig", "root", "first", "size"), "rooted")
    per_root = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.greatest(F.count(F.lit(1)) / SET_TILE, F.sum("size") * 8 / SET_BYTES)).alias("parts")).filter("n > 1")
    loose = stored(join_skewed(rooted, stored(per_root, "loose-sizes"), "root", "n", texts, "inner").select("sig", "root", "parts", "first"), "loose")

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            fp, hashes = shingle_list(text)
            yield _signature(hashes), fp, hashes.tobytes()

    some = source.join(loose.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").unionByName(source.filter("doc_id is null"))
    each = map_rows(some.select("text"), sets, "sig binary, fp binary, shingles binary", rows=1024).join(loose.select("sig", "root", "parts"), "sig").dropDuplicates(["sig"])
    tiles = each.withColumn("tile", F.pmod(F.xxhash64("sig", F.lit(11)), F.col("parts"))).groupBy("root", "parts", "tile").agg(F.collect_list(F.struct("sig", "fp", "shingles", F.lit(0).alias("part"))).alias("members"))
    member = "array<struct<sig:binary,fp:binary,shingles:binary,part:int>>"
    link = "array<struct<fp_a:binary,fp_b:binary>>"

    def own(rows: Iterator[tuple]) -> Iterator[tuple]:
        """A tile's own groups: a star of links for each, and the members if other tiles will meet them."""
        for root, parts, tile, members in rows:
            for k, m in enumerate(members):
                m["part"] = k
            _, groups = similar_links(members, None, share, shared_least, radius)
            for m, g in zip(members, groups.tolist()):
                m["part"] = g
            star = [{"fp_a": m["sig"], "fp_b": members[g]["sig"]} for m, g in zip(members, groups.tolist()) if m is not members[g]]
            yield root, parts, tile, members if parts > 1 else [], star

    tiles = stored(map_rows(tiles, own, f"root long, parts long, tile long, members {member}, star {link}", rows=64), "set-tiles")
    large = tiles.filter("parts > 1")
    star = tiles.select(F.explode("star").alias("s")).select("s.fp_a", "s.fp_b")
    if large.limit(1).count():
        left = large.filter("tile + 1 < parts").select("root", F.col("members").alias("a"), F.explode(F.sequence(F.col("tile") + 1, F.col("parts") - 1)).alias("tile"))
        met = left.join(large.select("root", "tile", F.col("members").alias("b")), ["root", "tile"]).select("a", "b")

        def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
            for one, two in rows:
                yield from similar_links(one, two, share, shared_least, radius)[0]

        # members of one-tile groups know their group; only the groups of larger ones still have to meet
        across = stored(map_rows(met, compare, "fp_a binary, fp_b binary", rows=65536), "across")
        inner = large.select(F.explode("star").alias("s")).select("s.fp_a", "s.fp_b")
        known = tiles.filter("parts = 1").select(F.explode("star").alias("s")).select(F.col("s.fp_a").alias("sig"), F.col("s.fp_b").alias("sig_root"))
        named = components(inner.unionByName(across)).toDF("sig", "sig_root").unionByName(known)
    else:
        named = star.toDF("sig", "sig_root")
    settled = stored(sigs.join(named, "sig", "left").select("sig", "first", "rows", F.coalesce("sig_root", "sig").alias("sig_root")), "settled")
    least = settled.groupBy("sig_root").agg(F.min(F.struct(F.col("first").isNull().alias("gone"), "first", "sig")).alias("f"), F.count(F.lit(1)).alias("n"))
    least = stored(least.select("sig_root", F.col("f.first").alias("component_id"), F.col("f.sig").alias("first_sig"), "n"), "least")
    final = stored(join_skewed(settled, least, "sig_root", "n", texts, "inner").select("sig", "component_id", "first_sig", "rows"), "named")
    return join_skewed(marked.select("doc_id", "sig"), final, "sig", "rows", total, "inner").select("doc_id", "sig", "component_id", "first_sig")


def keep_first(docs: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """The documents that stay: of each component one row, that with the least ``doc_id``, all columns unchanged.

    Components link near copies, see ``similar_groups``; null and empty texts are
    alike. A
    row without an id stays only where no row of its component has one. Rows that
    share an id are told apart by their shingles: unrelated texts under one id all
    stay; of rows equal in id and shingles the one with the least text stays, and
    of rows that differ in other columns alone any one. An empty table stays
    empty; further columns may have any name.
    """
    found = stored(similar_groups(docs, share), "found")
    kept = stored(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sig") == F.col("first_sig"))).select("doc_id", "sig").distinct(), "kept")
    several = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "several")
    if not several.limit(1).count():  # ids are unique: what goes is fewer than what stays
        gone = stored(found.filter("not (doc_id <=> component_id)").select("doc_id"), "gone")
        return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)
    named = docs.filter("doc_id is not null")
    single = named.join(kept.join(several, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    twice = named.join(several, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))

    @F.pandas_udf("binary")
    def signature(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _signature(shingle_hashes(t)))

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = twice.select(row.alias("r"), signature("text").alias("s"))
    match = F.col("r.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("sig"))
    ours = rows.join(kept.join(several.filter("doc_id is not null"), "doc_id", "left_semi").unionByName(kept.filter("doc_id is null")), match)
    one = ours.groupBy(F.col("doc_id"), F.col("sig")).agg(F.min_by("r", F.struct(F.col("r.text").isNotNull(), F.col("r.text"))).alias("r"))
    return single.unionByName(one.select("r.*"))
