"""Sharding by a keyed Feistel permutation over global row numbers.

Row ``r`` of ``n`` goes to ``p = permute(r)``, shard ``p % shards``, slot
``p // shards``: a full shuffle without sorting by random keys, computable for
one row alone, the same on every run, and invertible. The permutation works on
the smallest power of two that holds ``n``; results outside ``[0, n)`` are
permuted again (cycle walking), which takes under two steps on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) used as the round function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _once(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    low = bits // 2
    high = bits - low
    for k in keys:  # the halves swap, and so do their widths
        left, right = x >> np.uint64(low), x & np.uint64((1 << low) - 1)
        left = left ^ (_mix(right + k) & np.uint64((1 << high) - 1))
        x = (right << np.uint64(high)) | left
        low, high = high, low
    return x


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permuted positions of row numbers in ``[0, n)``."""
    if n <= 1:
        return np.zeros(len(rows), np.int64)
    bits = max(2, int(n - 1).bit_length())
    keys = _round_keys(seed)
    with np.errstate(over="ignore"):
        out = _once(rows.astype(np.uint64), bits, keys)
        while len(walk := np.flatnonzero(out >= np.uint64(n))):
            out[walk] = _once(out[walk], bits, keys)
    return out.astype(np.int64)


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes differ by one row at most. ``order`` names the columns that give
    rows their global number; rows equal in all of them are interchangeable.
    Nulls sort last, repeated rows get different slots, an empty table stays
    empty. Input columns named ``shard`` or ``slot`` are replaced.
    """
    rows, n, number = numbered(df.drop("shard", "slot"), order, "feistel")
    schema = df.drop("shard", "slot").schema.add("shard", "integer").add("slot", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(number)
            p = permute(batch.column(at).to_numpy(zero_copy_only=False), n, seed)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for c in batch.schema.names if c != number]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*names, "shard", "slot"])

    return rows.mapInArrow(run, schema)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Shard every document by its number in ``doc_id`` order; sizes and checks ride along, texts do not.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size``
    is the UTF-8 length plus 1 (null text: 1), the law held is ``rows``.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = stored(narrow, "sizes")  # range partitioning samples its input: texts are read once, not twice
    out = shard_rows(narrow, shards, ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
