"""Token counts of whole texts, exact for documents of any length.

Huge documents are cut into overlapping chunks, each chunk is encoded with
offsets, and neighbours are spliced at a pre-token boundary that both chunks
have in their overlap. The splice is proven, not assumed: the tokenizer splits a
text from left to right and looks ahead but never behind, so

* two parses that share one boundary agree on everything to its right, and
* a boundary of the left chunk is final once it lies further from the chunk's
  end than the longest look-ahead (a contraction or an added token).

Where the overlap holds no shared boundary the chunk is encoded again with twice
the overlap, until one is found or the chunk starts where its neighbour did,
which aligns trivially.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
#: Texts above this many characters are encoded chunk by chunk.
HUGE_CHARS = 32768
#: Entries kept in a worker's table of counts before it starts afresh.
MEMO_ENTRIES = 400_000


class SpliceEncoder:
    """Counts tokens of one huge text by overlap resynchronisation."""

    def __init__(self, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        added = tokenizer.get_added_tokens_decoder().values()
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        #: No boundary this close to a chunk's end is trusted.
        self.margin = max([4, *(len(t.content) for t in added)])

    def _starts(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """(position in the text, tokens before it) of each pre-token of a chunk, then its end."""
        enc = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        out, last = [], object()
        for k, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
            if word != last:
                out.append((start + a, k))
                last = word
        out.append((stop, len(enc.ids)))
        return out

    def count(self, text: str) -> int:
        size = len(text)
        at, stop = 0, min(size, self.chunk)
        left = self._starts(text, 0, stop)
        total, base = 0, 0  # tokens before the left chunk's trusted part; where that part begins in its own count
        while stop < size:
            overlap = self.overlap
            while True:
                start = max(at, stop - overlap)
                end = min(size, start + max(self.chunk, 2 * overlap))
                right = self._starts(text, start, end)
                ahead = dict(right[:-1])
                shared = next(((p, k) for p, k in reversed(left[:-1]) if start <= p <= stop - self.margin and k >= base and p in ahead and end > stop), None)
                if shared is not None:
                    break
                if start == at:  # the same start, a longer chunk: nothing to splice
                    shared = (at, base)
                    ahead = {at: base}
                    break
                overlap *= 2
            position, k = shared
            total += k - base
            at, stop, left, base = start, end, right, ahead[position]
        return total + left[-1][1] - base


_units_unsafe = re.compile(r" \s|\s ")


class TokenCounter:
    """Counts per text; short texts by memoised units, huge ones by ``SpliceEncoder``.

    A unit is a stretch between single spaces, led by its space. A space that has
    no white space on either side always begins a pre-token, so counts of units
    add up; texts without that property go to the library whole.
    """

    def __init__(self, path: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.huge, self.splice, self.memo = huge, SpliceEncoder(self.tokenizer, chunk, overlap), {}

    def count_all(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        whole, split, missing = [], {}, {}
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for i, text in enumerate(texts):
            if len(text) > self.huge:
                out[i] = self.splice.count(text)
            elif any(s in text for s in self.special) or _units_unsafe.search(text):
                whole.append(i)
            else:
                first, *units = text.split(" ")
                split[i] = first, units
                for u in units:
                    if u not in memo:
                        missing[u] = None
        if missing:
            new = list(missing)
            for u, e in zip(new, self.tokenizer.encode_batch_fast([" " + u for u in new], add_special_tokens=False)):
                memo[u] = len(e.ids)
        look = memo.__getitem__
        rest = [*whole, *split]
        encoded = self.tokenizer.encode_batch_fast([*(texts[i] for i in whole), *(first for first, _ in split.values())], add_special_tokens=False) if rest else []
        for i, e in zip(rest, encoded):
            out[i] = len(e.ids) + (sum(map(look, split[i][1])) if i in split else 0)
        return out


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a tokenizers JSON file present on every executor. A null text
    counts as empty: 0 bytes, 0 tokens. Null ids are kept, repeated rows give
    repeated results, an empty table gives an empty one, and other columns are
    not read, so their names cannot clash. No shuffle: each partition is streamed.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = TokenCounter(path, huge, chunk, overlap)

        def flush(held):
            texts = [t for _, t in held]
            for (key, text), n in zip(held, counter.count_all(texts)):
                yield key, len(text.encode()), n, n > limit

        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += len(row[1])
            if weight > 1 << 20:
                yield from flush(held)
                held, weight = [], 0
        if held:
            yield from flush(held)

    return map_rows(source, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", rows=4096)
