"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are added as log-likelihoods: byte trigrams of the text,
the language the markup declares, the suffix of the address, and the host. The
trigram model is counted over all labelled documents. How far a declaration, a
suffix or a host can be trusted is counted too: first every page gets its text
posterior, then grouped aggregation sums those posteriors per declaration,
suffix and host, each smoothed by the level above it (host by suffix, suffix by
everything), with the page's own share taken out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, map_rows, stored

BUCKETS = 1 << 15
#: Evidence tables up to this many rows are broadcast; larger ones are joined by shuffle, hot keys apart.
BROADCAST_ROWS = 50_000
#: Pseudo-counts that pull a host towards its suffix, and a suffix or declaration towards the whole.
HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 5.0, 20.0, 20.0
#: A text's evidence grows with its length; trigrams of running text repeat, so it is damped and bounded.
TEXT_DAMPING, TEXT_LIMIT = 0.25, 40.0
UNKNOWN = "und"
#: One in so many labelled rows must bear a language for it to be learnt: a size of the model.
RAREST = 256


def trigrams(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.array([], np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``text, lang`` of the rows with a language, ``lang, n``: how many bear each)."""
    known = docs.filter("lang is not null").select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    return known, stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-likelihood per language and trigram bucket, log prior) over all rows with a language.

    A language is learnt where at least one in ``RAREST`` of these rows bears it,
    so there are no more than ``RAREST``, whatever the column holds; rows of
    others teach nothing here, ``identify_all`` learns them too. Null and empty
    texts count towards the prior, repeated rows as often as they occur, texts of
    any length whole; without rows there is no language. Only ``text`` and
    ``lang`` are read.
    """
    known, sizes = _labelled(docs)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return _model(known, {r.lang: r.n for r in sizes.filter(F.col("n") * RAREST >= total).collect()})  # ``RAREST`` at most


def _model(known: DataFrame, found: dict[str, int], whole: float | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model of the languages ``found``; their priors are shares of ``whole``, by default of all of them."""
    langs = sorted(found)

    def tally(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict[str, np.ndarray] = {}
        for text, lang in rows:
            if lang in found:
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, c in counts.items():
            for k in np.flatnonzero(c).tolist():
                yield lang, k, int(c[k])

    sums = map_rows(known, tally, "lang string, bucket int, n long", rows=8192).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # ``BUCKETS`` figures per language, a language at a time
    each = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
    at = {x: k for k, x in enumerate(langs)}
    counts, size = np.full((len(langs), BUCKETS), 0.5), np.array([1.0 + found[x] for x in langs])
    for lang, buckets, ns in each.toLocalIterator():
        counts[at[lang], buckets] += ns
    return langs, np.log(counts / counts.sum(1, keepdims=True)), np.log(size / (whole or size.sum()))


def visible_text(html: Column) -> Column:
    """The text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """``kind, id, text, declared, suffix, host`` of web pages; what an address or markup lacks is null.

    One row per page, repeated pages and null ids included; null markup is empty,
    markup of any length is read whole. Only ``page_id, url, html`` are read, so
    other columns may have any name.
    """
    html = F.coalesce("html", F.lit(""))
    none = lambda c: F.when(c != "", c)
    host = none(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)))
    declared = none(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), visible_text(html).alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Plain documents: text, and their source in the host's place; one row per row, null texts empty, other columns not read."""
    gone = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), gone.alias("declared"), gone.alias("suffix"), F.col("source").alias("host"))


def _text_scores(likely: np.ndarray, text: str) -> np.ndarray:
    t = trigrams(text)
    return likely[:, t].sum(1) * TEXT_DAMPING if len(t) else np.zeros(len(likely))


def _with_counts(seen: DataFrame, n: int) -> DataFrame:
    """``seen`` with the sums of the ``n`` posteriors ``p`` per declaration, suffix and host, and the rows behind each."""
    parts = [F.sum(F.col("p")[k]).alias(f"n{k}") for k in range(n)]
    packed = F.array(*(F.col(f"n{k}") for k in range(n)))

    def counts(*by: str) -> DataFrame:
        return seen.filter(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(*parts, F.count(F.lit(1)).alias("rows"))

    hosts = counts("kind", "host").select(F.concat_ws(":", "kind", "host").alias("__host"), packed.alias("host_n"), F.col("rows").alias("__rows"))
    suffixes = counts("suffix").select(F.col("suffix").alias("__suffix"), packed.alias("suffix_n"), F.col("rows").alias("__suffix_rows"))
    declared = counts("declared").select(F.col("declared").alias("__declared"), packed.alias("declared_n"), F.col("rows").alias("__declared_rows"))
    total = seen.count()
    keyed = seen.withColumns({"__host": F.when(F.col("host").isNotNull(), F.concat_ws(":", "kind", "host")), "__suffix": F.col("suffix"), "__declared": F.col("declared")})
    for name, table, key, weight in (("declared", declared, "__declared", "__declared_rows"), ("suffixes", suffixes, "__suffix", "__suffix_rows"), ("hosts", hosts, "__host", "__rows")):
        table = stored(table, name)
        small = table.count() <= BROADCAST_ROWS
        keyed = keyed.join(F.broadcast(table), key, "left") if small else join_skewed(keyed, table, key, weight, total)
    return keyed


def _score(z: np.ndarray, p: np.ndarray, prior: np.ndarray, host_n, suffix_n, declared_n, host_rows=None, suffix_rows=None, declared_rows=None) -> np.ndarray:
    """Log score per language; with ``*_rows`` these languages are part of all, whose posteriors sum to the other rows."""

    def mixed(n: list[float], strength: float, over: np.ndarray, rows: int | None) -> np.ndarray:
        c = np.maximum(np.array(n) - p, 0)
        return (c + strength * over) / ((c.sum() if rows is None else rows - 1) + strength)

    whole = np.exp(prior)
    above, score = whole, z + prior
    if suffix_n is not None:
        above = mixed(suffix_n, SUFFIX_STRENGTH, whole, suffix_rows)
        score = z + np.log(above)
    if host_n is not None:  # the host's prior, smoothed by its suffix, takes the suffix's place
        score = z + np.log(mixed(host_n, HOST_STRENGTH, above, host_rows))
    if declared_n is not None:
        score = score + np.log(mixed(declared_n, DECLARED_STRENGTH, whole, declared_rows)) - prior
    return score


def identify(evidence: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``kind, id, lang, confidence, text_lang, declared, host`` per row of ``evidence``.

    Rows without any text rest on the other evidence and the prior. Ties go to
    the first language by code point. Null evidence counts for nothing; a host
    that holds a third of the rows is joined by broadcast of the few such hosts.
    Without a trained language every row is ``und`` with confidence 0. Repeated
    rows are judged alike and each weigh in their host's prior but not in their
    own; texts of any length are read whole; only the columns of
    ``page_evidence`` are read, so others may have any name.
    """
    langs, likely, prior = model
    n = len(langs)
    if not n:
        return evidence.select("kind", "id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_lang"), "declared", "host")

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, text in rows:
            z = _text_scores(likely, text)
            z = np.maximum(z - z.max(), -TEXT_LIMIT)
            p = np.exp(z + prior)
            yield *kept, z.tolist(), (p / p.sum()).tolist()

    schema = "kind string, id long, declared string, suffix string, host string, z array<double>, p array<double>"
    seen = stored(map_rows(evidence.select("kind", "id", "declared", "suffix", "host", "text"), read, schema, rows=4096), "text-posteriors")
    keyed = _with_counts(seen, n)

    def fuse(rows: Iterator[tuple]) -> Iterator[tuple]:
        for kind, key, said, host, z, p, *counts in rows:
            z, p = np.array(z), np.array(p)
            score = _score(z, p, prior, *counts)
            q = np.exp(score - score.max())
            best = int(q.argmax())
            yield kind, key, langs[best], round(float(q[best] / q.sum()), 9), langs[int((z + prior).argmax())], said, host

    out = keyed.select("kind", "id", "declared", "host", "z", "p", "host_n", "suffix_n", "declared_n")
    return map_rows(out, fuse, "kind string, id long, lang string, confidence double, text_lang string, declared string, host string", rows=4096)


def identify_all(evidence: DataFrame, docs: DataFrame, block: int = RAREST) -> DataFrame:
    """As ``identify`` by a model of every language that a row of ``docs`` bears, however rare.

    Up to ``block`` languages are one model. More are taken ``block`` at a time, in
    order of code points: each block scores all rows, the greatest score and the
    sum over all blocks normalise them, each block then fuses its own languages
    with the other evidence, and the best of the blocks wins. Memory holds one
    block; what is stored is rows times languages, as the method is.
    """
    known, sizes = _labelled(docs)
    n, rows = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n <= block:
        return identify(evidence, _model(known, {r.lang: r.n for r in sizes.collect()}))
    whole, held = float(rows + n), stored(evidence.withColumn("__id", F.monotonically_increasing_id()), "evidence")

    def blocks() -> Iterator[dict[str, int]]:
        names = sizes.orderBy("lang").toLocalIterator()
        while some := {r.lang: r.n for r in islice(names, block)}:
            yield some

    priors, scores = [], []  # a figure per language, a stored table per block
    for found in blocks():
        langs, likely, prior = _model(known, found, whole)

        def read(rows: Iterator[tuple], likely: np.ndarray = likely) -> Iterator[tuple]:
            for key, text in rows:
                z = _text_scores(likely, text)
                yield key, z.tolist(), float(z.max())

        priors.append((langs, prior))
        scores.append(stored(map_rows(held.select("__id", "text"), read, "__id long, z array<double>, top double", rows=4096), "block-scores"))
    tops = stored(reduce(DataFrame.unionByName, (s.select("__id", "top") for s in scores)).groupBy("__id").agg(F.max("top").alias("top")), "tops")
    weighed = []
    for (_, prior), table in zip(priors, scores):

        def weigh(rows: Iterator[tuple], prior: np.ndarray = prior) -> Iterator[tuple]:
            for key, z, top in rows:
                z = np.maximum(np.array(z) - top, -TEXT_LIMIT)
                w = np.exp(z + prior)
                yield key, z.tolist(), w.tolist(), float(w.sum())

        weighed.append(stored(map_rows(table.drop("top").join(tops, "__id").select("__id", "z", "top"), weigh, "__id long, z array<double>, w array<double>, part double", rows=4096), "block-weights"))
    sums = stored(reduce(DataFrame.unionByName, (w.select("__id", "part") for w in weighed)).groupBy("__id").agg(F.sum("part").alias("whole")), "sums")
    about = held.drop("text", "id")
    best = []
    for k, ((langs, prior), table) in enumerate(zip(priors, weighed)):

        def fuse(rows: Iterator[tuple], k: int = k, langs: list[str] = langs, prior: np.ndarray = prior) -> Iterator[tuple]:
            for key, z, p, *counts in rows:
                z = np.array(z)
                score, plain = _score(z, np.array(p), prior, *counts), z + prior
                one, two = int(score.argmax()), int(plain.argmax())
                yield key, k, langs[one], float(score[one]), float(np.exp(score - score[one]).sum()), langs[two], float(plain[two])

        seen = table.join(sums, "__id").select("__id", "z", F.transform("w", lambda x: x / F.col("whole")).alias("p"))
        keyed = _with_counts(stored(seen.join(about, "__id"), "block-posteriors"), len(langs))
        keyed = keyed.select("__id", "z", "p", "host_n", "suffix_n", "declared_n", "__rows", "__suffix_rows", "__declared_rows")
        best.append(stored(map_rows(keyed, fuse, "__id long, block int, lang string, score double, part double, text_lang string, plain double", rows=4096), "block-best"))
    every = reduce(DataFrame.unionByName, best)
    first = lambda lang, by: F.min_by(lang, F.struct(-F.col(by), F.col("block")))
    top = stored(every.groupBy("__id").agg(first("lang", "score").alias("lang"), first("text_lang", "plain").alias("text_lang"), F.max("score").alias("most")), "best")
    share = every.select("__id", "score", "part").join(top.select("__id", "most"), "__id").groupBy("__id").agg((1 / F.sum(F.col("part") * F.exp(F.col("score") - F.col("most")))).alias("q"))
    out = held.drop("text").join(top, "__id").join(share, "__id")
    return out.select("kind", "id", "lang", F.round("q", 9).alias("confidence"), "text_lang", "declared", "host")
