"""A Merkle manifest of a dataset: every row a leaf, a tree per source, a tree over the sources.

A level is built by a slot pivot: conditional aggregates spread the children of
a parent into one column per slot. All columns concatenated give the parent's
hash; a row's columns without its own slot are its siblings. Levels shrink by
the fan-out and are stored, so a lost executor costs one level at most; proofs
are handed down from the roots, once per parent and not once per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, numbered, stored

FANOUT = 16
#: Rows whose unsigned CRC-32 of the decimal id this number divides are the ones that verification tampers with.
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """A value so that neighbours cannot run into each other: ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row of documents; ``changed`` replaces fields by other columns."""
    return F.sha2(F.concat(*(framed(changed.get(f, F.col(f))) for f in FIELDS)), 256)


def _up(n: Column) -> Column:
    """Parents of ``n`` children."""
    return F.floor((n + (FANOUT - 1)) / FANOUT).cast("long")


def _spread(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """``grp, n, p`` and a column ``c<slot>`` per child of parent ``p``: its ``hash`` and the carried columns."""
    slot = F.pmod("pos", F.lit(FANOUT))
    cells = [F.max(F.when(slot == k, F.struct("hash", *carried))).alias(f"c{k}") for k in range(FANOUT)]
    return nodes.groupBy("grp", "n", F.floor(F.col("pos") / FANOUT).cast("long").alias("p")).agg(*cells)


def _joined(slots) -> Column:
    """The hashes of some slot columns, in order, absent ones left out."""
    columns = [F.col(f"c{k}.hash") for k in slots]
    return F.concat_ws("", *columns) if columns else F.lit("")


def climb(nodes: DataFrame, carried: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels above ``nodes`` (``grp, n, pos, hash`` and carried columns), and ``grp, hash`` of every group's root.

    ``n`` is the number of nodes of the group, ``most`` the largest of them. Of a
    lone node the root is the node itself.
    """
    levels, roots = [], nodes.filter("n = 1").select("grp", "hash")
    nodes = nodes.filter("n > 1")
    while most > 1:
        level = stored(_spread(nodes, carried), f"merkle-{len(levels)}")
        levels.append(level)
        above = level.select("grp", _up(F.col("n")).alias("n"), F.col("p").alias("pos"), F.sha2(_joined(range(FANOUT)), 256).alias("hash"))
        roots = roots.unionByName(above.filter("n = 1").select("grp", "hash"))
        nodes, carried, most = above.filter("n > 1"), [], -(-most // FANOUT)
    return levels, stored(roots, "merkle-roots")


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes below ``levels`` with their ``path``: what stands left and right of them, level by level upwards.

    ``tops`` has ``grp``, the ``path`` of each group's root and further columns,
    which every node of the group gets.
    """
    more = [c for c in tops.columns if c not in ("grp", "path")]
    below = None
    for level in reversed(levels):
        known = level.filter(F.col("n") <= FANOUT).join(tops, "grp")
        if below is not None:
            inner = level.filter(F.col("n") > FANOUT).join(below.select("grp", F.col("pos").alias("p"), "path", *more), ["grp", "p"])
            known = known.unionByName(inner.select(*known.columns))
        child = [F.when(F.col(f"c{k}").isNotNull(), F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("own"), F.struct(_joined(range(k)).alias("left"), _joined(range(k + 1, FANOUT)).alias("right")).alias("sides"))) for k in range(FANOUT)]
        each = known.select("grp", "p", "path", *more, F.explode(F.array_compact(F.array(*child))).alias("x"))
        below = each.select("grp", (F.col("p") * FANOUT + F.col("x.slot")).alias("pos"), "x.own.*", F.concat(F.array("x.sides"), "path").alias("path"), *more)
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its ancestors give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: one row per row of documents.

    A leaf hashes ``doc_id, source, lang, n_chars, text``, nulls told apart from
    any text. Leaves of a source ascend by ``doc_id`` (null last), then by their
    hash, so repeated rows are interchangeable and keep a place each; a null
    source is one of its own and comes first. Verification replays the proof of
    every row, with the text of some rows put into lower case: only these can
    fail, and a text without upper case letters still verifies. Empty texts and
    texts of any length are leaves like others, an empty table gives an empty
    one, and further columns are not read.
    """
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0, F.lit(False))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(hit, leaf_hash(text=F.translate("text", capitals, capitals.lower())))
    source = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    # narrow rows are stored before they are range-partitioned, which samples its input: texts are read once
    leaves = stored(docs.select("doc_id", source.alias("src"), leaf_hash().alias("hash"), tampered.alias("tampered")), "leaves")
    rows, total, row = numbered(leaves, ["src", "doc_id", "hash"], "merkle-leaves")
    groups = stored(rows.groupBy("src").agg(F.min(row).alias("grp"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    most = groups.agg(F.max("n")).first()[0] or 0
    placed = join_skewed(rows, groups, "src", "n", total, "inner")
    placed = placed.select("grp", "n", (F.col(row) - F.col("grp")).alias("pos"), "hash", "doc_id", "tampered")
    lone = placed.filter("n = 1").select("grp", "hash", "doc_id", "tampered")
    levels, subroots = climb(placed, ["doc_id", "tampered"], most)

    sources, count, at = numbered(subroots, ["grp"], "merkle-subroots")  # a group is named by its first row, so groups are in order of source
    tops, root = climb(sources.select(F.lit(0).cast("long").alias("grp"), F.lit(count).cast("long").alias("n"), F.col(at).alias("pos"), "hash", F.col("grp").alias("source_grp")), ["source_grp"], count)
    path = "array<struct<left:string,right:string>>"
    if tops:
        start = docs.sparkSession.createDataFrame([(0, [])], f"grp long, path {path}")
        of_source = descend(tops, start).select(F.col("source_grp").alias("grp"), "path", F.col("hash").alias("subroot"))
    else:
        of_source = subroots.select("grp", F.lit(None).cast(path).alias("path"), F.col("hash").alias("subroot")).withColumn("path", F.coalesce("path", F.array().cast(path)))
    of_source = stored(of_source, "merkle-paths")
    found = lone.join(of_source, "grp").select("doc_id", "hash", "tampered", "path", "subroot")
    if levels:
        found = found.unionByName(descend(levels, of_source).select(*found.columns))
    top = root.first()
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(top["hash"] if top else None).cast("string").alias("root"), F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
