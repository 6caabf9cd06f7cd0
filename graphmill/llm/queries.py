"""Registered queries of the training-data operators, with their SQL where it exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, feistel, langid, merkle, mixing, orchard, packing, simhash, tiff, token_counts, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.document_digests(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.conversations(chat.format_chat(turns)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_documents(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    evidence = langid.page_evidence(pages).unionByName(langid.document_evidence(docs))
    found = langid.identify_all(evidence, docs)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(of("document").alias("doc_id"), of("page").alias("page_id"), "lang", "confidence", "text_lang", "declared", "host")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_tiff, op2_chat, op3_warc, op4_decontamination, op5_token_counts, op6_sharding, op7_mixing, op8_simhash, op9_language, op10_toxicity, op11_orchard, op12_packing, op13_merkle, pipeline)
    return {f.__name__: f for f in own}


def _chat_sql(template: chat.Template = chat.INSTRUCT) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    steps = [(template.escape, template.escape + "0"), *((c, template.escape + chr(97 + k)) for k, c in enumerate(template.control))]
    escaped = lambda c: reduce(lambda t, s: f"replace({t}, {quote(s[0])}, {quote(s[1])})", steps, c)
    marks = " ".join(f"WHEN role = {quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in template.marks.items())
    other = sum(len(m.replace("{role}", "")) for m in template.other)
    after = {role: to for (_, role), to in template.moves.items()}
    state = "CASE " + " ".join(f"WHEN before = {quote(r)} THEN {quote(s)}" for r, s in after.items()) + " END"
    moves = ", ".join(f"({quote(s)}, {quote(r)})" for s, r in template.moves)
    final = ", ".join(quote(r) for r, s in after.items() if s in template.final)
    return f"""
WITH probe AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(1) OVER w IS NULL AS last
  FROM probe WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, coalesce((CASE WHEN k = 1 THEN {quote(template.start)} ELSE {state} END, role) IN ({moves}), false)
    AND (NOT last OR role IN ({final})) AS good FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role IN ({', '.join(map(quote, template.trained))}) THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({', '.join(map(quote, template.trained))})), '')) AS loss_sha256,
  ({len(template.begin) + len(template.end)} + sum(length({escaped('text')}) + CASE {marks} ELSE {other} + length({escaped('role')}) END))::BIGINT AS formatted_chars,
  bool_and(good) AS valid
FROM judged GROUP BY conv_id"""


WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, min(page_id) AS leader, count(*) AS n FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN l.leader IS NOT NULL AND p.page_id IS DISTINCT FROM l.leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM l.leader THEN l.leader END AS refers_to
FROM p LEFT JOIN l ON p.payload_digest = l.payload_digest"""

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(n) OVER () AS total FROM s),
r AS (
  SELECT *, coalesce(sum({mixing.MAX_REPEATS} * n) OVER o, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM w WINDOW o AS (ORDER BY {mixing.MAX_REPEATS}.0 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, ((total - fixed) * weight)::DOUBLE / open > {mixing.MAX_REPEATS} * n AS capped FROM r),
t AS (
  SELECT source, n, CASE WHEN capped THEN ({mixing.MAX_REPEATS} * n)::DOUBLE ELSE
    ((total - coalesce(sum({mixing.MAX_REPEATS} * n) FILTER (capped) OVER (), 0)) * weight)::DOUBLE / sum(weight) FILTER (NOT capped) OVER () END AS target
  FROM c),
g AS (SELECT source, n, target, least(floor(target + 0.5)::BIGINT, {mixing.MAX_REPEATS} * n) AS words FROM t),
p AS (
  SELECT d.doc_id, d.size, g.n, g.target, g.words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target,
  (CASE WHEN n = 0 THEN 0 ELSE words // n * size + greatest(0, least(size, words % n - place)) END)::BIGINT AS taken
FROM p"""


def _orchard_sql() -> str:
    parts, entries = orchard.PARTS, orchard.ENTRIES
    out = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {orchard.SCALE})::BIGINT)) AS r,
    list_transform(embedding, lambda x: floor(x::DOUBLE * {orchard.SCALE})::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (d - 1) // (n // {parts}) AS part, d, q[d] AS x FROM (SELECT r, q, len(q) AS n, unnest(range(1, len(q) + 1)) AS d FROM v)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, d, x AS y FROM x WHERE r <= {entries})"""
    for k in range(orchard.ROUNDS + 1):
        out += f""",
a{k} AS MATERIALIZED (
  SELECT r, part, min({{'error': error, 'entry': entry}}) AS best
  FROM (SELECT r, x.part, entry, sum((x - y) * (x - y))::BIGINT AS error FROM x JOIN b{k} b ON x.part = b.part AND x.d = b.d GROUP BY ALL) GROUP BY ALL)"""
        if k < orchard.ROUNDS:
            out += f""",
m{k} AS MATERIALIZED (
  SELECT a.part, a.best.entry AS entry, d, sum(x)::BIGINT AS s, count(*) AS c FROM a{k} a JOIN x ON a.r = x.r AND a.part = x.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.d, coalesce((s - ((s % c) + c) % c) // c, y) AS y
  FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry AND b.d = m.d)"""
    k = orchard.ROUNDS
    return out + f""",
c AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.error)::BIGINT AS error FROM a{k} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, d)) FROM b{k}) AS codebooks_sha256
FROM v JOIN c USING (r)"""


def _merkle_sql(heights: int = 6, top: int = 5) -> str:
    """Six levels hold 16 to the 6 rows of a source, five as many sources."""
    fan = merkle.FANOUT
    framed = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(text if f == "text" else f) for f in merkle.FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""
WITH RECURSIVE bits(b, v, n) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
walk(doc_id, t, k, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, t, k + 1, xor(c >> 8, v) FROM walk JOIN bits ON n = 8 AND b = xor(c & 255, ascii(t[k])::BIGINT) WHERE k <= length(t)),
hit AS (SELECT doc_id FROM walk WHERE k = length(t) + 1 AND xor(c, 4294967295::BIGINT) % {merkle.TAMPER} = 0),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {leaf(lower)} ELSE {leaf('text')} END AS other
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM leaves),
s0 AS MATERIALIZED (SELECT g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed)"""

    def tree(name: str, levels: int) -> str:
        text = ""
        for k in range(levels):
            text += f""",
{name}sides{k} AS MATERIALIZED (
  SELECT g, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY g, pos // {fan} ORDER BY pos)),
{name}{k + 1} AS MATERIALIZED (
  SELECT g, pos // {fan} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (n + {fan - 1}) // {fan} AS n
  FROM {name}{k} WHERE n > 1 GROUP BY g, pos // {fan}, n
  UNION ALL SELECT * FROM {name}{k} WHERE n = 1)"""
        return text

    levels = [("s", k, "p.g", f"p.pos // {fan**k}") for k in range(heights)] + [("t", k, "''", f"u.pos // {fan**k}") for k in range(top)]
    out += tree("s", heights)
    out += f""",
t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n FROM s{heights})"""
    out += tree("t", top)
    joins = " ".join(f"LEFT JOIN {name}sides{k} {name}j{k} ON {name}j{k}.g = {g} AND {name}j{k}.pos = {pos}" for name, k, g, pos in levels)
    sides = " || ".join(f"coalesce({name}j{k}.l || {name}j{k}.r, '')" for name, k, _, _ in levels)
    columns = ", ".join(f"{name}j{k}.l AS {name}l{k}, {name}j{k}.r AS {name}r{k}" for name, k, _, _ in levels)
    out += f""",
f0 AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM t{top}) AS root, sha256({sides}) AS proof_sha256, p.other AS v, {columns}
  FROM placed p JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS pos, h FROM s{heights}) u ON u.g = p.g {joins})"""
    for n, (name, k, _, _) in enumerate(levels):
        out += f""",
f{n + 1} AS (SELECT * EXCLUDE (v), CASE WHEN {name}l{k} IS NULL THEN v ELSE sha256({name}l{k} || v || {name}r{k}) END AS v FROM f{n})"""
    return out + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, v AS folded_root, v = root AS verified FROM f{len(levels)}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": _chat_sql(), "op3_warc": WARC_SQL, "op7_mixing": MIX_SQL, "op11_orchard": _orchard_sql(), "op13_merkle": _merkle_sql()}
