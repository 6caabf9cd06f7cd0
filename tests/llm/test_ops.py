"""Training-data operators: brute force, round trips, nulls, ties, empty tables."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from graphmill.llm import chat, common, decontam, feistel, langid, mixing, simhash, tiff, token_counts, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeats, a long text, a column that clashes."""
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", "b"), (4, None, "en", None), (5, "", None, "b"), (6, " \t\n", "de", "b"), (7, "Ünïcode 日本語 😀", "ja", "c"), (8, prose(rng, 30_000), "en", "a"), (8, "same id again", "en", "a"), (None, "no id", "en", "a"), (9, "one", "en", "c"), (9, "one", "en", "c")]
    return spark.createDataFrame([(*r, 0, 1, 2, 3, b"x") for r in rows], DOC + ", shard int, slot int, page int, media binary")


# --- TIFF


@pytest.mark.parametrize("codec,predictor,tile", [(c, p, t) for c in (1, 5, 8, 32773) for p in (1, 2) for t in (0, 16)])
def test_tiff_round_trip(codec, predictor, tile):
    rng = np.random.default_rng(codec + predictor)
    pages = [rng.integers(0, 5, (h, w), dtype=np.uint8) for h, w in ((1, 1), (33, 17), (600, 64))]
    got = list(tiff.decode_tiff(tiff.encode_tiff(pages, codec, predictor, tile)))
    assert [g[0] for g in got] == [0, 1, 2] and all((g[1][..., 0] == p).all() for g, p in zip(got, pages))


@pytest.mark.parametrize("size", [0, 1, 2, 255, 256, 257, 3837, 3838, 3839, 3840, 9000])
def test_codecs_at_table_edges(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    for x in (data, bytes(size)):
        assert tiff.lzw_decode(tiff.lzw_encode(x), size + 1) == x
        assert tiff.packbits_decode(tiff.packbits_encode(x), size + 1) == x


def test_tiff_damage_gives_error_rows():
    good = tiff.encode_tiff([np.zeros((4, 64), np.uint8)], 5)
    for bad in (None, b"", b"II", b"not a tiff at all", good[:40], good[:8] + b"\xff" * 30 + good[38:]):
        out = list(tiff.decode_tiff(bad))
        assert len(out) == 1 and out[0][3]
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert "loop" in list(tiff.decode_tiff(bytes(loop)))[-1][3]


def test_tiff_big_endian_planar():
    import struct

    body = bytes(range(12)) + bytes(range(100, 112))
    tags = [(256, 4, 1, 4), (257, 4, 1, 3), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 32 + 8), (277, 3, 1, 2 << 16), (279, 4, 2, 32 + 8 + 8), (284, 3, 1, 2 << 16)]
    head = struct.pack(">2sHI", b"MM", 42, 56) + body + bytes(8)
    data = head + struct.pack(">II", 8, 20) + struct.pack(">II", 12, 12)
    data += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in [(a, b, c, {273: 40, 279: 48}.get(a, d)) for a, b, c, d in tags]) + struct.pack(">I", 0)
    ((page, samples, form, error),) = tiff.decode_tiff(data)
    assert error is None and samples.shape == (3, 4, 2) and samples[1, 2].tolist() == [6, 106]


def test_tiff_query_on_odd_rows(spark, docs):
    out = tiff.document_digests(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(want, key=key) == sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=key)
    assert not any("error" in r.feature for r in out) and tiff.document_digests(docs.limit(0)).count() == 0


# --- chat


def test_chat_state_machine(spark):
    talks = {1: ["system", "user", "assistant"], 2: ["user", "user", "assistant"], 3: ["user", "assistant", "user"], 4: ["assistant"], 5: [None, "user", "assistant"], 6: ["user", "assistant", "user", "assistant"]}
    rows = [(c, i, r, None if i == 1 else "t\\0[INST]") for c, rs in talks.items() for i, r in enumerate(rs)]
    out = {r.conv_id: r for r in chat.conversations(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {c: r.valid for c, r in out.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert all(r.formatted.count("<s>") == 1 and r.formatted.endswith("</s>") for r in out.values())


def test_chat_escape_is_reversible(spark):
    rng = random.Random(5)
    pieces = [*chat.INSTRUCT.control, "\\", "\\0", "\\a", "<", "/s>", "[", "x", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    e = chat.escape_text(F.col("t"), chat.INSTRUCT)
    for r in df.select("t", e.alias("e"), chat.unescape_text(e, chat.INSTRUCT).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.INSTRUCT.control)


def test_chat_plan_is_native(spark):
    t = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.conversations(chat.format_chat(chat.with_probe(t))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_ties_and_empty(spark):
    t = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.conversations(chat.format_chat(t))).collect()}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest() and out[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.conversations(chat.format_chat(t.limit(0))).count() == 0


# --- WARC


def test_warc_revisits_and_random_access(spark):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1</p>"
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (4, "http://b", long), (1, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "u", ""), (8, "é", "ü" * 60), (9, "é", "ü" * 60), (9, "é", "ü" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, page int")
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        lead = min(q for q, _, g in rows if (g or "") == (h or "")) if len(b) >= 100 else p
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if lead == p else "revisit", None if lead == p else lead))
    assert out == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_normaliser_one_member_per_record(spark, tmp_path):
    recs = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {i}\r\n\r\n".encode() + b"z" * i + b"\r\n\r\n" for i in (0, 1, 70_000, 5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(b"".join(recs)))
    (tmp_path / "in/cut.warc.gz").write_bytes(gzip.compress(recs[1] + recs[2][:500]))
    (tmp_path / "in/empty.warc.gz").write_bytes(gzip.compress(b""))
    done = {r.archive: r for r in warc.normalise(spark, str(tmp_path / "in"), f"file://{tmp_path}/out").collect()}
    assert done["a.warc.warc.gz"].n_records == 4 and done["a.warc.warc.gz"].error is None
    assert done["cut.warc.warc.gz"].n_records == 1 and done["cut.warc.warc.gz"].error and done["empty.warc.warc.gz"].n_records == 0
    data = (tmp_path / "out/a.warc.warc.gz").read_bytes()
    index = sorted((r.offset, r.length) for r in warc.read_index(spark, f"{tmp_path}/out").filter("archive = 'a.warc.warc.gz'").collect())
    assert [zlib.decompress(data[o : o + n], 31) for o, n in index] == recs and gzip.decompress(data) == b"".join(recs)


# --- token counts


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_splice_equals_whole(bpe):
    counter = token_counts.TokenCounter(bpe, huge=40, chunk=64, overlap=8)
    plain = token_counts.TokenCounter(bpe)
    rng = random.Random(7)
    parts = ["a", "'re", " ", "  ", "\n", "<|endoftext|>", "<|endof", "é", "1", "!?", "\t", "x" * 30, " " * 70, "日本", " ", "'"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        want = len(plain.tokenizer.encode(text, add_special_tokens=False).ids)
        assert counter.count_all([text]) == plain.count_all([text]) == [want], text


def test_count_tokens_rows(spark, docs, bpe):
    out = token_counts.count_tokens(docs, bpe, huge=2000, chunk=1024, overlap=64)
    t = token_counts.TokenCounter(bpe).tokenizer
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in docs.select("doc_id", "text").collect()), key=key)
    assert sorted(map(tuple, out.collect()), key=key) == want and token_counts.count_tokens(docs.limit(0), bpe).count() == 0


# --- sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    p = feistel.permute(np.arange(n), n, 42)
    assert sorted(p) == list(range(n)) and (n < 100 or (p != np.arange(n)).mean() > 0.9)
    assert n == 0 or (feistel.permute(np.array([n - 1]), n, 42) == p[-1:]).all()


def test_shards_are_even_and_gapless(spark, docs):
    out = feistel.shard_documents(docs, 5)
    got = out.collect()
    assert len(got) == 12 and out.filter("law <> 'rows' or grown_shard is not null").count() == 0
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(str, feistel.shard_documents(docs.repartition(7), 5).collect())) == sorted(map(str, got))
    assert {r.size for r in got if r.doc_id == 4} == {1} and feistel.shard_documents(docs.limit(0)).count() == 0
    whole = feistel.shard_rows(docs, 3, ["doc_id", "text"])
    assert whole.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"] and whole.count() == 12


# --- mixing


def test_water_fill():
    assert mixing.water_fill([10, 10, 100], [1, 2, 3]) == [22.5, 30.0, 67.5]
    for sizes, weights in (([10, 10, 100], [1, 2, 3]), ([1, 1, 1, 1000], [1, 2, 3, 1]), ([0, 5], [1, 2]), ([7], [1])):
        t = mixing.water_fill(sizes, weights)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
        free = [x / w for x, s, w in zip(t, sizes, weights) if x < 3 * s - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))


def test_mix_schedule(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice("aaaaabc")) for i in range(200)] + [(200, None, "en", None), (201, "x y", "en", None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOC)
    mix = mixing.Mix(docs, block_words=16)
    taken = {r.doc_id: r for r in mix.taken().collect()}
    sched = mix.schedule().collect()
    assert len(taken) == 202 and sum(r.taken for r in taken.values()) == sum(mix.words) == sum(r.words for r in sched)
    assert all(r.taken <= 3 * r.size for r in taken.values())
    per: dict = {}
    for r in taken.values():
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= 0.5 for a, t in per.values())
    slots: dict = {}
    for r in sched:
        slots.setdefault(r.slot, [set(), 0])
        slots[r.slot][0].add(r.source)
        slots[r.slot][1] += r.words
    assert all(len(s) == 1 and n <= 16 for s, n in slots.values()) and sum(n < 16 for _, n in slots.values()) <= 4
    order = [next(iter(slots[k][0])) for k in sorted(slots)]
    share = sum(s == "b" for s in order) / len(order)
    for cut in range(20, len(order), 20):  # every stretch holds the sources near their shares
        assert abs(sum(s == "b" for s in order[:cut]) - share * cut) < 4
    again = {r.doc_id: r.taken for r in mixing.mix_documents(docs.repartition(5), block_words=16).collect()}
    assert again == {k: r.taken for k, r in taken.items()}
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mixed_rows_repeat_documents(spark, docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 5").count() == 1


# --- SimHash


def test_simhash_brute_force(spark):
    rng = random.Random(13)
    base = [prose(rng, 120) for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    rows += ["", None, "  ", "a b", "A B", "a  b\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    fps = np.array([simhash.fingerprint(t) for t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == dict(enumerate(fps.tolist()))
    assert {i: r.component_id for i, r in out.items()} == {i: find(i) for i in range(len(rows))}
    assert len({find(i) for i in range(200)}) < 150 and out[200].fingerprint == "0" * 16
    small = simhash.links(docs.limit(0).selectExpr("doc_id as fp", "0 as ones"))
    assert small.count() == 0


def test_keep_first_finds_near_copies(spark):
    """One of each planted group stays, unrelated texts all stay; wide components equal brute force."""
    rng = random.Random(37)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 250))] for _ in range(40)]
    texts, group = [], []
    for g, b in enumerate(base):
        for _ in range(5 if g < 20 else 1):
            w = list(b)
            if g < 20:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            group.append(g)
    texts += ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = np.array([np.frombuffer(simhash.wide_fingerprint(t), np.uint64) for t in texts])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=int) <= simhash.WIDE_RADIUS
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.WIDE_RADIUS, wide=True).collect()}
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(texts))]
    assert out == dict(enumerate(label))
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(group[i] for i in kept if i < len(group)) == list(range(40)) and len(kept) == 41


def near_copies(a, b):
    """By the definition, word by word: (Jaccard of five-word shingles, share of words that shared shingles cover)."""
    texts = [x.lower().split() for x in (a, b)]
    lists = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in texts]
    both = set(lists[0]) & set(lists[1])
    words = sum(len({i + k for i, x in enumerate(xs) if x in both for k in range(5)}) for xs in lists)
    return len(both) / len(set(lists[0]) | set(lists[1])), words / sum(len(xs) + 4 for xs in lists)


@pytest.mark.parametrize("tile", [1024, 3])
def test_keep_first_equals_brute_force(spark, monkeypatch, tile):
    """Near copies by their definition, on both sides of its cuts: replaced runs, scattered words, chains, repeated lines and short texts."""
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    rng = random.Random(41)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for g in range(120):
        base = [rng.choice(words) for _ in range(9 if g % 6 == 0 else 120)]
        texts.append(" ".join(base))
        for _ in range(3):
            n = rng.randint(6, 40) if len(base) > 9 else 1
            at = len(base) - n if g % 2 else rng.randrange(len(base) - n)
            texts.append(" ".join(base[:at] + [rng.choice(words) for _ in range(n)] + base[at + n :]))
        scattered = [rng.choice(words) if rng.random() < rng.choice([0.03, 0.06, 0.09]) else w for w in base]
        texts += [" ".join(base + base[:20] * 30), " ".join(scattered)]
    pairs = {(g, k): near_copies(texts[g], texts[k]) for g in range(len(texts)) for k in range(g + 1, len(texts)) if g // 6 == k // 6}
    link = {p for p, (j, c) in pairs.items() if j >= 0.8 or (j >= 0.5 and c >= 0.8)}
    count = lambda f: sum(map(f, pairs.values()))
    assert count(lambda x: 0.5 <= x[0] < 0.8 and 0.8 <= x[1] < 0.85) > 15 and count(lambda x: 0.5 <= x[0] < 0.8 and 0.75 < x[1] < 0.8) > 15
    assert count(lambda x: 0.5 <= x[0] < 0.55 and x[1] >= 0.8) > 5 and count(lambda x: 0.45 < x[0] < 0.5 and x[1] >= 0.8) > 5
    label = list(range(len(texts)))
    for _ in range(6):
        for g, k in link:
            label[g] = label[k] = min(label[g], label[k])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == dict(enumerate(label))
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == set(label)


def test_candidate_radius_on_sets_of_any_size():
    """Of pairs that share just half of their shingles, those beyond the candidate radius: none of 2,000 for each size of set."""
    rng = np.random.default_rng(17)
    far = {}
    for size in (2, 3, 4, 5, 6, 8, 10, 20, 100):
        for lengths in {(size, size), (size, max(1, size // 2))}:
            shared = -(-sum(lengths) // 3)  # shared / (sum - shared) >= 1/2
            if shared > min(lengths):
                continue
            for _ in range(2000):
                common = rng.integers(0, 2**63, shared, dtype=np.uint64)
                one, two = (np.concatenate([common, rng.integers(0, 2**63, n - shared, dtype=np.uint64)]) for n in lengths)
                a, b = (simhash._majority(simhash._spread(x)) for x in (one, two))
                d = int(np.bitwise_count(a ^ b).sum())
                far[lengths] = max(far.get(lengths, 0), d)
    assert max(far.values()) <= simhash.CANDIDATE_RADIUS, far


def test_near_copies_of_documents_are_found(spark):
    """Against an inverted index of shingles over all documents at the larger test size: copies found, nothing else linked."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    lists = {i: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    sets, index, shared = {i: set(x) for i, x in lists.items()}, defaultdict(list), Counter()
    for i, x in sets.items():
        for h in x:
            index[h].append(i)
    for ids in index.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    share = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    near = [p for p, j in share.items() if j >= 0.4]  # hardly any pair lies between 0.25 and 0.45
    linked = [p for p in near if found[p[0]] == found[p[1]]]
    assert len(near) > 150 and len(linked) >= 0.95 * len(near)
    assert not any(found[a] == found[b] for (a, b), j in share.items() if j < 0.3)


def test_simhash_reference_bits():
    import xxhash

    text = "One two THREE four five\tsix"
    w = "one two three four five six".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint("Ä B") == xxhash.xxh64_intdigest("Ä b", 42) and simhash.fingerprint(" \x0b") == 0


def test_tiles_of_one_and_many(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre, centre ^ np.uint64(1), centre ^ np.uint64(0b111), rng.integers(0, 2**63, 300, dtype=np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x), int(x).bit_count() if x >= 0 else (int(x) + 2**64).bit_count()) for x in fps], "fp long, ones int")
    whole = {tuple(sorted(r)) for r in simhash.components(simhash.links(df, tile=8192)).collect()}
    tiny = {tuple(sorted(r)) for r in simhash.components(simhash.links(df, tile=4)).collect()}
    assert whole == tiny and len(whole) == 90


def test_keep_first_without_unique_ids(spark, docs):
    out = simhash.keep_first(docs)
    ids = sorted(str(r.doc_id) for r in out.collect())
    assert out.columns == docs.columns and ids.count("9") == 1 and ids.count("None") == 1 and "2" not in ids and "1" in ids


# --- decontamination


def leak_cases(rng):
    items = [prose(rng, 40), prose(rng, 20), "too short", None, ""]
    w = items[0].split()
    swapped = list(w)
    for k in (9, 20, 31):
        swapped[k] = "other"
    part = w[5:25]
    few = w[:8]
    docs = [prose(rng, 50) + " " + items[0].upper() + ". " + prose(rng, 30), prose(rng, 10) + " " + " ".join(swapped), " ".join(part) + " tail", prose(rng, 20) + " zz " + " ".join(few) + " zz", items[1], None, ""]
    return items, docs


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, limit):
    rng = random.Random(17)
    items, texts = leak_cases(rng)
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontam.overlaps(d, b, limit).collect()}
    assert set(out) >= {(0, 0), (1, 0), (2, 0), (4, 1)} and (3, 0) not in out
    assert out[0, 0].matches == 40 and out[1, 0].matches == 37 and out[2, 0].matches >= 20 and out[0, 0].first_token == 50
    assert decontam.overlaps(d.limit(0), b, limit).count() == 0 and decontam.overlaps(d, b.limit(0), limit).count() == 0
    kept = decontam.keep_uncontaminated(d, b)
    assert kept.columns == d.columns and 3 in {r.doc_id for r in kept.collect()}


def test_decontamination_brute_force(spark):
    """Every alignment of every pair, scored without seeds, for passages with substitutions."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(30) for _ in range(8)]
    texts = []
    for i in range(60):
        body = text(80)
        if i % 2:
            part = list(items[i % 8][rng.randint(0, 8) :])
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "sub"
            body[20:20] = part
        texts.append(body)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()}
    brute = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) for s in range(-len(item), len(t)) if sum(0 <= s + q < len(t) and t[s + q] == w for q, w in enumerate(item)) >= 18}
    assert len(brute) >= 25 and brute <= found and found <= {(i, i % 8) for i in range(1, 60, 2)}


def test_decontamination_paths_agree(spark):
    """Overlaps longer than any fixed reach give the same rows by broadcast and by shuffle; repeated and null ids too."""
    rng = random.Random(8)
    words = [f"t{k}" for k in range(2000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(400) for _ in range(6)]
    rows = []
    for i in range(24):
        w = list(items[i % 6])
        for k in rng.sample(range(400), 8 * (i % 5)):
            w[k] = "zz"
        rows.append((None if i == 5 else i // 2, " ".join(text(30) + w[rng.randint(0, 100) :] + text(30))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    near, far = (sorted(map(str, decontam.overlaps(d, b, limit).collect())) for limit in (10**6, 0))
    assert near == far and len(near) == 24 and max(r.matches for r in decontam.overlaps(d, b, 0).collect()) > 290


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_beside_weaker_matches(spark, limit):
    """An exact copy counts whatever follows it; every pair's figures equal brute force over all stretches of its diagonals."""
    rng = random.Random(12)
    words = [f"t{k}" for k in range(3000)]
    rows, items = [], []
    for i in range(150):
        exact, weak, share = ((15, 44, 0.7), (20, 80, 0.7), (30, 150, 0.75))[i % 3]
        item = [rng.choice(words) for _ in range(exact + weak)]
        w = item[:exact] + [x if rng.random() < share else "zz" for x in item[exact:]]
        items.append(item)
        rows.append([rng.choice(words) for _ in range(5)] + w + ["end"])
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.matches, r.first_token, r.end_token) for r in decontam.overlaps(d, b, limit).collect()}
    assert set(found) == {(i, i) for i in range(150)}
    for i in range(0, 150, 5):
        same = [x == y for x, y in zip(rows[i][5:], items[i])]
        sums = np.concatenate([[0], np.cumsum(same)])
        best = min((-(sums[e] - sums[s]), s, e) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if 5 * (sums[e] - sums[s]) >= 4 * (e - s) and same[s] and same[e - 1])
        assert found[i, i] == (-best[0], 5 + best[1], 5 + best[2])


# --- language


def test_language_fusion(spark):
    rng = random.Random(23)
    en, de = "the and of that with this".split(), "der und das nicht ein mit".split()
    text = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    docs = spark.createDataFrame([(i, text(en if i % 2 else de, 40), "en" if i % 2 else "de", "s", 0) for i in range(60)], DOC)
    page = lambda lang, body: f'<html lang="{lang}"><script>der und das</script><p>{body}</p></html>'
    rows = [(i, f"https://h{i % 3}.de/x", page("de", text(de, 20))) for i in range(30)] + [(100, "https://h0.de/y", "<html><p></p></html>"), (101, None, None), (102, "https://h1.de", page("de", text(en, 30))), (103, "https://new.de", page("de", "12"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = langid.train(docs)
    assert model[0] == ["de", "en"]
    out = {r.id: r for r in langid.identify(langid.page_evidence(pages), model).collect()}
    assert len(out) == 34 and all(out[i].lang == "de" for i in range(30))
    assert out[100].lang == "de" and out[103].lang == "de" and out[102].lang == "en"
    own = langid.identify(langid.document_evidence(docs), model).collect()
    assert sum(r.lang == ("en" if r.id % 2 else "de") for r in own) == 60
    nothing = langid.train(docs.limit(0))
    assert {r.lang for r in langid.identify(langid.page_evidence(pages), nothing).collect()} == {"und"}
    assert langid.identify(langid.page_evidence(pages.limit(0)), model).count() == 0


# --- toxicity


def test_toxicity_on_planted_stems(spark):
    rng = random.Random(29)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) + rng.choice(["", "a", "o"]) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for k in (3, 9, 20):
                words[k] = "grumph" + rng.choice("abcdef")
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, None, None, 0), (None, "you idiot moron", None, None, 0), (5001, "you idiot moron", None, None, 0)], DOC)
    lab = spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, lab).collect()
    assert len(out) == 903 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held if r.doc_id < 900)
    assert right / sum(r.doc_id < 900 for r in held) > 0.98
    assert by[None].score == by[5001].score and by[5000].predicted == 0
    clean = toxicity.keep_clean(docs, lab)
    assert clean.columns == docs.columns and clean.filter("doc_id = 6").count() == 0 and clean.filter("doc_id = 7").count() == 1


def test_held_out_labels_do_not_matter(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 20) + (" blargh blarghx" if i % 4 == 0 else ""), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    lab = lambda flip: spark.createDataFrame([(i, 1, int(i % 4 == 0) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i in range(300)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, toxicity.score_documents(docs, lab(f)).collect())) for f in (False, True))
    assert a == b
    assert toxicity.score_documents(docs, lab(False).limit(0)).count() == 300 and toxicity.score_documents(docs.limit(0), lab(False)).count() == 0


# --- shared helpers and the pipeline


def test_join_skewed_is_whole(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(3000)] + [(-1, None)], "id int, k string")
    right = left.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    out = common.join_skewed(left, right, "k", "n", 3001)
    assert out.count() == 3001 and out.filter("n is null").count() == 1 and out.filter("n = 2000").count() == 2000


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert k == len(pipeline.STAGES) - 1 or docs.columns == columns, name
        if k < 3:
            assert docs.count() == docs.select("doc_id").distinct().count() <= before
            before = docs.count()
    assert docs.columns == [*columns, "shard", "slot"] and docs.count() > 0.5 * before


# --- rows are kept or dropped one by one


def test_rows_without_unique_ids_are_judged_by_their_texts(spark):
    rng = random.Random(43)
    words = [f"w{k}" for k in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, item = text(60), text(60), text(60), text(30)
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, b), (None, near), (None, c), (None, c + "  "), (2, None), (None, ""), (3, f"{b[:100]} {item}"), (None, f"{c[:100]} {item}"), (3, text(50)), (1, a)]
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, sig int, `__key` string, r binary")
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (2, None), rows[7], rows[8], rows[9]], key=str)
    items = spark.createDataFrame([(0, item), (1, None)], "item_id long, text string")
    clean = decontam.keep_uncontaminated(docs, items)
    assert clean.columns == docs.columns and sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id == 3) == [rows[9]]
    assert clean.count() == len(rows) - 2 and decontam.keep_uncontaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_short_items_are_found_whole(spark, limit):
    items = spark.createDataFrame([(0, "one two three four five six seven"), (1, "Alpha, beta!"), (2, "..."), (3, "zeta")], "item_id long, text string")
    texts = ["x one two three four five six seven y", "one two three four five six", "alpha beta", "alpha gamma beta", "zeta", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.matches, r.first_token, r.end_token) for r in decontam.overlaps(docs, items, limit).collect())
    assert found == [(0, 0, 7, 1, 8), (2, 1, 2, 0, 2), (4, 3, 1, 0, 1)]


def test_toxicity_of_odd_labels_and_long_texts(spark):
    rng = random.Random(47)
    rows = [(i, prose(rng, 30) + (" grumphel grumphox" if i % 5 == 0 else ""), 0) for i in range(200)]
    rows += [(None, prose(rng, 20) + " grumphel grumphox", 0), (None, "alpha beta", 0), (900, prose(rng, 60_000) + " grumphel grumphox", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__key` int")
    labels = spark.createDataFrame([(i, 1, 7 if i == 3 else int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (4, 0, -1)], "doc_id long, quality int, toxic int")
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    kept = clean.collect()
    assert [r.text for r in kept if r.doc_id is None] == ["alpha beta"] and not any(r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 200 for r in kept)
    assert sum(r.doc_id is not None and r.doc_id < 200 for r in kept) == 160


def test_toxicity_held_out_precision_and_recall(spark):
    """Labels never read, of an invented corpus with noise among the labels."""
    rng = random.Random(53)
    rows, labels, truth = [], [], {}
    for i in range(1500):
        words = [rng.choice(WORDS) + rng.choice(["", "a", "o", "us"]) for _ in range(rng.randint(20, 120))]
        truth[i] = i % 8 == 0
        if truth[i]:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["grumphel", "snarkox", "blighto", "mumpfix"]) + rng.choice(["", "s"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(truth[i]) if rng.random() > 0.02 else int(not truth[i])))
    out = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    found = {r.doc_id for r in out if r.predicted}
    bad = {r.doc_id for r in out if truth[r.doc_id]}
    assert len(found & bad) >= 0.95 * len(bad) and len(found & bad) >= 0.95 * len(found)


# --- chat machines, damaged sizes


TOOLS = chat.Template(
    name="tools",
    begin="<|in|>",
    end="<|out|>",
    marks={"user": ("<|user|>", "<|/user|>"), "assistant": ("<|says|>", "<|/says|>"), "tool": ("<|tool|>", "<|/tool|>")},
    other=("<|turn|>{role}<|as|>", "<|/turn|>"),
    trained=("assistant",),
    control=("<|in|>", "<|out|>", "<|user|>", "<|/user|>", "<|says|>", "<|/says|>", "<|tool|>", "<|/tool|>", "<|turn|>", "<|as|>", "<|/turn|>"),
    start="start",
    # one tool answer per question: what may follow the assistant depends on more than the role before
    moves={("start", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "tool"): "called", ("called", "assistant"): "done", ("answered", "user"): "asked", ("done", "user"): "asked"},
    final=("answered", "done"),
)


def test_chat_machine_with_tool_turns(spark):
    talks = {1: "user assistant tool assistant", 2: "user assistant tool assistant tool assistant", 3: "user assistant tool", 4: "user assistant user assistant tool assistant", 5: "tool", 6: "user assistant tool assistant user assistant"}
    rows = [(c, i, r, "x <|tool|> y") for c, rs in talks.items() for i, r in enumerate(rs.split())]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.format_chat(turns, TOOLS), TOOLS)
    assert {r.conv_id: r.valid for r in made.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    read = {r.conv_id: r for r in chat.read_back(made, TOOLS).collect()}
    for c, rs in talks.items():
        assert read[c].turns_sha256 == hashlib.sha256("".join(f"{r}\nx <|tool|> y\n" for r in rs.split()).encode()).hexdigest()
    plan = chat.read_back(made, TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_refuses_codes_that_text_could_complete():
    import dataclasses

    bad = dataclasses.replace(chat.INSTRUCT, control=("bot:", *chat.INSTRUCT.control), begin="bot:")
    with pytest.raises(ValueError, match="must not begin"):
        bad.check()


def test_chat_long_text(spark):
    long = "[INST] \\ </s>" * 40_000
    t = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.conversations(chat.format_chat(t))).collect()
    assert r.loss_chars == len(long) and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and r.valid


def test_tiff_sizes_beyond_integers_and_clashing_names(spark):
    data = bytearray(tiff.encode_tiff([np.zeros((32, 32), np.uint8)], 8, 1, 16))
    for tag in (256, 257, 322, 323):
        at = data.find(tag.to_bytes(2, "little") + b"\x04\x00\x01\x00\x00\x00")
        at = at if at >= 0 else data.find(tag.to_bytes(2, "little") + b"\x03\x00\x01\x00\x00\x00")
        if at >= 0:
            data[at + 2 : at + 12] = b"\x04\x00\x01\x00\x00\x00\xff\xff\xff\xff"
    out = list(tiff.decode_tiff(bytes(data)))
    assert out and all(o[3] for o in out)
    good = tiff.encode_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)], 1)
    df = spark.createDataFrame([(1, good, "w"), (2, None, "v")], "page int, media binary, width string")
    pages = tiff.read_tiff(df, "media", ["page", "width"])
    got = {r["page_"]: r for r in pages.collect()}
    assert got[1]["width"] == 8 and got[1]["width_"] == "w" and bytes(got[1]["samples"]) == bytes(range(64)) and got[2]["error"]


def test_language_held_out_and_fused_as_written(spark):
    """Documents never trained on are told apart, and one row's fusion equals the formula."""
    rng = random.Random(59)
    vocab = {"en": "the and of that with this from have".split(), "de": "der und das nicht ein mit auch nach".split(), "fr": "les des une dans pour que sur avec".split()}
    text = lambda g, n: " ".join(rng.choice(vocab[g]) for _ in range(n))
    langs = ["en", "de", "fr"]
    docs = [(i, text(langs[i % 3], 30), langs[i % 3], f"s{i % 4}", 0) for i in range(240)]
    model = langid.train(spark.createDataFrame(docs[:120], DOC))
    held = spark.createDataFrame([*docs[120:], (999, None, None, None, 0), (1000, text("de", 50_000), None, "s1", 0)], DOC)
    out = {r.id: r for r in langid.identify(langid.document_evidence(held), model).collect()}
    assert sum(out[i].lang == langs[i % 3] for i in range(120, 240)) >= 118 and out[1000].lang == "de" and len(out) == 122
    names, likely, prior = model
    z, p = {}, {}
    for i, t, *_ in [r for r in docs[120:] if r[3] == "s1"] + [(1000, held.filter("doc_id = 1000").first().text)]:
        g = langid.trigrams(t)
        z[i] = np.maximum((s := likely[:, g].sum(1) * langid.TEXT_DAMPING) - s.max(), -langid.TEXT_LIMIT)
        p[i] = np.exp(z[i] + prior) / np.exp(z[i] + prior).sum()
    i = next(iter(z))
    c = np.maximum(sum(p.values()) - p[i], 0)
    score = z[i] + np.log((c + langid.HOST_STRENGTH * np.exp(prior)) / (c.sum() + langid.HOST_STRENGTH))
    q = np.exp(score - score.max())
    assert names[int(q.argmax())] == out[i].lang and out[i].confidence == pytest.approx(q.max() / q.sum(), abs=1e-6)
