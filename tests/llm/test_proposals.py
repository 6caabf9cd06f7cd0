import random

import numpy as np
import pytest

from graphmill.llm import simhash


@pytest.mark.parametrize("common, tile", [(256, 8192), (2, 8192), (2, 3)])
def test_near_copies_meet_by_their_least_shingles(spark, monkeypatch, common, tile):
    """No comparison of all texts; copies in groups beyond the size of a bucket, under common lines, and short ones are found as by brute force."""
    monkeypatch.setattr(simhash, "COMMON", common, raising=False)
    monkeypatch.setattr(simhash, "TILE", tile)

    def everything(*_):
        raise AssertionError("all fingerprints are compared")

    monkeypatch.setattr(simhash, "links", everything)
    rng = random.Random(53)
    words = [f"w{k}" for k in range(4000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    line, texts = some(14), []
    for g in range(60):
        base = some((3, 6, 7, 12, 30, 90, 300)[g % 7]) + (line if g % 3 == 0 else [])
        for _ in range(1 + g % 5):
            t = list(base)
            if len(t) > 8:
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(line), " ".join(line[:10]), "", None, "one", " One "]
    lists = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in ((t or "").lower().split() for t in texts)]
    sets = [set(x) for x in lists]
    fps = np.array([np.frombuffer(simhash.wide_fingerprint(t), np.uint64) for t in texts])

    def alike(i, j):
        both = sets[i] & sets[j]
        share = len(both) / len(sets[i] | sets[j])
        cover = sum(len({i + k for i, x in enumerate(xs) if x in both for k in range(5)}) for xs in (lists[i], lists[j])) / (len(lists[i]) + len(lists[j]) + 8)
        return np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash.CANDIDATE_RADIUS and (share >= 0.8 or (share >= 0.5 and cover >= 0.8))

    label = list(range(len(texts)))
    pairs = [(i, j) for i in label for j in range(i) if alike(i, j)]
    for _ in range(6):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert 60 < len(set(label)) < len(label) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == dict(enumerate(label))


def test_sketches_of_near_copies_share_what_they_must():
    """Of sets that share half of their hashes, sketches hold as many in common as either asks for."""
    rng = np.random.default_rng(59)
    for n in (1, 2, 3, 5, 7, 8, 20, 60, 120, 121, 400, 3000):
        for m in {n, n + 1, n * 3 // 2, 2 * n}:
            shared = -(-(n + m) // 3)
            if shared > min(n, m):
                continue
            for _ in range(100):
                common = rng.integers(0, 2**63, shared, dtype=np.uint64)
                (a, x), (b, y) = (simhash.sketch(np.unique(np.concatenate([common, rng.integers(0, 2**63, k - shared, dtype=np.uint64)]))) for k in (n, m))
                assert len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))) >= max(x, y) and len(a) <= 8 * simhash.SKETCH
