"""The pipeline's near-dedup against exact similarities of all pairs."""

import numpy as np

from bytegrain.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_links_are_verified_by_exact_similarity(spark):
    """Families of edited copies, some similar only through others and many a little under 0.8: exactly the true components are kept."""
    draw = np.random.default_rng(3)
    texts = []
    for _ in range(25):
        base = draw.integers(0, 5000, 150).tolist()
        for edits in (0, 1, 2, 3, 4, 5, 6, 8):
            own = list(base)
            for at in draw.choice(150, edits, replace=False):
                own[at] = int(draw.integers(5000, 10000))
            texts.append(" ".join(f"w{x}" for x in own))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert kept == sorted({find(k) for k in range(len(texts))})


def test_more_pairs_are_proposed_until_none_is_left():
    """Six sets near each other with labels of their own: with more room all pairs are proposed, with less the nearest of each."""
    prints, wide, size, cut = np.zeros((6, 4), np.uint64), np.zeros((6, simhash.WIDE_WORDS), np.uint64), np.full(6, 100), np.array([0, 6])
    wide[:, 0] = (1 << np.arange(6)).astype(np.uint64) - np.uint64(1)  # row k differs from row j in |k - j| bits
    a, b, more = simhash.candidates(prints, wide, size, np.arange(6), cut, 72, 0.8, 6)
    assert not more.any() and set(zip(a.tolist(), b.tolist())) == {(x, y) for x in range(6) for y in range(x + 1, 6)}
    a, b, more = simhash.candidates(prints, wide, size, np.arange(6), cut, 72, 0.8, 1)
    assert more.all() and {x for p in zip(a.tolist(), b.tolist()) for x in p} == set(range(6)) and (b - a == 1).all()
    a, b, more = simhash.candidates(prints, wide, size, np.array([0, 0, 0, 1, 1, 1]), cut, 72, 0.8, 1)
    assert list(zip(a.tolist(), b.tolist())) == [(2, 3)] and more.all()
    assert len(simhash.candidates(prints, wide, np.array([100, 70, 50, 30, 20, 10]), np.arange(6), cut, 72, 0.8, 9)[0]) == 0


def test_wide_radius_lets_true_pairs_pass():
    """Random sets at the least similarity allowed, small ones too: of 4000 pairs none is ruled out but by a chance of 1 in 9000."""
    draw = np.random.default_rng(8)
    lost = 0
    for a, b in ((5, 4), (4, 5), (9, 9), (10, 8), (45, 45), (60, 50), (90, 90), (500, 420)):
        common = min(a, b, int(np.ceil(0.8 / 1.8 * (a + b) - 1e-9)))
        for _ in range(500):
            pool = draw.integers(0, 2**63, a + b - common, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, a + b - common).astype(np.uint64)
            x, y = pool[:a], np.concatenate([pool[:common], pool[a:]])
            prints = simhash.voted(np.concatenate([x, y]), np.array([0, a, a + b]), simhash.WIDE_WORDS)
            lost += int(np.bitwise_count(prints[0] ^ prints[1]).sum()) > simhash.wide_radius(a, b, 0.8)
    assert lost <= 3
