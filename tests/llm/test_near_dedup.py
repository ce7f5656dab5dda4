"""Near-duplicates whose links a fingerprint search alone gets wrong."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from panelspark.llm import simhash  # noqa: E402


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    """A repeated shingle decides every bit; the rest of the texts differs."""
    rng = np.random.default_rng(1)
    texts = [" ".join(["same"] * 300 + words(rng, 100)) for _ in range(4)]
    assert len({simhash.fingerprint(t, 5, simhash.LANES) for t in texts}) == 1
    assert found(spark, [*texts, texts[2]]) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}


def test_repeated_passage(spark):
    """The decision is made on shingle sets, so a passage that one text repeats costs no candidate."""
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(6):
        own = words(rng, 300)
        passage = own[100:125]
        texts += [" ".join(own), " ".join([*own, *passage * 20])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    assert all(len(a & b) >= 0.85 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert found(spark, texts) == {k: k - k % 2 for k in range(12)}


def family(rng, size, own):
    """Texts of one template, each with words of its own at its end."""
    shared = words(rng, 240)
    return [" ".join([*shared, *words(rng, own)]) for _ in range(size)]


def test_no_link_behind_closer_neighbours(spark, monkeypatch):
    """A link that the fingerprint search does not offer is found all the same."""
    rng = np.random.default_rng(3)
    texts = family(rng, 60, 40)
    copy = texts[20].split()
    copy[265:270] = words(rng, 5)
    texts.append(" ".join(copy))
    monkeypatch.setattr(simhash.GrayIndex, "pairs", lambda self, *_: iter(()))
    got = found(spark, texts)
    assert got == {k: 20 if k == 60 else k for k in range(61)}


def test_prefix_and_parity_keep_every_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.append(rng.permutation(a)[:int(n * rng.uniform(0.7, 1))], pool[n:n + int(rng.integers(0, n // 4 + 1))]))
        common = (np.sort(pool[::3]), rng.integers(3, 9, len(pool[::3])))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)))
            x, y = sorted((simhash.parity(a), simhash.parity(b)), key=len)
            while len(y) > len(x):
                y = y[:len(y) // 2] ^ y[len(y) // 2:]
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9 + 1e-6


def test_shard_sizes_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for name, value in (("SHARD_ROWS", 8), ("SHARD_MOST", 10), ("JOIN_ROWS", 50)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash, "RECALL", 0.01)  # few masks, so that the search itself must lose links
    texts = family(rng, 15, 62)
    texts += [" ".join(t.split()[:-12]) for t in texts[:5]]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    close = {(a, b) for a in range(20) for b in range(a + 1, 20) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert close == {(k, k + 15) for k in range(5)}
    assert found(spark, texts) == {k: k - 15 if k > 14 else k for k in range(20)}
