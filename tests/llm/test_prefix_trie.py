"""The conversation trie against brute force, on the given table, odd rows, deep chains and wide stars."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelspark.llm import prefix_trie
from panelspark.llm.common import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, p1 double, part int"


def reference(rows, rebuild):
    """The nodes of (conv_id, turn, role, text) rows by plain dictionaries."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [k[2:] for k in sorted(v, key=lambda k: k[:3])] for c, v in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        seqs[c] = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(int)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        if k:
            saved[k] += (len(members[k]) - 1) * len(k[-1][1])
            kids[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in members.items()), key=str)


def check(df, piece, rebuild=True):
    want = reference([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], rebuild)
    made = prefix_trie.rebuilt_trie(df, piece) if rebuild else prefix_trie.prefix_trie(df, piece)
    assert sorted((tuple(r) for r in made.collect()), key=str) == want


@pytest.mark.parametrize("piece", [7, 20_000])
def test_given_table(spark, sf, piece):
    check(table(spark, sf, "conversations"), piece)


def odd_rows():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < c % 4 else f"own {c} {t}") for c in range(95, 112) for t in range(c % 7)]
    rows += [(7, None, None, None), (7, None, "user", None), (7, 3, None, ""), (7, 3, None, ""), (-5, 1, "user", "é́日本" * 3), (-105, 0, "user", "x")]
    rows += [(None, 0, "user", "lost"), (300, 0, "user", "y" * 50_000), (300, 1, "user", "")]
    return [(*r, "clash", 1.5, 9) for r in rows]


@pytest.mark.parametrize("piece", [4, 20_000])
@pytest.mark.parametrize("rebuild", [True, False])
def test_odd_rows(spark, piece, rebuild):
    check(spark.createDataFrame(odd_rows(), SCHEMA), piece, rebuild)


def test_deep_and_wide(spark):
    """One conversation of many turns beside many of one turn, some equal: deep chain, wide star, one node with many ends."""
    rows = [(100, t, "user", f"w{t % 3}") for t in range(150)]
    rows += [(c, t, "user", f"w{t % 3}") for c in (203, 204) for t in range(90)]
    rows += [(c, 0, "user", "same" if c % 2 else f"s{c}") for c in range(1000, 1120)]
    check(spark.createDataFrame([(*r, "", 0.0, 0) for r in rows], SCHEMA), 25, rebuild=False)


def test_empty(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_of_ends_meet_as_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    check(spark.createDataFrame([(c, 0, "user", "same", "", 0.0, 0) for c in range(1, 60)], SCHEMA), 20_000, rebuild=False)


def test_centroid_sums_of_random_forests():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 400):
        parent = np.array([int(rng.integers(max(0, k - 4), k)) if k and rng.random() > 0.05 else -1 for k in range(n)])
        depth = np.zeros(n, np.int64)
        for k in range(n):
            depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
        values = rng.integers(0, 9, (n, 2))
        want = values.copy()
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
        order = rng.permutation(n)  # places of nodes have no order
        place = np.argsort(order)
        moved = np.where(parent[order] >= 0, place[np.maximum(parent[order], 0)], -1)
        assert (prefix_trie.local_rollup(moved, depth[order], values[order]) == want[order]).all()
