"""The metric-space join against all pairs in plain Python."""

import random

import numpy as np
import pytest
from plain_texts import awkward_texts, shingles

from limpida.llm import jaccard_join


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts(seed, n):
    """Groups of texts around the threshold: stars around a base, chains, and texts that share a passage only."""
    pick = random.Random(seed)
    some = lambda k: [f"v{pick.randint(0, 5000)}" for _ in range(k)]
    texts, passage = [], some(25)
    for _ in range(n):
        base = some(pick.randint(20, 80))
        for _ in range(pick.randint(1, 9)):
            words = list(base)
            for _ in range(pick.randint(0, 3)):
                words[pick.randrange(len(words))] = "edit%d" % pick.randint(0, 10**6)
            texts.append(" ".join(words))
            if pick.random() < 0.4:
                base = words
        texts.append(" ".join(some(20) + passage + some(pick.randint(0, 20))))
    pick.shuffle(texts)
    return texts


@pytest.mark.parametrize(("block", "pivots", "frequent"), [(1024, 16, 8), (6, 3, 2)])
def test_join_equals_all_pairs(docs_of, monkeypatch, block, pivots, frequent):
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("FREQUENT_FROM", frequent)):
        monkeypatch.setattr(jaccard_join, name, value)
    cuts, cells = [], jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda measured, level: cuts.append(level) or cells(measured, level))
    texts = awkward_texts() + near_texts(block, 40)
    rows = jaccard_join.jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts) and len(rows) == len(texts)
    assert bool(cuts) == (block < 1024)


def test_common_counts():
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 400, pick.integers(1, 200))) for _ in range(70)] + [np.arange(5)] * 40
    counts = jaccard_join.common_counts(sets)
    for a in range(len(sets)):
        for b in range(a):
            assert counts[a, b] == counts[b, a] == len(np.intersect1d(sets[a], sets[b]))


def test_buckets_bound_intersections():
    pick = np.random.default_rng(4)
    base = pick.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(pick.choice(base, n)) for n in (3, 40, 47, 55, 300, 380, 390, 460, 500)] + [np.arange(0, 400 * 4096, 4096, dtype=np.uint64)] * 2
    n = np.array([len(s) for s in sets])
    pairs = 100 * np.minimum(n[:, None], n) >= 80 * np.maximum(n[:, None], n)
    most = jaccard_join._most_common([np.frombuffer(jaccard_join._buckets(s), np.uint8).astype(np.uint16) for s in sets], pairs, n)
    counts = jaccard_join.common_counts(sets) + np.diag(n)
    assert (most[pairs] >= counts[pairs]).all() and (most <= np.minimum(n[:, None], n)).all() and not most[~pairs].any()


def test_hot_group_of_near_copies(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    pick = random.Random(9)
    base = [f"b{n}" for n in range(60)]
    texts = [" ".join(base[:k] + [f"e{n}"] + base[k + 1 :]) for n in range(150) for k in [pick.randrange(60)]] + [" ".join(base)] * 20
    rows = jaccard_join.jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)


def test_nulls_repeats_and_empty(docs_of):
    from pyspark.sql import functions as F

    texts = awkward_texts()
    docs = docs_of(texts)
    assert jaccard_join.jaccard_components(docs.where("false")).isEmpty()
    some = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    rows = jaccard_join.jaccard_components(some).collect()
    assert len(rows) == len(texts) and all((r.doc_id is None) == (r.component_id is None) for r in rows)
    once = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") % 3)
    rows = jaccard_join.jaccard_components(once.union(once)).collect()
    assert len(rows) == 40 and all(r.component_id <= r.doc_id for r in rows)
