"""Ranked search against plain Python, and the sharing DAG against the items it stands for."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from plain_texts import LOW, awkward_texts

from limpida.llm import ranked_search

TERM = re.compile(ranked_search.TERM)


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, total = len(texts), sum(sum(t.values()) for _, t in texts)
    df = Counter(w for _, t in texts for w in t)
    out = []
    for item, text in items:
        scored = []
        for i, t in texts:
            m = 50 + 50 * sum(t.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 20 * m)) for w in set(terms(text)) if t[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[: ranked_search.TOP], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, docs_of, monkeypatch, small):
    if small:
        for name, value in (("TOP", 4), ("BLOCK_TERMS", 60), ("CELLS", 500), ("GATHER", 20)):
            monkeypatch.setattr(ranked_search, name, value)
    pick = random.Random(6)
    texts = awkward_texts() * 3 + ["Straße-7, ÀB_c\u00a0d 日本 x2x"] * 2
    words = sorted({w for t in texts for w in terms(t)})
    items = [(n, " ".join(pick.choice(words) for _ in range(pick.randint(1, 60)))) for n in range(30)]
    items += [(30, None), (31, ""), (32, "--- !"), (33, "unseen"), (34, texts[7]), (35, texts[7]), (36, "of OF w1"), (None, "one two")]
    docs = docs_of(texts).withColumn("doc_id", __import__("pyspark").sql.functions.expr("nullif(doc_id, 40)"))
    found = ranked_search.search(docs, spark.createDataFrame([(*i, "z") for i in items], "item_id LONG, text STRING, term STRING"))
    assert [(c, t) for c, t in found.dtypes] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = plain([(None if i == 40 else i, t) for i, t in enumerate(texts)], items)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and len(want) > 100


def test_sharing_covers_each_item_once():
    pick = random.Random(7)
    common = [f"c{n}" for n in range(12)]
    items = [sorted({*pick.sample(common, 9), *(f"x{pick.randint(0, 60)}" for _ in range(5))}) for _ in range(40)]
    dag = ranked_search.share(items)
    held = {n: [t for t, a in zip(dag.terms, dag.atom, strict=True) if a == n] for n in range(dag.n_atoms)}
    for node, left, right in (row for level in dag.levels for row in zip(*level, strict=True)):
        held[node] = held[left] + held[right]
    parts = np.split(dag.nodes, dag.bounds[1:])
    assert [sorted(t for n in nodes for t in held[n]) for nodes in parts] == items
    assert len(dag.nodes) + dag.n_nodes - dag.n_atoms < 0.7 * sum(map(len, items))


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "one")], "item_id LONG, text STRING")
    assert ranked_search.search(docs_of(["one"]).where("false"), items).isEmpty()
    assert ranked_search.search(docs_of(["one"]), items.where("false")).isEmpty()
    assert ranked_search.search(docs_of([None, ""]), items).isEmpty()
