"""Exact, near and substring dedup against plain Python."""

import random

import pytest
from plain_texts import awkward_texts, sha, shingles, words

from limpida.llm import exact_dedup, near_dedup, substring_dedup


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


def test_grace_dedup(docs_of, texts):
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs_of(texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join(words(t)), []).append(i)
    for content, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = rows[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), i == keep, sha(content))
    kept = exact_dedup.drop_exact_duplicates(docs_of(texts))
    assert kept.columns == docs_of(texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)
    twice = docs_of(texts).union(docs_of(texts))
    assert exact_dedup.drop_exact_duplicates(twice).count() == len(groups)


def test_grace_spills_and_merges():
    rows = [[sha(str(n % 500)).encode()[:32], f"text {n % 500}" * 20, 1, n, 1] for n in range(2000)]
    out = [r for b in exact_dedup.grace(iter(rows), limit=20_000) for r in b.to_pylist()]
    assert len(out) == 500 and {r["group_size"] for r in out} == {4} and sum(r["keep_id"] for r in out) == sum(range(500))


@pytest.mark.parametrize("block", [256, 2])
def test_near_dedup(docs_of, texts, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(texts)).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i, s in enumerate(sets):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(s), find(i), find(i) == i)
    assert near_dedup.drop_near_duplicates(docs_of(texts)).count() == sum(find(i) == i for i in range(len(texts)))


def test_near_dedup_of_buckets_of_many_classes(spark):
    """Links across a bucket are those that comparing all members gives; settled members are not dealt to each other."""
    from pyspark.sql import functions as F

    pick = random.Random(9)
    base = [f"b{n}" for n in range(60)]
    texts = [" ".join([*base[:30], f"x{i}", *base[30:]]) for i in range(40)]
    texts += [" ".join(pick.choice(base) for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = docs.mapInArrow(near_dedup._signatures, near_dedup.SIGNATURE)
    nodes = signed.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    members = nodes.select(F.lit(7).cast("long").alias("bucket"), "id")
    labels = spark.createDataFrame([(i, 0) for i in range(1, 37)] + [(39, 38)], "id long, component long")
    found = {(r.a, r.b) for r in near_dedup._apart(docs, members, nodes, labels).collect()}
    component = {i: 0 for i in range(37)} | {37: 37, 38: 38, 39: 38}
    assert all(shingles(texts[a]) & shingles(texts[b]) and component[a] != component[b] for a, b in found)
    joined = near_dedup.components(spark.createDataFrame(sorted({(i, 0) for i in range(1, 37)} | {(39, 38)} | found), "a long, b long"))
    assert {r.id: r.component for r in joined.collect()} == dict.fromkeys(range(1, 40), 0)

    m, others = 5000, 10
    known = spark.range(m).select(F.lit(7).cast("long").alias("bucket"), "id", F.greatest(F.lit(0), F.col("id") - (m - others - 1)).alias("component"))
    nodes = spark.range(m).select("id", F.lit(9).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("sketch"))
    blocks = -(-(m - others) // near_dedup.BLOCK)
    assert near_dedup._dealt(known, nodes).count() == (m - others) + others * (1 + blocks)
    all_apart = known.withColumn("component", F.col("id"))
    assert near_dedup._dealt(all_apart, nodes).count() <= m * (m // near_dedup.BLOCK + 2)


def test_sketches_that_differ_in_a_sign_bit():
    """One differing bit is one, also where it is the highest of its word."""
    import pyarrow as pa

    columns = {"id": [1, 2], "component": [1, 2], "n": [9, 9], "block": [0, 0], "i": [0, 0], "j": [0, 0]}
    for bit in (0, 62, 63):
        flipped = (1 << bit) - (1 << 64 if bit == 63 else 0)
        sketches = pa.array([[0] * 16, [flipped] * 16], pa.list_(pa.int64()))
        group = pa.table({**columns, "sketch": sketches})
        assert [(int(at), near.tolist()) for at, near in near_dedup._similar(group)] == [(0, [1]), (1, [0])]
    words = [-1 - (1 << 40)] * 9 + [5] * 7
    apart = pa.table({**columns, "sketch": pa.array([[0] * 16, words], pa.list_(pa.int64()))})
    assert not list(near_dedup._similar(apart))


def check_substrings(docs_of, texts):
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), sum(gone), sha(kept))


@pytest.mark.parametrize(("hot", "most"), [(1000, 200_000), (2, 200_000), (1000, 60)])
def test_substring_dedup(spark, docs_of, texts, monkeypatch, hot, most):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "MOST_WORDS", most)
    check_substrings(docs_of, texts)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


@pytest.mark.parametrize(("hot", "most"), [(1000, 200_000), (1000, 100), (5, 100)])
def test_substring_dedup_with_an_anchor_in_a_third_of_all_rows(docs_of, monkeypatch, hot, most):
    """A run of few words stands in every third text, in other surroundings and in some equal ones."""
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "MOST_WORDS", most)
    pick = random.Random(5)
    common = "all of us know this one common phrase".split()
    texts = []
    for i in range(150):
        around = [f"w{pick.randint(0, 400)}" for _ in range(40)]
        if i % 3 == 0:
            around = [*around[:20], *common, *around[20:]] if i % 9 else ["same"] * 16 + common + [f"t{i % 2}"] * 16
        texts.append(" ".join(around))
    check_substrings(docs_of, texts)


@pytest.mark.parametrize("most", [0, 100, 10**6])
def test_shards_are_bounded(monkeypatch, most):
    """Whatever one anchor holds, no automaton gets more than the bound, and no window is lost."""
    import pyarrow as pa

    seen = []
    decide = substring_dedup._decide
    monkeypatch.setattr(substring_dedup, "_decide", lambda shard, *to: (seen.append(sum(len(r[5].split()) for r in shard)), decide(shard, *to)))
    run = b" ".join(b"w%d" % n for n in range(22))
    records = [(key, doc, doc, 0, 3, run) for key, times in ((1, 2), (2, 500), (3, 1)) for doc in range(times)]
    batches = [substring_dedup._batch(records[lo : lo + 90]) for lo in range(0, len(records), 90)]
    out = pa.Table.from_batches(substring_dedup._search(50, most)(iter(batches))).to_pylist()
    decided = sum(r["windows"] & 255 for r in out if r["text"] is None)
    undecided = [r for r in out if r["text"] is not None]
    assert max(seen, default=0) <= 50 + most + 22
    if most == 10**6:
        assert decided == 3 + 499 * 3 and not undecided
    if most == 100:
        assert decided == 3 and len(undecided) == 500 * 3 and len({r["text"] for r in undecided}) == 3
    if most == 0:
        assert not decided and len(undecided) == 503 * 3


def test_empty_tables(docs_of):
    none = docs_of(["x"]).where("false")
    assert exact_dedup.exact_duplicates(none).isEmpty() and near_dedup.near_duplicates(none).isEmpty()
    assert substring_dedup.remove_repeats(none).isEmpty()


def test_rows_without_id(docs_of, texts):
    from pyspark.sql import functions as F

    docs = docs_of(texts).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    assert exact_dedup.exact_duplicates(docs).count() == len(texts)
    near = near_dedup.near_duplicates(docs)
    assert near.count() == len(texts) and near.where("doc_id IS NULL AND NOT kept").isEmpty()
    assert substring_dedup.remove_repeats(docs).count() == len(texts)
