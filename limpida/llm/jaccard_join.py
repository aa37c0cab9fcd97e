"""Exact Jaccard join of documents in metric space (operator 11).

1 - Jaccard is a metric, and two documents link within ``RADIUS`` of it. Documents without a common shingle are at
distance 1 from each other, where the triangle inequality says nothing, so pivots are found through shared shingles:

1. Equal shingle sets are one node. All shingles have one order, rare before frequent, and a node's prefix are its
   n / 5 + 1 first ones: linked nodes share one of these, whatever the order. (Frequencies only order them; they come
   from what is frequent within parts of the input, so no table of all shingles is needed.)
2. The pivot of a shingle is the most central node that has it in its prefix, that is the one with most frequent shingles;
   a node belongs to the region of each of its shingles' pivots. Linked nodes share a shingle, hence a region.
3. Each node is measured against its home, the pivot it shares most with. Links found there already join nearly all,
   and regions that lie within one component are done.
4. A region of more than ``BLOCK`` nodes is cut: its nodes are measured against ``PIVOTS`` of them and go to the
   nearest, their Voronoi cell; a node within twice the radius of being nearest to another pivot is copied there too,
   and nodes near no pivot form a cell of their own with a window of the same kind. Cells are cut again until they are
   small or one component. One that does not shrink, a ball which no pivot can cut, is dealt out in pairs of blocks.
5. Small regions are joined exactly. Each node brings the counts of its shingles in n / 6 or more hash buckets; the sum
   of the lesser counts bounds the intersection of two nodes from above, which leaves few. These meet with their texts
   and are compared on full sets. No pair inside one component is compared or handed on.

Nothing is lost: each step keeps every pair of linked nodes together or has joined them.

Defined results: words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z); a text of one to four words has its whole
sequence as one shingle; null, empty and blank texts have none and are linked with nothing. Links:
100 * intersection >= 80 * union. Rows that repeat an id are documents of their own, named by that id. A row without id
is linked with nothing and has no component. Very long texts are read whole. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpida.llm.components import components
from limpida.llm.tables import stored
from limpida.llm.words import chunks, shingles, split_words, word_hashes

SHINGLE = 5
#: Similarity as parts of 100, and the distance it stands for.
AT_LEAST = 80
RADIUS = 1 - AT_LEAST / 100
#: Nodes that are compared at once.
BLOCK = 1024
#: Pivots by which a large region is cut.
PIVOTS = 16
#: A cell with more than this share of its region does not shrink.
SHRINKS = 0.7
#: Documents of a chunk that make a shingle frequent, and how many frequent shingles are told apart. Order only.
FREQUENT_FROM = 8
MOST_FREQUENT = 200_000
#: Shingles a bucket holds at most on average, and the least number of buckets.
FILL, LEAST_WIDTH = 6, 8
#: Keys of frequent shingles are above those of all others.
_FREQUENT = np.uint64(1 << 62)
#: Nodes of a token up to which its pairs are listed.
_FEW = 32


def _sets(texts: pa.Array) -> list[np.ndarray]:
    words = split_words(texts, lower=True)
    values, bounds = shingles(word_hashes(words), words.first, SHINGLE)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of a chunk hold: token, n."""
    for batch in chunks(batches, "text"):
        sets = _sets(batch.column("text"))
        if sets:
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            some = n >= FREQUENT_FROM
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(n[some])], ["token", "n"])


def _buckets(s: np.ndarray) -> bytes | None:
    """How many shingles fall into each of a power of two of buckets, as bytes; none where a byte is too small."""
    width = LEAST_WIDTH
    while width * FILL < len(s):
        width *= 2
    counts = np.bincount((s & np.uint64(width - 1)).view(np.int64), minlength=width)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


SIGNATURE = "doc_id long, n_shingles long, set_digest binary, central long, prefix array<long>, buckets binary"


def _signatures(frequent):
    """``frequent``: two arrays, frequent tokens in order of value and the rank of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        for batch in chunks(batches, "text"):
            sets = _sets(batch.column("text"))
            central, prefixes = [], []
            for s in sets:
                keys = s >> np.uint64(2)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    keys[hit] = _FREQUENT + rank[at[hit]]
                    central.append(1000 * int(hit.sum()) // max(1, len(s)))
                else:
                    central.append(0)
                keys.sort()
                prefixes.append(keys[: len(s) // 5 + 1].view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array(central, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array([_buckets(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_digest", "central", "prefix", "buckets"],
            )

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """A written row per document: id, number in order of centrality, set size and digest, prefix."""
    counted = docs.select("text").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.arange(len(tokens), 0, -1).astype(np.uint64)
    frequent = docs.sparkSession.sparkContext.broadcast((tokens[order], rank[order]))
    signed = docs.mapInArrow(_signatures(frequent), SIGNATURE)
    number = F.shiftleft(1000 - F.col("central"), 52) + F.monotonically_increasing_id()
    return stored(signed.withColumn("no", number), "shingle-sets")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of ``keys``, from rows sorted by them. Groups are small by construction."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        values = np.stack([table.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield table.slice(lo, hi - lo)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets (of distinct tokens) have in common."""
    m = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    group = np.cumsum(np.diff(tokens, prepend=tokens[:1]) != 0)
    size = np.bincount(group)[group]
    few = (size > 1) & (size <= _FEW)
    t, o = group[few], owner[few]
    pairs = []
    for d in range(1, _FEW):
        same = t[d:] == t[:-d]
        if not same.any():
            break
        pairs.append(o[:-d][same] * m + o[d:][same])
    counts = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m) if pairs else np.zeros((m, m), np.int64)
    counts = counts + counts.T
    many = size > _FEW
    if many.any():
        columns, t = np.unique(group[many], return_inverse=True)
        o = owner[many]
        for lo in range(0, len(columns), 4096):
            here = (t >= lo) & (t < lo + 4096)
            held = np.zeros((m, min(4096, len(columns) - lo)), np.float32)
            held[o[here], t[here] - lo] = 1
            counts += (held @ held.T).astype(np.int64)
    return counts


def _apart(group: pa.Table) -> np.ndarray:
    """Which pairs of a group's rows are to be compared: a left one and a right one of different components."""
    component, side, no = (group.column(c).to_numpy() for c in ("component", "side", "no"))
    return (component[:, None] != component) & (side >= 1)[:, None] & (side != 1) & (no[:, None] != no)


def _most_common(buckets: list[np.ndarray], pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An upper bound of the intersection of each of ``pairs``, which are of similar size; 0 for all others."""
    width = np.array([len(b) for b in buckets])
    most = np.zeros(pairs.shape, np.int64)
    folded: dict[int, np.ndarray] = {}
    for w in sorted({int(w) for w in width[pairs.any(1)] if w}, reverse=True):
        folded[w] = np.zeros((len(buckets), w), np.uint16)
        for k in np.flatnonzero(width >= w):
            folded[w][k] = buckets[k].reshape(-1, w).sum(0) if width[k] <= 4 * w else 0
    for a in np.flatnonzero(pairs.any(1)):
        for w in folded:
            b = np.flatnonzero(pairs[a] & (np.minimum(width, width[a]) == w))
            if len(b):
                most[a, b] = np.minimum(folded[w][b], folded[w][a]).sum(1, dtype=np.int64)
    unknown = pairs & ((width == 0)[:, None] | (width == 0))
    return np.where(unknown, np.minimum(n[:, None], n), most)


def _could_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a group with a partner with which their buckets leave room for a link."""
    for group in _runs(batches, ["region", "i", "j"]):
        if group.num_rows < 2:
            continue
        n = group.column("n").to_numpy()
        pairs = _apart(group) & (100 * np.minimum(n[:, None], n) >= AT_LEAST * np.maximum(n[:, None], n))
        if not pairs.any():
            continue
        buckets = [np.frombuffer(b, np.uint8).astype(np.uint16) for b in group.column("buckets").to_pylist()]
        good = pairs & ((100 + AT_LEAST) * _most_common(buckets, pairs, n) >= AT_LEAST * (n[:, None] + n))
        some = good.any(0) | good.any(1)
        if some.any():
            yield from group.filter(pa.array(some)).drop_columns(["buckets"]).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that full sets confirm, of each group no more than join its components."""
    for group in _runs(batches, ["region", "i", "j"]):
        sets = _sets(group.column("text").combine_chunks())
        real = [_digest(s) == d for s, d in zip(sets, group.column("set_digest").to_pylist(), strict=True)]
        group = group.filter(pa.array(real))
        sets = [s for s, r in zip(sets, real, strict=True) if r]
        if len(sets) < 2:
            continue
        n = np.array([len(s) for s in sets])
        counts = common_counts(sets)
        good = _apart(group) & (counts > 0) & ((100 + AT_LEAST) * counts >= AT_LEAST * (n[:, None] + n))
        no, component = group.column("no").to_numpy(), group.column("component").to_pylist()
        root = {c: c for c in component}

        def find(c: int) -> int:
            while root[c] != c:  # noqa: B023
                root[c] = c = root[root[c]]  # noqa: B023
            return c

        a, b = [], []
        for x, y in zip(*np.nonzero(good), strict=True):
            p, q = find(component[x]), find(component[y])
            if p != q:
                root[p] = q
                a.append(no[x])
                b.append(no[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


MEASURED = "region long, no long, n long, pivots array<long>, sizes array<long>, common array<long>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's number of shingles in common with every pivot of its region; pivots come first."""
    key, pivots, known, held = None, [], None, None
    for whole in batches:
        for batch in chunks(iter([whole]), "text"):
            sets = _sets(batch.column("text"))
            columns = [batch.column(c).to_pylist() for c in ("region", "salt", "member", "no", "n", "set_digest")]
            rows = []
            for region, salt, member, no, n, digest, s in zip(*columns, sets, strict=True):
                if key != (region, salt):
                    key, pivots, known = (region, salt), [], None
                if _digest(s) != digest:
                    continue
                if not member:
                    if all(no != p[0] for p in pivots):
                        pivots.append((no, n, s))
                    continue
                if known is None and pivots:
                    known, at = np.unique(np.concatenate([p[2] for p in pivots]), return_inverse=True)
                    held = np.zeros((len(known), len(pivots)), np.int32)
                    held[at, np.repeat(np.arange(len(pivots)), [p[1] for p in pivots])] = 1
                if pivots:
                    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = held[place[known[place] == s]].sum(0)
                    rows.append((region, no, n, [p[0] for p in pivots], [p[1] for p in pivots], common))
            if rows:
                types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["region", "no", "n", "pivots", "sizes", "common"])


def _with_text(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with size, set digest and text of each node (text rows of other nodes with its id are told by the digest)."""
    of = nodes.select("no", "id", "n", "set_digest")
    return rows.drop("n", "set_digest").join(of, "no").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")


def _measure(docs: DataFrame, nodes: DataFrame, members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members (region, no) measured against their regions' pivots (region, no); a large region in many tasks."""
    salts = members.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    dealt = members.select("region", "no").join(salts, "region").select("region", F.pmod(F.xxhash64("no"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "no")
    every = pivots.select("region", "no").join(salts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), "no")
    met = _with_text(dealt.union(every), docs, nodes).repartition("region", "salt").sortWithinPartitions("region", "salt", "member")
    return met.mapInArrow(_measured, MEASURED)


def _links(measured: DataFrame) -> DataFrame:
    """Links (a, b) of members with pivots."""
    each = measured.select("no", "n", F.explode(F.arrays_zip("pivots", "sizes", "common")).alias("p"))
    near = (100 + AT_LEAST) * F.col("p.common") >= AT_LEAST * (F.col("n") + F.col("p.sizes"))
    return each.where(near & (F.col("no") != F.col("p.pivots"))).select(F.col("no").alias("a"), F.col("p.pivots").alias("b"))


def _cells(measured: DataFrame, level: int) -> DataFrame:
    """Members in their cells (region, cell, no): those a node may be nearest in, and that of nodes far from all pivots."""
    distance = F.zip_with("common", "sizes", lambda c, s: 1 - c / (F.col("n") + s - c))
    home, slack = F.array_min("distance"), 1e-9
    near = F.filter(F.sequence(F.lit(1), F.size("distance")), lambda k: F.get("distance", k - 1) <= home + 2 * RADIUS + slack)
    none = F.array().cast("array<int>")
    near = F.when(home <= 1 - 2 * RADIUS, near).otherwise(none)
    far = F.when(home > 1 - 3 * RADIUS - slack, F.array(F.lit(0))).otherwise(none)
    placed = measured.withColumn("distance", distance).select("region", "no", F.explode(F.concat(near, far)).alias("cell"))
    return placed.select("region", F.xxhash64("region", "cell", F.lit(level)).alias("cell"), "no")


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of regions that hold several components, with component, m (nodes) and largest component."""
    known = members.select("region", "no").join(labels.withColumnRenamed("id", "no"), "no", "left").withColumn("component", F.coalesce("component", "no"))
    each = known.groupBy("region", "component").agg(F.count("*").alias("c"))
    largest = each.groupBy("region").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("component", "c").alias("largest")).where("most < m")
    return known.join(largest, "region")


def _compare(docs: DataFrame, nodes: DataFrame, apart: DataFrame) -> DataFrame:
    """Links between components of each region, all nodes outside the largest component against all nodes."""
    out = F.col("m") - F.col("most")
    blocks, left = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(out / BLOCK).cast("int")
    base = apart.join(nodes.select("no", "n", "buckets"), "no").withColumns({"blocks": blocks, "left": left, "outside": F.col("component") != F.col("largest")})
    own = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")
    own_left = F.pmod(F.xxhash64("no"), F.col("left")).cast("int")
    keep = ["region", "no", "component", "n", "buckets"]
    one = base.where("blocks = 1").select(*keep, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    large = base.where("blocks > 1")
    lefts = large.where("outside").select(*keep, own_left.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(1).alias("side"))
    rights = large.select(*keep, F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), own.alias("j"), F.lit(0).alias("side"))
    dealt = one.union(lefts).union(rights)
    met = dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    close = stored(met.mapInArrow(_could_link, dealt.drop("buckets").schema), "close")
    met = _with_text(close, docs, nodes).repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    return met.mapInArrow(_linked, "a long, b long").distinct()


def join_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (no, id, n, set_digest, prefix, buckets) that have links: id (their number), component (least number)."""
    rows = nodes.select("no", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.min("no").alias("region"), F.max("no").alias("last")).where("region <> last")
    members = stored(rows.join(shared.select("token", "region"), "token").groupBy("region", "no").agg(F.count("*").alias("shared")), "regions")

    # Home pivots: only where much is shared. Which are tried changes no result.
    home = members.where("no <> region").groupBy("no").agg(F.max_by("region", "shared").alias("region"), F.max("shared").alias("shared"))
    home = home.join(nodes.select("no", "n"), "no").where("shared * 3 >= n DIV 5 + 1")
    centres = home.select("region").distinct().select("region", F.col("region").alias("no"))
    links = stored(_links(_measure(docs, nodes, home, centres)), "links")
    labels = components(links)
    members, level, ready = members.select("region", "no"), 0, None
    while True:
        apart = stored(_split(members, labels), "apart")
        large = apart.where(F.col("m") > BLOCK)
        if level and not large.isEmpty():
            parents = members.select("region", "parent").distinct()
            dense = large.join(parents, "region").where(F.col("m") > SHRINKS * F.col("parent")).drop("parent")
            large = large.join(dense.select("region").distinct(), "region", "left_anti")
            small = apart.where(F.col("m") <= BLOCK).unionByName(dense)
        else:
            small = apart.where(F.col("m") <= BLOCK)
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            break
        level += 1
        first = Window.partitionBy("region").orderBy(F.xxhash64("no", F.lit(level)), "no")
        picked = large.select("region", "no", F.row_number().over(first).alias("k")).where(F.col("k") <= PIVOTS)
        measured = stored(_measure(docs, nodes, large, picked), "measured")
        parents = large.groupBy("region").agg(F.first("m").alias("parent"))
        cells = _cells(measured, level).join(parents, "region")
        members = stored(cells.select(F.col("cell").alias("region"), "no", "parent").distinct(), "cells")
        links = stored(links.union(_links(measured)).distinct(), "links")
        labels = components(links)
    if level:
        ready = _split(ready.select("region", "no"), labels)
    more = stored(_compare(docs, nodes, ready), "links")
    return labels if more.isEmpty() else components(links.union(more))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, class_id (least id with the same shingle set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = signatures(docs)
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("set_digest").agg(F.min("doc_id").alias("class_id"), F.min("no").alias("no")), "classes")
    nodes = some.join(classes.select("no"), "no", "left_semi").select("no", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "set_digest", "prefix", "buckets")
    labels = join_components(docs, nodes).select(F.col("id").alias("no"), "component")
    # The least node of a component has no row of its own there.
    labels = labels.union(labels.select("component", "component").distinct())
    named = classes.join(labels, "no")
    names = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = classes.join(named.select("no", "component").join(names, "component").select("no", "component_id"), "no", "left").drop("no")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_digest")).alias("set_digest"))
    return rows.join(known, "set_digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
