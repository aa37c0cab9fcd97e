"""MinHash near-deduplication with odd sketches (operator 1).

Every text gets ``MINHASHES`` MinHash samples of its 5-word shingles. Bands of them make candidates;
all samples together are folded into an odd sketch, a parity bitmap in which the pair (sample number,
value) flips one bit. The XOR of two sketches counts the samples in which two texts differ, which
estimates high similarities well: candidates below ``SKETCH_FROM`` are dropped, the others are
confirmed on the full shingle sets.

1. Equal shingle sets form one class, told by a digest of the whole set; only the row with the least
   id of each class goes on, so groups of copies weigh one row.
2. Band rows of (bucket, id) are aggregated to each bucket's least id. Each class takes the least id that
   it shares most buckets with: one link per class, confirmed on full texts. That settles nearly all.
3. Buckets whose members are still in different components are compared in blocks of bounded size, by
   sketches, in whole arrays; a large bucket is split into pairs of blocks, so no group is gathered in
   one task. Members of its largest component are settled: they meet the other members, not each other.
   Members with a similar partner meet again in their blocks with their texts; there pairs are
   confirmed on full sets, and only links that connect two components are handed on.

With 32 bands of 4 a pair at similarity 0.75 is missed with probability 5e-6, and less above; the
sketch bound lies five standard deviations below 0.75.

Defined results: words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z); a text of one to four words has its whole
sequence as one shingle; null, empty and blank texts have none and are linked with nothing. Links:
100 * intersection >= 75 * union. Very long texts count whole: their shingles are hashes in one array. Rows that repeat an id are one node. A row without id is linked with
nothing and kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.llm.components import components
from limpida.llm.tables import stored
from limpida.llm.words import chunks, mix, shingles, split_words, word_hashes

SHINGLE = 5
AT_LEAST = 75
BANDS, ROWS = 32, 4
MINHASHES = 192
SKETCH_BITS = 1024
#: Estimated similarity from which a candidate is confirmed on full sets.
SKETCH_FROM = 0.59
#: Members of a bucket that are compared at once.
BLOCK = 256

_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 32, MINHASHES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 32, MINHASHES, dtype=np.uint32) | np.uint32(1)

SIGNATURE = "doc_id long, n_shingles long, set_digest binary, bands array<long>, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = split_words(batch.column("text"), lower=True)
        values, bounds = shingles(word_hashes(words), words.first, SHINGLE)
        sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        full = np.flatnonzero(np.diff(bounds))
        bands: list = [None] * batch.num_rows
        sketches: list = [None] * batch.num_rows
        if len(full):
            low = (values >> np.uint64(32)).astype(np.uint32)
            held = np.empty_like(low)
            least = np.empty((len(full), MINHASHES), np.uint64)
            for n in range(MINHASHES):
                np.bitwise_xor(low, _XOR[n], out=held)
                np.multiply(held, _ODD[n], out=held)
                least[:, n] = np.minimum.reduceat(held, bounds[full])
            keys = np.empty((len(full), BANDS), np.uint64)
            for band in range(BANDS):
                key = np.full(len(full), band, np.uint64)
                for n in range(band * ROWS, (band + 1) * ROWS):
                    key = mix(key, least[:, n])
                keys[:, band] = key
            bit = mix(least, np.arange(MINHASHES, dtype=np.uint64)[None, :]) % np.uint64(SKETCH_BITS)
            flips = np.bincount((bit.astype(np.int64) + np.arange(len(full))[:, None] * SKETCH_BITS).ravel(), minlength=len(full) * SKETCH_BITS)
            parity = np.packbits((flips & 1).astype(np.uint8).reshape(len(full), SKETCH_BITS), axis=1).view(np.int64)
            for row, key, sketch in zip(full, keys.view(np.int64), parity, strict=True):
                bands[row], sketches[row] = key, sketch
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketches, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "set_digest", "bands", "sketch"],
        )


#: Differing bits at the sketch bound: d samples differ in 2d pairs, which leave n / 2 (1 - exp(-4d / n)) odd bits.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - np.exp((SKETCH_FROM - 1) * 4 * MINHASHES / SKETCH_BITS)))


def _differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    words = split_words(texts, lower=True)
    values, bounds = shingles(word_hashes(words), words.first, SHINGLE)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= AT_LEAST * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for whole in batches:
        for batch in chunks(iter([whole]), "text_a"):
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = zip(_sets(part.column("text_a")), _sets(part.column("text_b")), strict=True)
                good = [_alike(x, y) for x, y in sets]
                yield part.select(["a", "b"]).filter(pa.array(good))


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that full sets confirm, as a written table. Texts are dealt by id once, for both sides."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    first = pairs.join(texts.toDF("a", "text_a"), "a")
    second = first.join(texts.toDF("b", "text_b"), "b")
    return stored(second.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), "confirmed-links")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, i, j), from rows sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield table.slice(lo, hi - lo)
        rest = table.slice(edges[-1])
    if rest is not None:
        yield rest


def _similar(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of block i, each with the rows of block j in other components with a similar sketch."""
    ids, comp, size, own = (group.column(c).to_numpy() for c in ("id", "component", "n", "block"))
    # Unsigned: of a signed word numpy counts the bits of its absolute value.
    sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    y = np.flatnonzero(own == group.column("j")[0].as_py())
    for at in np.flatnonzero(own == group.column("i")[0].as_py()):
        other = y[(comp[y] != comp[at]) & (100 * np.minimum(size[y], size[at]) >= AT_LEAST * np.maximum(size[y], size[at]))]
        near = other[np.bitwise_count(sketch[other] ^ sketch[at]).sum(1, dtype=np.int64) <= MOST_BITS]
        if len(near):
            yield at, near


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a similar partner in their pair of blocks."""
    for group in _groups(batches):
        found = [np.append(near, at) for at, near in _similar(group)]
        if found:
            yield from group.take(np.unique(np.concatenate(found))).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that full sets confirm, of each pair of blocks no more than connect its components."""
    for group in _groups(batches):
        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets = _sets(group.column("text").combine_chunks())
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:  # noqa: B023
                root[c] = c = root[root[c]]  # noqa: B023
            return c

        a, b = [], []
        for at, near in _similar(group):
            for other in near.tolist():
                x, y = find(int(comp[at])), find(int(comp[other]))
                if x != y and _alike(sets[at], sets[other]):
                    root[x] = y
                    a.append(max(ids[at], ids[other]))
                    b.append(min(ids[at], ids[other]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _dealt(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of each bucket that has more than one component, once for each pair of blocks they are compared in.

    Members of the largest component are settled among themselves: their blocks meet those of the other members
    only. So with u others a bucket of m members gives about u * (2 * m - u) / BLOCK + m rows.
    """
    apart = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    of = known.join(apart, "bucket").groupBy("bucket", "component").agg(F.count("*").alias("own"))
    main = F.max(F.struct("own", (-F.col("component")).alias("component"))).alias("main")
    of = of.groupBy("bucket").agg(F.sum("own").alias("m"), main).select(
        "bucket",
        (-F.col("main.component")).alias("main"),
        F.ceil((F.col("m") - F.col("main.own")) / BLOCK).cast("int").alias("others"),
        F.ceil(F.col("main.own") / BLOCK).cast("int").alias("settled"),
    )
    is_other = F.col("component") != F.col("main")
    own = F.when(is_other, F.pmod(F.xxhash64("id"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("id"), "settled"))
    last = F.col("others") + F.when(is_other, F.col("settled")).otherwise(0) - 1
    placed = known.join(of, "bucket").withColumns({"block": own.cast("int"), "last": last}).join(nodes.select("id", "n", "sketch"), "id")
    return placed.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other")).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", "sketch"
    )


def _apart(docs: DataFrame, members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between members of a bucket that are in different components yet."""
    known = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    dealt = _dealt(known, nodes)
    met = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    paired = stored(met.mapInArrow(_with_partner, dealt.schema), "paired")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    met = paired.join(texts, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return stored(met.mapInArrow(_linked, "a long, b long").distinct(), "confirmed-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, kept, class_id (least id with the same shingle set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_signatures, SIGNATURE), "minhash")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("set_digest").agg(F.min("doc_id").alias("class_id")), "classes")
    nodes = (
        some.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands")
    )
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last")
    members = stored(rows.join(shared.select("bucket", "leader"), "bucket"), "buckets")

    most = F.max(F.struct("shared", (-F.col("leader")).alias("leader")))
    first = members.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("shared")).groupBy("id").agg(most.alias("best"))
    first = first.select(F.col("id").alias("a"), (-F.col("best.leader")).alias("b"))
    sketches = nodes.select("id", "sketch")
    similar = (
        first.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        .where(_differing("sketch_a", "sketch_b") <= MOST_BITS).select("a", "b")
    )
    links = confirmed(docs, similar)
    labels = components(links)
    more = _apart(docs, members.select("bucket", "id"), nodes, labels)
    if not more.isEmpty():
        labels = components(links.union(more))

    classed = signed.select("doc_id", "n_shingles", "set_digest").join(classes, "set_digest", "left")
    own = F.coalesce("component", "class_id", "doc_id")
    return classed.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of the least id of each group, with all their columns."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
