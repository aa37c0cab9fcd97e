"""Language-model scores by a probabilistic suffix tree (operator 3).

Symbols are tokens: the words of a text and its end. A context is any run of 1 to ``LONGEST`` words before
a token. It is retained if it occurs at least ``MIN_TIMES`` times in the learning texts, whatever their
size, and if its next tokens diverge from those of its parent, the context without the first word, by more
than ``COST`` nats a distinct next token; the parent of a single word is the empty context. At each token
the longest retained context that ends there is the state; with n occurrences and k distinct next tokens
the token's probability is (count + k * base) / (n + k), base being the smoothed frequency of the token,
(c + 1) / (N + V + 1).

Contexts are counted in ``STEPS`` of lengths. Only open contexts are extended, those that a longer retained context
can end with (``_extendable``): an extension with n of its parent's N occurrences gains n * ln(N / n) nats at most, so
that few occurrences, or next tokens that all differ, leave nothing to retain. Which are open goes to the workers as a bit
per hash value, in a table. Where two contexts share a bit some are counted in vain; they fail the exact
tests like others, so the tree does not depend on the bits. The table has ``BITS_EACH`` bits for each context, counted
before, and ``MOST_BITS`` (a power of two: 16 MB) at most; above some ten million open contexts more are counted in vain.

Counts travel as packed arrays, one for each task's share and bucket. All extensions of a context meet in one bucket, where their
sum, with the places at which a text begins, is the distribution of the parent: no counts are stored or joined. A parent with over
``HOT_TIMES`` occurrences (the empty context is one) is dealt by its next tokens instead, and its extensions meet in a second
exchange; so no bucket has to hold more than the vocabulary of a context besides its share. Inside the steps of several lengths hot parents
are not known yet; contexts of four words and more that occur so often are repeated passages with few different neighbours.

That is ``learn_tree``, which gives the tree as a table. ``score_texts`` needs no such table: the same contexts are judged by the
same test where their places meet. Texts are read once, into word numbers of their block; each place goes, with the words before it up
to the next of ``CUTS``, to the bucket of its context, and open contexts are handed over with all that is known of them.

Defined results: null, empty and blank texts have the end as their only token. A row without id is
never held out. Repeated rows count as often as they come. Without any learning text all tokens are
unknown. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpida.llm.tables import stored
from limpida.llm.words import chunks, mix, split_words, word_hashes

LONGEST = 12
#: Lengths of contexts that are counted in one pass over the texts.
STEPS = ((1,), (2,), (3,), (4, 5, 6), tuple(range(7, LONGEST + 1)))
#: A context is never retained with fewer occurrences.
MIN_TIMES = 2
COST = 2.0
#: Bits of a table by which open and retained contexts are told, for each context, and powers of two of the whole table.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 12, 27
#: Occurrences from which the next tokens of a context are dealt to several tasks.
HOT_TIMES = 500_000
#: Learning tokens for each bucket; places that a task gathers before it hands on what it has.
BUCKET, GATHER = 500_000, 1_000_000
#: Lengths of contexts at which those that go on are handed to another pass over the texts, which deals them by context.
CUTS = (3, LONGEST)
#: Rows (4096 at most: their numbers have 12 bits), and tokens, from which a block of texts is closed, whose words are looked up together.
BLOCK, BLOCK_TOKENS = 4096, 1_000_000
_END = np.uint64(0x656E64)
_SEED = np.uint64(2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the bounds of each text's part."""
    words = split_words(texts, lower=True)
    bounds = words.first + np.arange(len(words.first))
    out = np.full(bounds[-1], _END, np.uint64)
    is_word = np.ones(bounds[-1], bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = word_hashes(words)
    return out, bounds


def _among(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the ordered array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of a context and its next token; not the hash of a longer context."""
    return mix(~context, token)


def _marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - 6 - (len(bits).bit_length() - 1))
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bits(contexts: DataFrame) -> np.ndarray:
    """A bit for each row of ``contexts``; at most 2 ** (MOST_BITS - 6) rows come to the driver, whatever the corpus."""
    power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * contexts.count()).bit_length()))
    slot = F.shiftrightunsigned("context", 64 - power)
    bit = f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(context, {64 - power}) & 63 AS INT)))"
    rows = contexts.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.expr(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _extended(tokens: np.ndarray, bounds: np.ndarray, open_: dict[int, np.ndarray], last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places by length: length, position of the next token, hash of the parent, its extending word, whether the text has one."""
    starts = np.repeat(bounds[:-1], np.diff(bounds))
    at, chain = np.arange(len(tokens)), np.full(len(tokens), _SEED)
    for length in range(1, last + 1):
        inside = at - length >= starts[at]
        first = tokens[np.maximum(at - length, 0)]
        yield length, at, chain, first, inside
        at, chain = at[inside], mix(chain[inside], first[inside])
        if length in open_:
            going = _marked(chain, open_[length])
            at, chain = at[going], chain[going]


def _contexts(tokens: np.ndarray, bounds: np.ndarray, open_: dict[int, np.ndarray], last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts by length: position of the next token, hash."""
    for _, at, parent, first, inside in _extended(tokens, bounds, open_, last):
        yield at[inside], mix(parent[inside], first[inside])


def _extendable(times: np.ndarray, kinds: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether longer contexts that end with these can be retained: occurrences, distinct next tokens, the commonest one's count.

    Longer ones have part of these N places. With n of them and k next tokens they gain n * ln(N / n) at most, the parent's
    counts being no lower than their own. To exceed COST * k with MIN_TIMES places takes N > 2 e, or, where each token came
    once and so k = n, N > 2 e**2. A single next token stays as likely as it was.
    """
    alone = MIN_TIMES * np.exp(COST)
    some = MIN_TIMES * np.exp(COST / MIN_TIMES)
    return (kinds > 1) & (times > np.where(most > 1, some, alone))


_COUNTED = "kind int, bucket int, size long, part binary, key long, x long, y long"
_PART, _TREE, _OPEN = range(3)


def _rows(kind: int, bucket: list, size: list, part: list, key: np.ndarray, x: np.ndarray, y: np.ndarray | None) -> pa.RecordBatch:
    n = max(len(part), len(key))
    null = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(bucket, pa.int32()) if part else null(pa.int32()),
            pa.array(size, pa.int64()) if part else null(pa.int64()),
            pa.array(part, pa.binary()) if part else null(pa.binary()),
            null(pa.int64()) if part else pa.array(key.view(np.int64)),
            null(pa.int64()) if part else pa.array(x),
            null(pa.int64()) if part or y is None else pa.array(y, mask=y == 0),
        ],
        [f.split()[0] for f in _COUNTED.split(", ")],
    )


def _parts(bucket: np.ndarray, group: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets, each with all columns of its share, neighbours by ``group``, packed."""
    if not len(bucket):
        return
    order = np.argsort(group)
    order = order[np.argsort(bucket[order], kind="stable")]
    of = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    parts = [pa.compress(np.stack([c.view(np.uint64)[order[a:b]] for c in columns]).tobytes(), codec="zstd", asbytes=True) for a, b in spans]
    for lo in range(0, len(parts), 64):
        some = spans[lo : lo + 64]
        yield _rows(_PART, of[[a for a, _ in some]].tolist(), [b - a for a, b in some], parts[lo : lo + 64], order[:0], order[:0], None)


def _summed(key: np.ndarray, n: np.ndarray, keys: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key (or the keys) and the sum of n over it."""
    order = np.argsort(key)
    key = key[order]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    return key[edges] if keys else order[edges], np.add.reduceat(n[order], edges) if len(key) else n


def _totals(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place the sum of n over its key."""
    found, at = np.unique(key, return_inverse=True)
    return np.bincount(at, n, len(found))[at]


def _child(parent: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the extended context; where the text begins (0) one that stands for no context."""
    return np.where(first == 0, ~parent, mix(parent, first))


def _merged(parts: list[tuple]) -> tuple:
    """Parent, extending word, token and count, once each."""
    parent, first, token, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    one, n = _summed(_pair(_child(parent, first), token), n)
    return parent[one], first[one], token[one], n


def _count_next(lengths: tuple[int, ...], shared, hot: tuple, buckets: int):
    """The parts of all buckets: how often which token follows which extension of which open context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {k: bits.value for k, bits in shared.items()}
        parts, held = [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            parent, first, token, n = _merged(parts)
            parts.clear()
            is_hot, _ = _among(parent, hot[0])
            bucket = np.where(is_hot, _pair(parent, token), parent) % np.uint64(buckets)
            yield from _parts(bucket, np.where(is_hot, _child(parent, first), parent), parent, first, token, n)

        for batch in chunks(batches, "text"):
            tokens, bounds = _tokens(batch.column("text"))
            for length, at, parent, first, inside in _extended(tokens, bounds, open_, lengths[-1]):
                if length in lengths and len(at):
                    parts.append((parent, np.where(inside, first, np.uint64(0)), tokens[at], np.ones(len(at), np.int64)))
                    held += len(at)
                if held > GATHER:
                    yield from hand_on()
                    held = 0
        yield from hand_on()

    return run


def _buckets(batches: Iterator[pa.RecordBatch], merge) -> Iterator[tuple | pa.RecordBatch]:
    """The merged columns of each bucket, from parts sorted by bucket; rows of other kinds as they are."""
    bucket, parts, held = None, [], 0
    for batch in batches:
        is_part = batch.column("kind").to_numpy() == _PART
        if not is_part.all():
            yield batch.filter(pa.array(~is_part))
        for row in np.flatnonzero(is_part).tolist():
            of, size = batch.column("bucket")[row].as_py(), batch.column("size")[row].as_py()
            if of != bucket and parts:
                yield merge(parts)
                parts, held = [], 0
            raw = pa.decompress(batch.column("part")[row].as_buffer(), 32 * size, codec="zstd")
            a, b, c, n = np.frombuffer(raw, np.uint64).reshape(4, size)
            parts.append((a, b, c, n.view(np.int64)))
            bucket, held = of, held + size
            if held > 2 * GATHER:
                parts = [merge(parts)]
                held = len(parts[0][0])
    if parts:
        yield merge(parts)


def _judged(context: np.ndarray, token: np.ndarray, n: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the retained and of the open contexts, given the log probability of each token after the parent."""
    if not len(context):
        return
    order = np.argsort(context)
    context, token, n, before = context[order], token[order], n[order], before[order]
    edges = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    kinds = np.diff(np.append(edges, len(n)))
    times = np.add.reduceat(n, edges)
    gain = np.add.reduceat(n * (np.log(n / np.repeat(times, kinds)) - before), edges)
    kept = (times >= MIN_TIMES) & (gain > COST * kinds)
    pairs = np.repeat(kept, kinds)
    key = np.concatenate([_pair(context[pairs], token[pairs]), context[edges[kept]]])
    yield _rows(_TREE, [], [], [], key, np.append(n[pairs], times[kept]), np.append(np.zeros(pairs.sum(), np.int64), kinds[kept]))
    going = _extendable(times, kinds, np.maximum.reduceat(n, edges))
    yield _rows(_OPEN, [], [], [], context[edges[going]], times[going], None)


def _by_parent(hot: tuple, buckets: int):
    """Judges extensions of parents that are whole in a bucket; those of hot ones go on, by extension, with the parent's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _buckets(batches, _merged):
            parent, first, token, n = found
            is_hot, which = _among(parent, hot[0])
            times = _totals(parent, n)
            if len(hot[0]):
                times = np.where(is_hot, hot[1][which], times)
            before = np.log(_totals(_pair(parent, token), n) / times)
            context, real = _child(parent, first), first != 0
            whole = real & ~is_hot
            yield from _judged(context[whole], token[whole], n[whole], before[whole])
            on = real & is_hot
            yield from _parts(context[on] % np.uint64(buckets), context[on], context[on], token[on], before[on], n[on])

    return run


def _by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the extensions of hot parents, whose pairs with tokens are distinct already."""
    for found in _buckets(batches, lambda parts: tuple(np.concatenate(c) for c in zip(*parts, strict=True))):
        if isinstance(found, pa.RecordBatch):
            yield found
        else:
            yield from _judged(found[0], found[1], found[3], found[2].view(np.float64))


def learn_tree(learning: DataFrame, n_train: int) -> tuple[DataFrame, dict]:
    """Rows (key, x, y) of the retained contexts, and the bits of open contexts by length.

    A context has a row (its hash, occurrences, number of next tokens) and one for each next token
    (hash of both, count, null). ``n_train``: the learning tokens, ends included.
    """
    spark = learning.sparkSession
    buckets = 1 + n_train // BUCKET
    hot = (np.array([_SEED]), np.array([n_train], np.int64))
    open_, tree = {}, None

    def dealt(parts: DataFrame) -> DataFrame:
        return parts.repartition("bucket").sortWithinPartitions("bucket")

    for lengths in STEPS:
        rows = dealt(learning.select("text").mapInArrow(_count_next(lengths, open_, hot, buckets), _COUNTED)).mapInArrow(_by_parent(hot, buckets), _COUNTED)
        if len(hot[0]):
            # Rows that are judged already pass; they are dealt by their key.
            rows = rows.withColumn("bucket", F.coalesce("bucket", (F.col("key") % buckets).cast("int")))
            rows = dealt(rows).mapInArrow(_by_context, _COUNTED)
        rows = stored(rows.select("kind", "key", "x", "y"), "contexts")
        kept = rows.where(F.col("kind") == _TREE).select("key", "x", "y")
        tree = kept if tree is None else tree.union(kept)
        going = rows.where(F.col("kind") == _OPEN).select(F.col("key").alias("context"), "x")
        bits = _bits(going.select("context"))
        if lengths[-1] == LONGEST or not bits.any():
            break
        open_[lengths[-1]] = spark.sparkContext.broadcast(bits)
        often = going.where(F.col("x") > HOT_TIMES).toArrow()
        keys = often.column("context").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        hot = (keys[order], often.column("x").to_numpy()[order])
    return tree, open_


_RUN = "kind int, bucket long, part binary, block long, depth int, key long, x long, y double, doc_ids array<long>"
_TYPES = {"kind": pa.int32(), "bucket": pa.int64(), "part": pa.binary(), "block": pa.int64(), "depth": pa.int32(), "key": pa.int64(), "x": pa.int64(), "y": pa.float64(), "doc_ids": pa.list_(pa.int64())}
_WORDS, _TEXTS, _SUMS, _FREQUENT = range(4)
_CONTEXT, _SAME, _PLACES, _SCORES, _EXTENDED = range(4, 9)


def _made(kind: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of one kind: columns not given are null."""
    given = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))


def _packed(*columns: np.ndarray) -> bytes:
    """Integer columns of any lengths, each as the planes of the bytes it needs above its least value; long runs once, with lengths."""
    head, planes = [], []

    def put(c: np.ndarray, is_runs: bool) -> None:
        c = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)
        low = c.min() if len(c) else np.int64(0)
        above = np.ascontiguousarray((c - low).view(np.uint64))
        width = (int(above.max()).bit_length() + 7) // 8 if len(c) else 0
        at = np.flatnonzero(_changes(c)) if not is_runs else c[:0]
        if not is_runs and len(at) * (width + 1) < len(c) * width:
            put(c[at], True)
            put(np.diff(np.append(at, len(c))), True)
            return
        head.extend([len(c), int(low), width, is_runs])
        planes.extend(above.view(np.uint8)[i::8].tobytes() for i in range(width))

    for c in columns:
        put(c, False)
    raw = b"".join([np.array([len(head) // 4, *head], np.int64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(part: bytes) -> list[np.ndarray]:
    raw = pa.decompress(pa.py_buffer(part)[8:], int.from_bytes(part[:8], "little"), codec="zstd")
    data = np.frombuffer(raw, np.uint8)
    (pieces,) = data[:8].view(np.int64)
    at, out, values = 8 + 32 * pieces, [], None
    for n, low, width, is_runs in data[8:at].view(np.int64).reshape(-1, 4).tolist():
        narrow = low >= 0 and low + (1 << 8 * width) <= 1 << 32
        size = 4 if narrow else 8
        c = np.zeros(n, np.uint32 if narrow else np.uint64)
        for i in range(width):
            c.view(np.uint8)[i::size] = data[at : at + n]
            at += n
        c += c.dtype.type(low % (1 << 64))
        c = c if narrow else c.view(np.int64)
        if not is_runs:
            out.append(c)
        elif values is None:
            values = c
        else:
            out.append(np.repeat(values, c))
            values = None
    return out


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*parts, strict=True)]


def _dealt(kind: int, bucket: np.ndarray, order: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A packed row for each bucket, its share of the columns in the given order."""
    if not len(bucket):
        return
    small = bucket[order].astype(np.uint16) if bucket.max() < 1 << 16 else bucket[order]
    order = order[np.argsort(small, kind="stable")]
    of = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for lo in range(0, len(cuts) - 1, 64):
        spans = list(zip(cuts[lo : lo + 64], cuts[lo + 1 : lo + 65], strict=False))
        yield _made(kind, len(spans), bucket=of[[a for a, _ in spans]].astype(np.int64), part=[_packed(*(c[order[a:b]] for c in columns)) for a, b in spans])


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    if not len(major) or int(major.max()) >> 31 or int(minor.max()) >> 32:
        return np.lexsort((minor, major))
    return np.argsort((major.astype(np.int64) << 32) | minor.astype(np.int64))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each place begins a run of equal values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _encode(word_buckets: int):
    """Texts as numbers of the words of their block, commonest first from 1 (0: the end), and these words, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, parts = TaskContext.get().partitionId() << 24, 0, []

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if not parts:
                return
            hashes = np.concatenate([t for t, *_ in parts])
            sizes = np.concatenate([s for _, s, *_ in parts])
            learned = np.concatenate([x for _, _, x, _ in parts])
            ids = [x for p in parts for x in p[3].to_pylist()]
            parts.clear()
            is_word = np.ones(len(hashes), bool)
            is_word[np.cumsum(sizes) - 1] = False
            words, at = np.unique(hashes[is_word], return_inverse=True)
            times = np.bincount(at, minlength=len(words))
            n = np.bincount(at, np.repeat(learned, sizes)[is_word], len(words)).astype(np.int64)
            order = np.argsort(-times, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(1, len(words) + 1)
            coded = np.zeros(len(hashes), np.int64)
            coded[is_word] = number[at]
            yield _made(_TEXTS, 1, bucket=[block % word_buckets], block=[block], part=[_packed(coded, sizes, learned)], doc_ids=[ids])
            yield _made(_SUMS, 1, bucket=[block % word_buckets], block=[block], x=[int(learned.sum())])
            of = (words[order] % np.uint64(word_buckets)).astype(np.int64)
            for batch in _dealt(_WORDS, of, np.arange(len(of)), words[order], np.arange(1, len(of) + 1), n[order], times[order]):
                yield batch.set_column(list(_TYPES).index("block"), "block", pa.array(np.full(batch.num_rows, block)))
            block += 1

        for batch in chunks(batches, "text"):
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if held + part.num_rows > BLOCK or sum(len(t) for t, *_ in parts) > BLOCK_TOKENS:
                    yield from hand_on()
                    held = 0
                tokens, bounds = _tokens(part.column("text"))
                learned = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                parts.append((tokens, np.diff(bounds), learned.astype(np.int64), part.column("doc_id")))
                held += part.num_rows
        yield from hand_on()

    return run


def _number(word_buckets: int, hot_times: int):
    """Numbers for the words of each bucket, commonest first, sent back with their counts to the blocks."""

    def numbered(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        blocks = [b for b, _ in parts]
        columns = [_unpacked(p) for _, p in parts]
        word, local, n, times = _joined(columns)
        words, at = np.unique(word.astype(np.uint64), return_inverse=True)
        n = np.bincount(at, n, len(words)).astype(np.int64)
        times = np.bincount(at, times, len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-times, kind="stable")] = 1 + bucket + word_buckets * np.arange(len(words))
        yield _made(_SUMS, 1, block=[bucket], x=[int(n.sum())], y=[float((n > 0).sum())])
        often = times > hot_times
        yield _made(_FREQUENT, int(often.sum()), block=np.full(often.sum(), bucket), key=number[often], x=times[often])
        ends = np.cumsum([len(c[0]) for c in columns]).tolist()
        for lo in range(0, len(blocks), 64):
            some = range(lo, min(lo + 64, len(blocks)))
            spans = [slice(ends[i] - len(columns[i][0]), ends[i]) for i in some]
            yield _made(_WORDS, len(some), block=[blocks[i] for i in some], part=[_packed(local[s], number[at[s]], n[at[s]]) for s in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            is_words = batch.column("kind").to_numpy() == _WORDS
            if not is_words.all():
                yield batch.filter(pa.array(~is_words))
            for i in np.flatnonzero(is_words).tolist():
                of = batch.column("bucket")[i].as_py()
                if of != bucket and parts:
                    yield from numbered(bucket, parts)
                    parts = []
                bucket = of
                parts.append((batch.column("block")[i].as_py(), batch.column("part")[i].as_py()))
        if parts:
            yield from numbered(bucket, parts)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block with the numbers and learning counts of its words; sorted by block and kind."""
    parts = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (rest := kinds > _TEXTS).any():
            yield batch.filter(pa.array(rest))
        for i in np.flatnonzero(~rest).tolist():
            part = _unpacked(batch.column("part")[i].as_py())
            if kinds[i] == _WORDS:
                parts.append(part)
                continue
            number, n = (np.zeros(1 + sum(len(p[0]) for p in parts), np.int64) for _ in range(2))
            for local, numbers, counts in parts:
                number[local], n[local] = numbers, counts
            parts = []
            yield _made(_TEXTS, 1, block=[batch.column("block")[i].as_py()], part=[_packed(*part, number, n)], doc_ids=batch.column("doc_ids").slice(i, 1))


def _texts(batches: Iterator[pa.RecordBatch], n_ends: int) -> Iterator[tuple]:
    """Of each block: number, doc_ids, word numbers and learning counts of all tokens, sizes of texts, whether they are learned."""
    for batch in batches:
        for i in range(batch.num_rows):
            coded, sizes, learned, number, n = _unpacked(batch.column("part")[i].as_py())
            n[0] = n_ends
            yield batch.column("block")[i].as_py(), batch.column("doc_ids")[i].values, number[coded], n[coded], sizes.astype(np.int64), learned.astype(np.int64)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_BASE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"


def _base(n_train: int, n_distinct: int, n_ends: int):
    """A row for each text, without what contexts add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, _, count, sizes, learned in _texts(batches, n_ends):
            first = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10((count + 1) / (n_train + n_distinct + 1)), first)
            known = np.add.reduceat((count > 0).astype(np.int64), first)
            rows = (block << 12) + np.arange(len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(learned == 0), pa.array(sizes), pa.array(known), pa.array(base)], [f.split()[0] for f in _BASE.split(", ")])

    return run


def _followed(number: np.ndarray, sizes: np.ndarray, depth: int, open_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which an open context of the given length ends, their hashes, and the start of each token's text."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, chain = np.arange(len(number)), np.full(len(number), _SEED)
    for k in range(1, depth + 1):
        inside = at - k >= start[at]
        at = at[inside]
        chain = mix(chain[inside], number[at - k].astype(np.uint64))
    if depth:
        going = _marked(chain, open_.value)
        at, chain = at[going], chain[going]
    return at, chain, start


def _shares(chain: np.ndarray, word: np.ndarray, hot: tuple, buckets: int) -> np.ndarray:
    """The bucket of each place: of its context, or where that is hot one of several by the word before it."""
    is_hot, which = _among(chain, hot[0])
    out = chain % np.uint64(buckets)
    if is_hot.any():
        some = hot[1][which[is_hot]].astype(np.uint64)
        out[is_hot] = (out[is_hot] + mix(chain[is_hot], word[is_hot].astype(np.uint64)) % some) % np.uint64(buckets)
    return out.astype(np.int64)


def _extensions(depth: int, open_, hot: tuple, often: np.ndarray):
    """How often contexts one word longer than hot ones occur; only those with a frequent word can be hot themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, _, number, _, sizes, _ in _texts(batches, 0):
            at, chain, start = _followed(number, sizes, depth, open_)
            some = _among(chain, hot[0])[0] & (at - depth - 1 >= start[at])
            chain, word = chain[some], number[at[some] - depth - 1].astype(np.uint64)
            some = _among(word, often)[0]
            found.append(np.unique(mix(chain[some], word[some]), return_counts=True))
        longer, times = _summed(*_joined(found), keys=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(longer.view(np.int64)), pa.array(times)], ["key", "x"])

    return run


def _place(depth: int, last: int, open_, hot: tuple, longer: np.ndarray, buckets: int, n_ends: int):
    """All places that follow an open context, with the words before it, dealt by context.

    A word ends what is sent where no context with it can be retained or extended. Of places whose next longer context is
    hot only the numbers go, for they are met again once that context is judged.
    """
    some = MIN_TIMES * np.exp(COST / MIN_TIMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            chain, token, count, row, *words = _joined(parts)
            parts.clear()
            word = words[0] if words else np.zeros(len(chain), np.int64)
            order = np.lexsort((token, chain)) if depth else _order(word, token)
            yield from _dealt(_PLACES, _shares(chain, word, hot, buckets), order, chain, token, count, row, *words)

        for block, _, number, count, sizes, learned in _texts(batches, n_ends):
            at, chain, start = _followed(number, sizes, depth, open_)
            words, alive = [], np.ones(len(at), bool)
            for k in range(depth + 1, last + 1):
                alive &= at - k >= start[at]
                before = np.maximum(at - k, 0)
                words.append(np.where(alive & (count[before] >= MIN_TIMES), number[before], 0))
                alive &= count[before] > some
            if depth == 0:
                met = words[0] > 0
                at, chain, words = at[met], chain[met], [w[met] for w in words]
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            row = (((block << 12) + doc) << 1) | learned[doc]
            if words and len(longer):
                again = _among(mix(chain, words[0].astype(np.uint64)), longer)[0] & (words[0] > 0)
                h, w, t, c, yes = chain[again], words[0][again], number[at[again]], count[at[again]], learned[doc[again]]
                key, one, of = np.unique(_pair(mix(h, w.astype(np.uint64)), t.astype(np.uint64)), return_index=True, return_inverse=True)
                n, times = np.bincount(of, yes, len(key)).astype(np.int64), np.bincount(of, minlength=len(key))
                h, w, t, c = h[one], w[one], t[one], c[one]
                yield from _dealt(_SAME, _shares(h, w, hot, buckets), np.arange(len(h)), h, t, c, n, times, w)
                at, chain, row, words = at[~again], chain[~again], row[~again], [x[~again] for x in words]
            if sum(len(p[0]) for p in parts) + len(at) > GATHER:
                yield from hand_on()
            parts.append([chain, number[at], count[at], row, *words])
        yield from hand_on()

    return run


def _descend(depth: int, chain, token, count, n, times, words: list, known: tuple | None, n_train: int, hand_over) -> tuple:
    """Judges the longer contexts of each place, length by length, and passes those that go on to ``hand_over``.

    Gives the places that are through, and for each place the count of its token in the longest retained context, that
    context's occurrences and number of next tokens (0: none). ``known``: for open contexts with each next token the key of
    both, the token's count after it, its occurrences, and the state so far; None for the empty context.
    """
    if known is None:
        group, chain = np.zeros(len(token), np.int64), chain[:1]
        before, total = count.astype(np.int64), np.full(len(token), n_train)
        state = np.zeros((3, len(token)), np.int64)
        through = np.ones(len(token), bool)
    else:
        through, at = _among(_pair(chain, token.astype(np.uint64)), known[0])
        before, total, *state = (c[at] if len(c) else np.zeros(len(at), np.int64) for c in known[1:])
        state = np.stack(state)
        chain, group = np.unique(chain, return_inverse=True)
    live = np.flatnonzero(through)
    group = group[live]
    for k, word in enumerate(words):
        has = word[live] > 0
        live, group = live[has], group[has]
        if not len(live):
            break
        order = _order(group, word[live])
        live, group = live[order], group[order]
        new = _changes(group, word[live])
        chain = mix(chain[group[new]], word[live[new]].astype(np.uint64))
        group = np.cumsum(new) - 1
        live = live[_order(group, token[live])]
        pair = np.flatnonzero(_changes(group, token[live]))
        one, of = live[pair], group[pair]
        seen = np.add.reduceat(n[live], pair)
        edges = np.flatnonzero(_changes(of))
        sums = np.add.reduceat(seen, edges)
        kinds = np.add.reduceat((seen > 0).astype(np.int64), edges)
        some = seen > 0
        gain = np.zeros(len(seen))
        gain[some] = seen[some] * (np.log(seen[some] / sums[of[some]]) - np.log(before[one[some]] / total[one[some]]))
        kept = (sums >= MIN_TIMES) & (np.add.reduceat(gain, edges) > COST * kinds)
        going = _extendable(sums, kinds, np.maximum.reduceat(seen, edges))
        which = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(live))))
        retained = kept[group]
        state[:, live[retained]] = seen[which[retained]], sums[group[retained]], kinds[group[retained]]
        before[live], total[live] = seen[which], sums[group]
        if hand_over is not None and k == len(words) - 1:
            on = hand_over(depth + k + 1, chain, going, np.bincount(group, times[live]).astype(np.int64), of, token[one], seen, sums[of], *state[:, one])
            through[live[on[group]]] = False
        live, group = live[going[group]], group[going[group]]
    return through, state


def _judge(depth: int, last: int, buckets: int, share: int, hot_times: int, n_train: int, n_distinct: int, word_buckets: int):
    """What contexts add to the score of each text, packed and dealt by its block, and the open contexts with all that is known of them; sorted by bucket."""

    def opened(all_go: bool, out: list):
        def hand_over(length, chain, going, times, of, token, *columns):
            on = np.ones(len(going), bool) if all_go else going
            out.append(_made(_EXTENDED, int(on.sum()), depth=np.full(on.sum(), length, np.int32), key=chain[on].view(np.int64), x=times[on]))
            hot = on & (times > hot_times)
            plain = (on & ~hot)[of]
            key = chain[of].view(np.int64)
            columns = key, token, *columns
            for batch in _dealt(_CONTEXT, (chain[of] % np.uint64(buckets)).astype(np.int64)[plain], np.arange(plain.sum()), *(c[plain] for c in columns)):
                out.append(batch.set_column(4, "depth", pa.array(np.full(batch.num_rows, length, np.int32))).set_column(6, "x", pa.array(np.ones(batch.num_rows, np.int64))))
            for g in np.flatnonzero(hot).tolist():
                mine = slice(*np.searchsorted(of, [g, g + 1]).tolist())
                copies = min(buckets, 1 + int(times[g]) // share)
                out.append(_made(_CONTEXT, 1, bucket=[int(chain[g] % np.uint64(buckets))], part=[_packed(*(c[mine] for c in columns))], depth=[length], x=[copies]))
            return on

        return hand_over

    def of_bucket(parts: dict, out: list) -> tuple | None:
        known = None
        if depth:
            if not parts[_CONTEXT]:
                return None
            key, token, *columns = _joined(parts.pop(_CONTEXT))
            pairs = _pair(key.astype(np.uint64), token.astype(np.uint64))
            order = np.argsort(pairs)
            known = pairs[order], *(c[order].astype(np.int64) for c in columns)
        if parts[_SAME]:
            chain, token, count, n, times, word = _joined(parts.pop(_SAME))
            _descend(depth, chain.astype(np.uint64), token, count, n.astype(np.int64), times, [word], known, n_train, opened(True, out))
        if not parts[_PLACES]:
            return None
        chain, token, count, row, *words = _joined(parts.pop(_PLACES))
        through, state = _descend(depth, chain.astype(np.uint64), token, count, row & 1, np.ones(len(row), np.int8), words, known, n_train, None if last == LONGEST else opened(False, out))
        better = through & (state[1] > 0)
        seen, sums, kinds = state[:, better]
        base = (count[better].astype(np.int64) + 1) / (n_train + n_distinct + 1)
        return _summed(row[better] >> 1, np.log10((seen + kinds * base) / (sums + kinds)) - np.log10(base), keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: {_CONTEXT: [], _SAME: [], _PLACES: []}
        bucket, parts, scores, held = None, empty(), [], 0

        def closed(at_end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            out: list = []
            if (found := of_bucket(parts, out)) is not None:
                scores.append(found)
                held += len(found[0])
            parts = empty()
            yield from out
            if scores and (at_end or held > GATHER):
                yield from _scores(*_summed(*_joined(scores), keys=True), word_buckets)
                scores.clear()
                held = 0

        for batch in batches:
            kinds, of = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            for i in range(batch.num_rows):
                if of[i] != bucket and bucket is not None:
                    yield from closed(False)
                bucket = of[i]
                parts[int(kinds[i])].append(_unpacked(batch.column("part")[i].as_py()))
        yield from closed(True)

    return run


def _scores(row: np.ndarray, y: np.ndarray, word_buckets: int) -> Iterator[pa.RecordBatch]:
    """What is added to the scores of texts, a packed row for each share of the blocks."""
    block = (row >> 12).astype(np.uint64)
    of = (mix(np.full(len(row), _SEED), block) % np.uint64(word_buckets)).astype(np.int64)
    yield from _dealt(_SCORES, of, np.arange(len(row)), row, y.view(np.int64))


def _packed_scores(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    row, y = (c.astype(np.int64, copy=False) for c in _unpacked(batch.column("part")[i].as_py()))
    return row, y.view(np.float64)


def _gathered(word_buckets: int):
    """Packed scores of many tasks as those of one, before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, most = [], 0, GATHER
        for batch in batches:
            for i in range(batch.num_rows):
                parts.append(_packed_scores(batch, i))
                held += len(parts[-1][0])
                if held > most:
                    parts = [_summed(*_joined(parts), keys=True)]
                    held = len(parts[0][0])
                    if held > GATHER:
                        yield from _scores(*parts[0], word_buckets)
                        parts, held = [], 0
                    most = held + GATHER
        if parts:
            yield from _scores(*_summed(*_joined(parts), keys=True), word_buckets)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all contexts add to the score of each text, from packed shares sorted by bucket."""
    bucket, parts, held, most = None, [], 0, GATHER

    def summed() -> pa.RecordBatch:
        row, y = _summed(*_joined(parts), keys=True)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(y)], ["row", "added"])

    for batch in batches:
        for i in range(batch.num_rows):
            of = batch.column("bucket")[i].as_py()
            if of != bucket and parts:
                yield summed()
                parts, held, most = [], 0, GATHER
            bucket = of
            parts.append(_packed_scores(batch, i))
            held += len(parts[-1][0])
            if held > most:
                parts = [_summed(*_joined(parts), keys=True)]
                held = len(parts[0][0])
                most = 2 * held + GATHER
    if parts:
        yield summed()


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score_texts(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    word_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = docs.mapInArrow(_encode(word_buckets), _RUN).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_number(word_buckets, HOT_TIMES), _RUN)
    coded = coded.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_resolve, _RUN)
    with _without_shuffles(spark):
        coded = stored(coded, "texts")
    sums = coded.where(F.col("kind") == _SUMS).agg(
        F.coalesce(F.sum(F.when(F.col("y").isNull(), F.col("x"))), F.lit(0)).alias("ends"),
        F.coalesce(F.sum(F.when(F.col("y").isNotNull(), F.col("x"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("distinct"),
    ).first()
    ends = sums.ends
    n_train, n_distinct = sums.n + ends, sums.distinct + (ends > 0)
    often = coded.where(F.col("kind") == _FREQUENT).select("key").toArrow().column("key").to_numpy()
    often = np.sort(often.view(np.uint64))
    longer = np.sort(mix(np.full(len(often), _SEED), often))
    texts = coded.where(F.col("kind") == _TEXTS).select("block", "part", "doc_ids")
    buckets = 1 + n_train // BUCKET
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs: list[DataFrame] = []
    for depth in range(LONGEST + 1):
        hot, open_, known = (np.array([_SEED]), np.array([buckets])), None, None
        if depth:
            found = [r.where(F.col("depth") == depth) for r in runs]
            if not found:
                break
            found = reduce(DataFrame.union, found)
            opened = found.where(F.col("kind") == _EXTENDED).select(F.col("key").alias("context"), "x")
            bits = _bits(opened.select("context"))
            if not bits.any():
                continue
            open_ = spark.sparkContext.broadcast(bits)
            rows = opened.where(F.col("x") > HOT_TIMES).toArrow()
            keys, times = rows.column("context").to_numpy().view(np.uint64), rows.column("x").to_numpy()
            order = np.argsort(keys)
            hot = keys[order], np.minimum(buckets, 1 + times[order] // BUCKET)
            longer = none[0]
            if len(keys) and depth < LONGEST:
                rows = texts.mapInArrow(_extensions(depth, open_, hot, often), "key long, x long").groupBy("key").agg(F.sum("x").alias("x")).where(F.col("x") > HOT_TIMES)
                longer = np.sort(rows.toArrow().column("key").to_numpy().view(np.uint64))
            copies = F.explode(F.sequence(F.lit(0), F.col("x") - 1))
            known = found.where(F.col("kind") == _CONTEXT).select("kind", "bucket", "part", copies.alias("copy"))
            known = known.select("kind", ((F.col("bucket") + F.col("copy")) % buckets).alias("bucket"), "part")
        last = min(k for k in CUTS if k > depth or k == LONGEST)
        places = texts.mapInArrow(_place(depth, last, open_, hot, longer, buckets, ends), _RUN).select("kind", "bucket", "part")
        met = (places if known is None else places.union(known)).repartition("bucket").sortWithinPartitions("bucket")
        judged = met.mapInArrow(_judge(depth, last, buckets, BUCKET, HOT_TIMES, n_train, n_distinct, word_buckets), _RUN)
        with _without_shuffles(spark):
            runs.append(stored(judged.select("kind", "bucket", "part", "depth", "key", "x", "y"), "contexts"))
    added = reduce(DataFrame.union, runs).where(F.col("kind") == _SCORES).select("bucket", "part")
    added = added.mapInArrow(_gathered(word_buckets), _RUN).select("bucket", "part").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added, "row long, added double")
    base = texts.mapInArrow(_base(n_train, n_distinct, ends), _BASE)
    null = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in _BASE.split(", ")}
    rows = base.withColumn("added", F.lit(None).cast("double")).unionByName(added.select("row", *(c.alias(n) for n, c in null.items() if n != "row"), "added"))
    of_text = rows.groupBy("row").agg(*(F.max(n).alias(n) for n in null if n != "row"), F.sum("added").alias("added"))
    return of_text.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.coalesce("added", F.lit(0.0))).alias("score")
    )
