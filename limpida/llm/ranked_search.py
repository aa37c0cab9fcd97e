"""Ranked lexical search of many queries at once by shared accumulators (operator 13).

All items of a block are evaluated together. Terms that occur in exactly the same items are one atom, as they always
count together. Items are lists of atoms, the commonest first; neighbouring nodes that several items have in common
are merged into a new node, pass by pass, until no pair repeats. That gives a query-sharing DAG: leaves are atoms, an
inner node is the sum of two others, an item the sum of the few nodes that are left of it. For each document the partial
score of a node is made once, however many items need it.

1. Items are dealt into blocks of about ``BLOCK_TERMS`` (item, term) pairs; a block's vocabulary and DAG are all that
   is sent out, bounded whatever the number of items. Documents stream past each block.
2. One pass counts documents, terms and the documents that hold each term of the block: a row per term and task.
3. One pass scores. A task holds the best ``TOP`` documents of each item and hands on no others; these meet in two
   rounds, first by item and a part of the tasks, then by item, so that no task receives the rows of all tasks.

Defined results: terms, weights and scores in 64-bit integers as in ``weights`` and ``_score``; only A-Z are lower-cased.
Null and empty texts have no terms, count as no document and are never found; items without known terms have no
rows. Whole texts are read, however long. Ties are ranked by doc_id, rows without it last. Rows that repeat a doc_id are
documents of their own; items that repeat id and terms are one, others with the same id have ranks of their own.
Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpida.llm.words import Words, chunks, utf8, word_hashes

TOP = 50
#: (item, term) pairs that are evaluated together.
BLOCK_TERMS = 100_000
#: Sums of nodes and documents that a task holds at once.
CELLS = 2_000_000
#: Candidates that a task gathers before it sorts out the best.
GATHER = 300_000
#: Parts of the tasks whose candidates meet first.
PARTS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_terms(texts: pa.Array) -> Words:
    """Terms of whole texts: letters and digits, and all beyond ASCII; on bytes, as UTF-8 has no others there."""
    data, offsets = utf8(texts)
    n = int(offsets[-1])
    body = data[:n]
    body += ((body - np.uint8(65)) < 26).view(np.uint8) << 5
    solid = (body >= 128) | ((body - np.uint8(48)) < 10) | ((body - np.uint8(97)) < 26)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.append(False, solid)[:n] & ~edge[:n]
    after = np.append(solid, False)[1:] & ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    return Words(data, starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets))


def _heads(words: Words) -> np.ndarray:
    """The first eight bytes of each term."""
    at = np.ndarray((len(words.data) - 8,), "<u8", buffer=words.data, strides=(1,))
    size = np.minimum(words.ends - words.starts, 8).astype(np.uint64)
    return at[words.starts] & (~np.uint64(0) >> ((np.uint64(8) - size) * np.uint64(8)))


@dataclass
class Vocabulary:
    """Terms in order of their hashes; ``number``: the place of each in the order of atoms."""

    hashes: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        words = split_terms(pa.array(terms, pa.string()))
        hashes = word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) != len(terms):
            raise ValueError("two terms of a block have one hash")
        return cls(hashes[order], _heads(words)[order], (words.ends - words.starts)[order], order)

    def held(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that are in the vocabulary, and their numbers."""
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == hashes)
        at = at[place]
        few = Words(words.data, words.starts[place], words.ends[place], words.first)
        same = (self.sizes[at] == few.ends - few.starts) & (self.heads[at] == _heads(few))
        return place[same], self.number[at[same]]


@dataclass
class Sharing:
    """The DAG of a block: terms in order of atoms, ``atom`` of each, inner nodes by level, nodes of each item."""

    terms: list[str]
    atom: np.ndarray
    n_atoms: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    n_nodes: int
    nodes: np.ndarray
    bounds: np.ndarray


def share(items: list[list[str]]) -> Sharing:
    """Mine the term sets that items (lists of distinct terms, none empty) have in common."""
    of = defaultdict(list)
    for number, terms in enumerate(items):
        for term in terms:
            of[term].append(number)
    atoms = defaultdict(list)
    for term in sorted(of):
        atoms[tuple(of[term])].append(term)
    groups = sorted(atoms, key=lambda who: (-len(who), who))
    terms, atom, lists = [], [], [[] for _ in items]
    for number, who in enumerate(groups):
        terms += atoms[who]
        atom += [number] * len(atoms[who])
        for item in who:
            lists[item].append(number)
    level = [0] * len(groups)
    made: dict[tuple[int, int], int] = {}
    while True:
        pairs = Counter(p for nodes in lists for p in zip(nodes, nodes[1:], strict=False))
        if not pairs or max(pairs.values()) < 2:
            break
        for number, nodes in enumerate(lists):
            out, k = [], 0
            while k < len(nodes):
                pair = tuple(nodes[k : k + 2])
                best = pairs.get(pair, 0) if len(pair) == 2 else 0
                if best >= 2 and best >= pairs.get(tuple(nodes[k + 1 : k + 3]), 0):
                    if pair not in made:
                        made[pair] = len(groups) + len(made)
                        level.append(max(level[pair[0]], level[pair[1]]) + 1)
                    out.append(made[pair])
                    k += 2
                else:
                    out.append(nodes[k])
                    k += 1
            lists[number] = out
    by_level = defaultdict(list)
    for (a, b), node in made.items():
        by_level[level[node]].append((node, a, b))
    levels = [tuple(np.array(by_level[k], np.int64).T) for k in sorted(by_level)]
    sizes = [len(nodes) for nodes in lists]
    flat = np.array([n for nodes in lists for n in nodes], np.int64)
    return Sharing(terms, np.array(atom, np.int64), len(groups), levels, len(groups) + len(made), flat, np.append(0, np.cumsum(sizes))[:-1])


def _counter(vocabulary):
    """Documents, all their terms, and the documents of each term of the block: rows of term, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        size = len(known.hashes)
        n = np.zeros(size + 2, np.int64)
        for batch in chunks(batches, "text"):
            words = split_terms(batch.column("text"))
            place, term = known.held(words)
            pairs = np.unique(words.doc()[place] * size + term)
            n[:size] += np.bincount(pairs % size, minlength=size)
            n[size] += np.count_nonzero(np.diff(words.first))
            n[size + 1] += len(words.starts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    return run


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)


def _score(weight: np.ndarray, times: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """The part of a score that a term makes in a document of ``length`` terms."""
    m = 100 - 50 + (50 * length * documents) // all_terms
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * m))


class Best:
    """The best documents of each item, as they come."""

    def __init__(self, n_items: int) -> None:
        self.least = np.ones(n_items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """``scores``: a row per item, a column per document."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((item, scores[item, doc], no_id[doc], ids[doc]))
        self.held += len(item)
        if self.held > GATHER:
            self.sort_out()

    def sort_out(self) -> tuple[np.ndarray, ...]:
        """Drop all but the best of each item: item, score, whether the id is null, id."""
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, no_id, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, no_id, -score, item))
        sorted_items = item[order]
        rank = np.arange(len(item)) - np.searchsorted(sorted_items, sorted_items)
        last = order[rank == TOP - 1]
        self.least[item[last]] = score[last]
        order = order[rank < TOP]
        kept = item[order], score[order], no_id[order], ids[order]
        self.parts, self.held = [kept], len(order)
        return kept


def _scorer(vocabulary, sharing, weight, documents: int, all_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dag, w = vocabulary.value, sharing.value, weight.value
        size, step = len(known.hashes), max(1, CELLS // (dag.n_nodes + len(dag.bounds)))
        best = Best(len(dag.bounds))
        for batch in chunks(batches, "text"):
            words = split_terms(batch.column("text"))
            length = np.diff(words.first)
            place, term = known.held(words)
            pairs, times = np.unique(words.doc()[place] * size + term, return_counts=True)
            doc, term = np.divmod(pairs, size)
            part = _score(w[term], times, length[doc], documents, all_terms)
            cell = doc * dag.n_atoms + dag.atom[term]
            opens = np.flatnonzero(np.diff(cell, prepend=-1))
            sums = np.add.reduceat(part, opens) if len(part) else part
            doc, atom = np.divmod(cell[opens], dag.n_atoms)
            ids = batch.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                a, b = np.searchsorted(doc, (lo, hi))
                cells = np.zeros((dag.n_nodes, hi - lo), np.int64)
                cells[atom[a:b], doc[a:b] - lo] = sums[a:b]
                for node, left, right in dag.levels:
                    cells[node] = cells[left] + cells[right]
                best.add(np.add.reduceat(cells[dag.nodes], dag.bounds, axis=0), ids[lo:hi], no_id[lo:hi])
        item, score, no_id, ids = best.sort_out()
        columns = [pa.array(item), pa.array(score), pa.array(ids, mask=no_id)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "doc_id"])

    return run


def _search_block(docs: DataFrame, rows: list) -> DataFrame:
    """item, score, doc_id, rank of a block of items (rows of item_id and terms)."""
    context = docs.sparkSession.sparkContext
    sharing = share([r.terms for r in rows])
    known = Vocabulary.of(sharing.terms)
    vocabulary = context.broadcast(known)
    counted = docs.select("text").mapInArrow(_counter(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(counted.collect())
    size = len(sharing.terms)
    documents, all_terms = found.get(size, 0), found.get(size + 1, 0)
    weight = weights(documents, np.array([found.get(t, 0) for t in range(size)]))
    scorer = _scorer(vocabulary, context.broadcast(sharing), context.broadcast(weight), documents, max(all_terms, 1))
    scored = docs.select("doc_id", "text").mapInArrow(scorer, "item long, score long, doc_id long")
    scored = scored.withColumn("part", F.spark_partition_id() % PARTS)
    for keys in (["item", "part"], ["item"]):
        place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        scored = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOP)
    return scored


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of item_id, rank, doc_id, score: the best ``TOP`` documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))))
    items = items.select("item_id", terms.alias("terms")).where(F.size("terms") > 0).distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()
        if not rows:
            continue
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = _search_block(docs, rows).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        none = items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        return none.where("false")
    return out
