"""Substring deduplication with suffix automata of reference shards (operator 10).

A word goes if it lies in a run of ``LENGTH`` words that also starts earlier: in a smaller id, or
earlier in the same document. All is judged on the input.

1. Anchors. Of the k-word runs in a window of ``LENGTH`` words, the one with the least hash is the
   window's anchor; equal windows have equal anchors, and neighbouring windows mostly share one. A
   task hands on one row per distinct anchor (and marks what it saw twice itself), so an anchor that a
   third of all documents contain is a few rows per task. Anchors met once are dropped: no window
   around them can repeat.
2. Reference shards. The words around the remaining anchors go, by anchor, to shards. Equal word runs
   of one task cross once; the later ones are repeats for certain. Anchors with more than ``HOT_SHARE`` of
   all rows - at most 1 / HOT_SHARE of them, a set of bounded size that is broadcast - are split further:
   their windows go one by one, by the hash of all their words.
3. Each shard, of bounded size, becomes a suffix automaton over words whose states know their earliest
   occurrence. The shard's runs are streamed through it for matching statistics: wherever the match is
   ``LENGTH`` words long and the state's earliest occurrence is before the own one, the window repeats.
   An anchor that is not hot, but whose runs alone hold more than ``MOST_WORDS``, makes no shard: its windows are handed on
   one by one and dealt anew by all their words, of which the earliest stays. So a shard has ``SHARD_WORDS`` +
   ``MOST_WORDS`` words at most, however large the corpus.
4. The repeated windows return to their documents, which are kept in a table bucketed by row, so texts
   are dealt out once for both steps.

The shards are not sent to every document: with the whole corpus as reference that would cost the square
of its size. A shard meets the runs that share an anchor with it, which loses none.

Defined results: null, empty and blank texts have no words, the digest of the empty string and nothing
removed. Rows without id come after all others; rows that repeat an id are documents of their own, in
a fixed but arbitrary order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpida.llm.tables import stored
from limpida.llm.words import chunks, run_hashes, split_words, word_hashes
from limpida.session import scratch_dir

LENGTH = 20
ANCHOR = 6
SPAN = LENGTH - ANCHOR + 1
HOT_SHARE = 1e-5
#: An anchor is never hot below so many occurrences.
HOT_LEAST = 1000
#: Anchors, or run words, that a task gathers before it works them off.
GATHER = 2_000_000
SHARD_WORDS = 40_000
#: Words of one anchor's runs above which no automaton is built over them.
MOST_WORDS = 200_000
_LAST = (1 << 63) - 1


def window_anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: text, first window (by its start in the text), number of windows, anchor hash.

    A row stands for neighbouring windows with the same anchor; ties go to the first run.
    """
    empty = np.zeros(0, np.int64)
    if len(h) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64)
    runs = run_hashes(h, ANCHOR)
    least = runs[: len(h) - LENGTH + 1].copy()
    place = np.zeros(len(least), np.int8)
    for j in range(1, SPAN):
        other = runs[j : j + len(least)]
        less = other < least
        np.copyto(least, other, where=less)
        place[less] = j
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(least))
    inside = start + LENGTH <= first[1:][doc[: len(least)]]
    start = start[inside]
    at = start + place[inside]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    row = start[begin]
    return doc[row], row - first[doc[row]], count, runs[at[begin]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct anchor of a task's documents, and further rows for the others it stands for."""
    held: list[tuple] = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        row, window, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(anchor, kind="stable")
        row, window, anchor = row[order], window[order], anchor[order]
        new = np.append(True, anchor[1:] != anchor[:-1])
        at = np.flatnonzero(new)
        times = np.zeros(len(anchor), np.int64)
        times[at] = np.diff(np.append(at, len(anchor)))
        # Further rows are dealt out by a key of their own.
        key = np.where(new, anchor, anchor * np.uint64(31) + np.arange(len(anchor), dtype=np.uint64))
        for lo in range(0, len(anchor), 200_000):
            s = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[s].view(np.int64)), pa.array(anchor[s].view(np.int64)), pa.array(row[s]), pa.array(window[s]), pa.array(times[s])],
                ["key", "anchor", "row", "windows", "times"],
            )

    total = 0
    for batch in chunks(batches, "text"):
        words = split_words(batch.column("text"))
        doc, start, count, anchor = window_anchors(word_hashes(words), words.first)
        held.append((batch.column("row").to_numpy()[doc], start << 8 | count, anchor))
        total += len(anchor)
        if total >= GATHER:
            yield from hand_on()
            total = 0
    yield from hand_on()


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """Anchors that occur twice or more: anchor, row, windows (start << 8 | number), times."""
    found = docs.select("row", "text").mapInArrow(_anchors, "key long, anchor long, row long, windows long, times long")
    # One row per task and distinct anchor: a group has at most as many rows as there are tasks.
    total = F.expr("sum(times) OVER (PARTITION BY key)")
    known = found.withColumn("total", total).where("times = 0 OR total > 1")
    return stored(known.select("anchor", "row", "windows", F.when(F.col("times") > 0, F.col("total")).otherwise(0).alias("times")), "anchors")


_RUNS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("number", pa.int32()), ("run", pa.binary())])
RUNS = "key long, doc long, row long, start int, number int, run binary"


def _runs(hot: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        out: list[tuple] = []

        def known(text: bytes) -> tuple[bool, bytes]:
            """Whether an equal run was there before, so that all its windows repeat."""
            digest = hashlib.blake2b(text, digest_size=12).digest()
            again = digest in seen
            seen.add(digest)
            return again, digest

        for whole in batches:
            for batch in chunks(iter([whole]), "text"):
                found = batch.column("found")
                bounds = np.append(0, np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))).tolist()
                items = found.flatten()
                windows, anchors = items.field("windows").to_numpy(), items.field("anchor").to_numpy()
                docs, rows, texts = (batch.column(c).to_pylist() for c in ("doc", "row", "text"))
                for t, text in enumerate(texts):
                    words = text.encode().split()  # bytes are split at the same six blanks
                    doc, row, part = docs[t], rows[t], slice(bounds[t], bounds[t + 1])
                    order = np.argsort(windows[part])
                    for window, anchor in zip(windows[part][order].tolist(), anchors[part][order].tolist(), strict=True):
                        start, number = window >> 8, window & 255
                        joined = b" ".join(words[start : start + number - 1 + LENGTH])
                        again, digest = known(joined)
                        if again:
                            out.append((int.from_bytes(digest[:7], "little") ^ row, doc, row, start, number, None))
                        elif anchor not in hot:
                            out.append((anchor, doc, row, start, number, joined))
                        else:
                            for at in range(start, start + number):
                                joined = b" ".join(words[at : at + LENGTH])
                                again, digest = known(joined) if number > 1 else (False, digest)
                                key = int.from_bytes(digest[:8], "little", signed=True)
                                out.append((key ^ row if again else key, doc, row, at, 1, None if again else joined))
                if len(out) > 20_000:
                    yield _batch(out)
                    out.clear()
                if len(seen) > GATHER:
                    seen.clear()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUNS, strict=True)], schema=_RUNS)


class SuffixAutomaton:
    """Suffix automaton of word sequences; ``first`` is the earliest (document, row, end) of a state's strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[tuple] = [(_LAST, _LAST, 0)]

    def _new(self, to: dict, link: int, length: int, first: tuple) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: bytes) -> int:
        copy = self._new(self.next[q].copy(), self.link[q], self.length[p] + 1, (_LAST, _LAST, 0))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], doc: int, row: int, start: int) -> None:
        last = 0
        for end, word in enumerate(words, start + 1):
            here = (doc, row, end)
            to = self.next[last].get(word)
            if to is not None:
                if self.length[to] != self.length[last] + 1:
                    to = self._clone(last, to, word)
                last = to
            else:
                state = self._new({}, 0, self.length[last] + 1, here)
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = state
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
                last = state
            if here < self.first[last]:
                self.first[last] = here

    def finish(self) -> None:
        """Earliest occurrences go from longer strings to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.first[state] < self.first[up]:
                self.first[up] = self.first[state]

    def repeats(self, words: list[bytes], doc: int, row: int, start: int) -> list[int]:
        """Starts of the windows of ``words`` whose earliest occurrence is before this one."""
        state, size, out = 0, 0, []
        for end, word in enumerate(words, start + 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size >= LENGTH:
                while self.length[self.link[state]] >= LENGTH:
                    state = self.link[state]
                    size = self.length[state]
                if self.first[state] < (doc, row, end):
                    out.append(end - LENGTH)
        return out


SEARCHED = "row long, windows long, doc long, text binary"
_SEARCHED = pa.schema([("row", pa.int64()), ("windows", pa.int64()), ("doc", pa.int64()), ("text", pa.binary())])


def _decide(shard: list[tuple], rows: list[int], windows: list[int]) -> None:
    """The repeated windows of a shard's runs, told by its automaton.

    Runs without a window whose hash comes twice in the shard stay out: different hashes are different words.
    """
    words = split_words(pa.array([r[5] for r in shard], pa.large_binary()).cast(pa.large_string()))
    hashes = run_hashes(word_hashes(words), LENGTH)
    run = words.doc()[: len(hashes)]
    inside = np.arange(len(hashes)) + LENGTH <= words.first[1:][run]
    _, at, times = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    met = np.unique(run[inside][times[at] > 1]).tolist()
    automaton = SuffixAutomaton()
    split = [(r[5].split(b" "), r[1], r[2], r[3]) for r in map(shard.__getitem__, met)]
    for item in split:
        automaton.add(*item)
    automaton.finish()
    for words, doc, row, start in split:
        begun = before = -2
        for at in automaton.repeats(words, doc, row, start):
            if at != before + 1:
                if begun >= 0:
                    rows.append(row)
                    windows.append(begun << 8 | before - begun + 1)
                begun = at
            before = at
        if begun >= 0:
            rows.append(row)
            windows.append(begun << 8 | before - begun + 1)


def _single(record: tuple) -> Iterator[tuple]:
    """The windows of a run, one by one: row, window, document, words."""
    words = record[5].split(b" ")
    for at in range(record[4]):
        yield record[2], (record[3] + at) << 8 | 1, record[1], b" ".join(words[at : at + LENGTH])


def _search(shard_words: int, most_words: int):
    """Rows sorted by key to repeated windows (row, start << 8 | number), and to windows of anchors too large for
    a shard, still undecided, with their document and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs of earlier keys and those of the present key; the words they hold.
        shard, own = [], []
        held = mine = 0
        last, too_many = None, False
        rows: list[int] = []
        windows: list[int] = []
        undecided: list[tuple] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if rows:
                none = [pa.nulls(len(rows), f.type) for f in (_SEARCHED.field("doc"), _SEARCHED.field("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(windows, pa.int64()), *none], schema=_SEARCHED)
            if undecided:
                columns = zip(zip(*undecided, strict=True), _SEARCHED, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=_SEARCHED)
            rows.clear()
            windows.clear()
            undecided.clear()

        for batch in batches:
            for record in zip(*(batch.column(f.name).to_pylist() for f in _RUNS), strict=True):
                if record[5] is None:
                    rows.append(record[2])
                    windows.append(record[3] << 8 | record[4])
                    continue
                if record[0] != last:
                    shard += own
                    held += mine
                    own, mine, last, too_many = [], 0, record[0], False
                    if held >= shard_words:
                        _decide(shard, rows, windows)
                        shard, held = [], 0
                if too_many:
                    undecided += _single(record)
                else:
                    own.append(record)
                    mine += LENGTH + record[4] - 1
                    if mine > most_words:
                        for one in own:
                            undecided += _single(one)
                        own, mine, too_many = [], 0, True
                if len(rows) + len(undecided) > 50_000:
                    yield from hand_on()
            if len(rows) + len(undecided) > 50_000:
                yield from hand_on()
        if shard or own:
            _decide(shard + own, rows, windows)
        yield from hand_on()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(iter([whole]), "text"):
            words = split_words(batch.column("text"))
            total, removed, digests, kept_text = [], [], [], []
            for t, windows in enumerate(batch.column("gone").to_pylist()):
                base, end = int(words.first[t]), int(words.first[t + 1])
                marks = np.zeros(end - base + 1, np.int32)
                for window in windows or ():
                    marks[window >> 8] += 1
                    marks[(window >> 8) + (window & 255) - 1 + LENGTH] -= 1
                stays = base + np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                kept = b" ".join([words.data[a:b].tobytes() for a, b in zip(words.starts[stays].tolist(), words.ends[stays].tolist(), strict=True)])
                total.append(end - base)
                removed.append(end - base - len(stays))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_text)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def remove_repeats(docs: DataFrame, fixed_order: bool = False) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one blank).

    ``fixed_order``: ``docs`` is a plain scan of files, whose rows get the same numbers each time they are
    read; other tables are written once first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    docs = docs if fixed_order else stored(docs, "documents")
    anchors = repeated_anchors(docs)
    size = anchors.agg(F.sum("times")).first()[0] or 0
    hot = anchors.where((F.col("times") > 0) & (F.col("times") >= max(HOT_LEAST, HOT_SHARE * size))).select("anchor").distinct()
    hot = frozenset(r.anchor for r in hot.collect())
    found = anchors.groupBy("row").agg(F.collect_list(F.struct("anchor", "windows")).alias("found"))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeats_{uuid.uuid4().hex}"
    (
        docs.join(found, "row", "left").repartition(buckets, "row")
        .write.bucketBy(buckets, "row").option("path", scratch_dir(spark, name)).saveAsTable(name)
    )
    texts = spark.table(name)
    runs = (
        texts.where("found IS NOT NULL")
        .select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row", "text", "found")
        .sortWithinPartitions("doc", "row")  # of equal runs in a task, the first is the earliest
        .mapInArrow(_runs(hot), RUNS)
    )
    met = runs.repartition("key").sortWithinPartitions("key")
    searched = stored(met.mapInArrow(_search(SHARD_WORDS, MOST_WORDS), SEARCHED), "repeats")
    # Windows of an anchor too large for a shard: all but the earliest of equal words repeat.
    place = F.row_number().over(Window.partitionBy("text").orderBy("doc", "row", "windows"))
    later = searched.where("text IS NOT NULL").withColumn("place", place).where("place > 1")
    gone = searched.where("text IS NULL").select("row", "windows").union(later.select("row", "windows"))
    gone = gone.groupBy("row").agg(F.collect_list("windows").alias("gone"))
    joined = texts.select("row", "doc_id", "text").join(gone, "row", "left").select("doc_id", "text", "gone")
    # The plans above hold the table's files and buckets; the catalogue keeps no entry of it.
    spark.sql(f"DROP TABLE {name}")
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
