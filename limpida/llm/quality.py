"""Quality classifier from a weak-label model (operator 7).

Overlapping heuristics each object to a text or let it pass. Expectation-maximisation over the
counts of vote patterns (at most 2^12 of them, aggregated over all rows) estimates how often
each labeller objects to texts of either class, and so a posterior for each pattern. The posteriors
label a bounded sample (``TRAIN_ROWS``), on which a linear scorer over hashed features is trained; the
scorer decides on every row. Equal rows (id and text) are one group of the sample, which counts as often as
its share of the rows says, so neither missing nor repeated ids can fill or empty the sample.

Defined results: no labeller objects to null and empty texts; they are scored by that and the intercept. Labels without an id or a toxic value are not used. Ties and repeated rows: each row is scored by
its text alone, so equal texts get equal scores. An empty table gives an empty result. Extra columns stay in ``keep_good`` and are ignored in ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpida.llm.tables import stored
from limpida.llm.words import Words, chunks, mix, shingles, split_words, word_hashes

#: About so many rows train the scorer.
TRAIN_ROWS = 16_000
#: The lexicon is learned from about so many labelled rows.
LABELLED_ROWS = 16_000
#: Share of the toxic rows that must have an entry (and rows at least), and how many times likelier
#: it must be among them. Near copies, told by their least shingle, count as one row.
LEXICON_SHARE, LEXICON_ROWS, LEXICON_ODDS = 0.02, 3, 50.0
#: How much more readily a labeller objects to bad texts, at least.
BETTER = 200.0
_BEGINNINGS = (4, 5, 6)
DIMENSIONS = 1 << 18
#: Rows of the sample that must have a word for it to count.
MIN_ROWS = 5
KEEP_FROM = 0.5
_WORD_WEIGHT = 0.3

# Insults in their base form, and marks that prose hardly has.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile "
    "dumb fool jerk bastard vermin filth coward cretin freak pig ugly hate kill"
).split()
NOISE_MARKS = b"#$%&*^~<>{}[]\\"
LABELLERS = ("noise_marks", "shouting", "exclaiming", "stutter", "table", "few_words", "insult", "insults", "letters", "line_noise", "learned", "learned_twice")

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 other letters' bytes, 4 digit, 5 noise mark, 6 bar, 7 exclamation mark
_KIND[97:123], _KIND[65:91], _KIND[128:], _KIND[48:58] = 1, 2, 3, 4
_KIND[np.frombuffer(NOISE_MARKS, np.uint8)] = 5
_KIND[ord("|")], _KIND[ord("!")] = 6, 7
_EDGE = np.zeros(256, bool)
_EDGE[np.frombuffer(b".,;:!?\"'()|#$%&*", np.uint8)] = True


def _insult_hashes() -> np.ndarray:
    return np.sort(word_hashes(split_words(pa.array([" ".join(INSULTS)]))))


def _entries(words: Words, hashes: np.ndarray, pick: np.ndarray) -> list[np.ndarray]:
    """Lexicon entries of the picked words: the word, and its beginnings (0 where it has none)."""
    out = [hashes[pick]]
    starts, ends = words.starts[pick], words.ends[pick]
    for n in _BEGINNINGS:
        begun = mix(word_hashes(Words(words.data, starts, np.minimum(ends, starts + n), words.first)), np.uint64(n))
        out.append(np.where(ends - starts > n, begun, np.uint64(0)))
    return out


def _vote(value: np.ndarray, bad_from: float, judged: np.ndarray) -> np.ndarray:
    """1 objects, 0 lets pass; a text that cannot be judged passes."""
    return (value >= bad_from) & (judged > 0)


def _bare_words(raw: Words) -> Words:
    """Words in lower case without marks at their ends."""
    data = raw.data + (((raw.data - np.uint8(65)) < 26).view(np.uint8) << 5)
    starts, ends = raw.starts.copy(), raw.ends.copy()
    for _ in range(3):
        ends -= (ends > starts + 1) & _EDGE[data[ends - 1]]
        starts += (ends > starts + 1) & _EDGE[data[starts]]
    return Words(data, starts, ends, raw.first)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One word for each distinct (text, word), by text, and the bounds of each text's part."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return order[new], np.searchsorted(d[new], np.arange(n + 1))


def votes_and_features(texts: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (1 objects) per text and labeller; hashes of the distinct words of each text, and their bounds."""
    raw = split_words(texts)
    n_words = np.diff(raw.first)
    offsets = np.append(raw.starts, len(raw.data) - 16)[raw.first]
    kinds = _KIND[raw.data]

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag, dtype=np.int64))
        return total[offsets[1:]] - total[offsets[:-1]]

    per_word = np.maximum(1, n_words)
    kind = {k: per_text(kinds == k) for k in range(1, 8)}
    letters = kind[1] + kind[2]
    marked = np.maximum(1, letters + kind[3] + kind[4] + kind[5] + kind[6] + kind[7])

    bare = _bare_words(raw)
    hashes = word_hashes(bare)
    doc = raw.doc()
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(hashes) else np.zeros(0, bool)
    insulting = np.isin(hashes, _insult_hashes())

    def word_sum(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag, len(n_words)) if len(doc) else np.zeros(len(n_words))

    pick, bounds = _distinct(hashes, doc, len(n_words))
    distinct = np.diff(bounds)
    learned = np.zeros(len(pick), bool)
    if len(lexicon):
        for entry in _entries(bare, hashes, pick):
            learned |= np.isin(entry, lexicon)
    found = np.append(0, np.cumsum(learned))
    learned = found[bounds[1:]] - found[bounds[:-1]]

    hits = word_sum(insulting)
    votes = np.stack(
        [
            _vote(kind[5] / per_word, 0.3, n_words),
            _vote(kind[2] / np.maximum(1, letters), 0.3, n_words),
            _vote(kind[7] / per_word, 0.3, n_words),
            _vote(word_sum(same) / per_word, 0.15, n_words * (n_words > 15)),
            _vote(kind[6] / per_word, 0.12, n_words),
            _vote(1 - distinct / per_word, 0.8, n_words * (n_words > 30) * (n_words < 600)),
            hits > 0,
            (hits > 1) | (hits > 0.01 * per_word),
            _vote(1 - (letters + kind[3] + kind[4]) / marked, 0.1, n_words),
            _vote((kind[5] + kind[6] + kind[7]) / per_word, 0.3, n_words),
            learned > 0,
            learned > 1,
        ],
        axis=1,
    )
    return votes.astype(np.int64), hashes[pick], bounds


def patterns(votes: np.ndarray) -> np.ndarray:
    return votes @ (2 ** np.arange(len(LABELLERS)))


def _slots(votes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature slots of each text's words, and of its votes."""
    words = (mix(hashes, np.uint64(7)) % np.uint64(DIMENSIONS)).astype(np.int32)
    names = np.arange(len(LABELLERS), dtype=np.uint64) * np.uint64(2)
    flags = (mix(names[None, :] + votes.astype(np.uint64), np.uint64(11)) % np.uint64(DIMENSIONS)).astype(np.int32)
    return words, flags


def fit_labellers(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The posterior of "good" for each pattern, by expectation-maximisation.

    The start says: bad where any labeller objects. A labeller is held to object to a bad text at least
    ``BETTER`` times as readily as to a good one, so that no kind of bad text that few labellers see
    can be taken for good.
    """
    votes = pattern[:, None] // 2 ** np.arange(len(LABELLERS)) % 2
    good = np.where(votes.any(1), 0.1, 0.95)
    for _ in range(rounds):
        weight = np.stack([count * (1 - good), count * good])
        log = np.log((weight.sum(1) + 1) / (weight.sum() + 2))[:, None] + np.zeros((2, len(pattern)))
        for k in range(len(LABELLERS)):
            objects = [(np.sum(w * votes[:, k]) + 1) / (w.sum() + 2) for w in weight]
            objects[1] = min(objects[1], objects[0] / BETTER)
            for c, p in enumerate(objects):
                log[c] += np.where(votes[:, k] == 1, np.log(p), np.log1p(-p))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return good


@dataclass
class Scorer:
    weights: np.ndarray
    intercept: float
    lexicon: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        votes, hashes, bounds = votes_and_features(texts, self.lexicon)
        words, flags = _slots(votes, hashes, bounds)
        total = np.append(0.0, np.cumsum(self.weights[words]))
        z = self.intercept + _WORD_WEIGHT * (total[bounds[1:]] - total[bounds[:-1]]) + self.weights[flags].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _train(words: list[np.ndarray], flags: np.ndarray, label: np.ndarray, lexicon: np.ndarray, epochs: int = 6, batch: int = 64) -> Scorer:
    """Logistic regression with per-slot step sizes over soft labels."""
    seen = np.zeros(DIMENSIONS, np.int64)
    for w in words:
        seen[np.unique(w)] += 1
    usable = seen >= MIN_ROWS
    usable[flags] = True
    weights, squares, b, b2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2), 0.0, 1e-2
    random = np.random.default_rng(17)
    for _ in range(epochs):
        order = random.permutation(len(words))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            size = [len(words[r]) for r in rows]
            slot = np.concatenate([*(words[r] for r in rows), flags[rows].ravel()])
            row = np.concatenate([np.repeat(np.arange(len(rows)), size), np.repeat(np.arange(len(rows)), flags.shape[1])])
            value = np.where(np.arange(len(slot)) < sum(size), _WORD_WEIGHT, 1.0) * usable[slot]
            z = b + np.bincount(row, weights[slot] * value, len(rows))
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[rows]) / len(rows)
            touched, at = np.unique(slot, return_inverse=True)
            step = np.bincount(at, error[row] * value) + 1e-5 * weights[touched]
            squares[touched] += step**2
            weights[touched] -= 0.3 * step / np.sqrt(squares[touched])
            b2 += error.sum() ** 2
            b -= 0.3 * error.sum() / np.sqrt(b2)
    return Scorer(weights.astype(np.float32), b, lexicon)


def _drawn(part: float, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < int(min(1.0, part) * 1_000_000)


def training_rows(docs: DataFrame, n: float) -> DataFrame:
    """(text, times) of the sample: a group of c equal rows comes c * TRAIN_ROWS / n times, its fraction drawn by a hash."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    part = F.col("c") * min(1.0, TRAIN_ROWS / n)
    chance = F.pmod(F.xxhash64(F.col("row"), F.lit(7)), F.lit(1_000_000)) / 1e6
    groups = rows.groupBy("row").agg(F.count("*").alias("c"))
    groups = groups.select("row", (F.floor(part) + (chance < part - F.floor(part)).cast("long")).alias("times")).where("times > 0")
    groups = stored(groups, "sample")
    held = groups.count()
    if held > 2 * TRAIN_ROWS:
        raise ValueError(f"{held} rows in the training sample")
    return rows.join(F.broadcast(groups), "row").groupBy("row").agg(F.any_value("text").alias("text"), F.max("times").alias("times")).select("text", "times")


def _lexicon_rows(among: np.ndarray | None = None):
    """Distinct pairs of a lexicon entry and the least shingle of a text that has it; all entries, or those among some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bare = _bare_words(split_words(batch.column("text")))
            hashes, doc = word_hashes(bare), bare.doc()
            least, bounds = shingles(hashes, bare.first, 5)
            least = np.array([least[a:b].min() if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
            pick, _ = _distinct(hashes, doc, batch.num_rows)
            entry = np.concatenate(_entries(bare, hashes, pick))
            of = np.tile(least[doc[pick]], 1 + len(_BEGINNINGS))
            keep = entry != 0 if among is None else np.isin(entry, among)
            entry, of = np.unique(np.stack([entry[keep], of[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(of.view(np.int64))], ["entry", "least"])

    return run


def _rows_with(rows: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """In how many texts each entry is, near copies counted once over the whole sample."""
    return rows.select("text").mapInArrow(_lexicon_rows(among), "entry long, least long").distinct().groupBy("entry").agg(F.count("*").alias("n"))


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Entries that are LEXICON_ODDS times likelier in toxic rows of the sample; sorted hashes."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    n = labels.count()
    if not n:
        return np.zeros(0, np.uint64)
    part = _drawn(LABELLED_ROWS / n, "doc_id")
    drawn = labels.where(part).dropDuplicates(["doc_id"])
    rows = docs.where(part).select("doc_id", "text").join(drawn, "doc_id")
    of = drawn.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    matched = rows.count()
    if matched > 2 * LABELLED_ROWS:  # an id with many texts
        rows = rows.where(_drawn(LABELLED_ROWS / matched, "doc_id", "text"))
    # At most 1 / LEXICON_SHARE times the entries of one text on average; only these are counted in the other rows.
    bad = _rows_with(rows.where("toxic")).where(F.col("n") >= max(LEXICON_ROWS, LEXICON_SHARE * of.bad)).toPandas()
    entry = bad["entry"].to_numpy(np.int64)
    order = np.argsort(entry)
    entry, n_bad, n_good = entry[order], bad["n"].to_numpy(float)[order], np.zeros(len(entry))
    if len(entry):
        good = _rows_with(rows.where("NOT toxic"), entry.view(np.uint64)).toPandas()
        n_good[np.searchsorted(entry, good["entry"].to_numpy(np.int64))] = good["n"]
    odds = (n_bad + 0.5) / (of.bad + 1) / ((n_good + 0.5) / (of.good + 1))
    return np.sort(entry[odds >= LEXICON_ODDS].view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame | None = None) -> Scorer:
    """The lexicon, vote patterns of all rows, posteriors, then the scorer on the sample."""
    lexicon = learn_lexicon(docs, labels) if labels is not None else np.zeros(0, np.uint64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            votes, hashes, bounds = votes_and_features(batch.column("text"), lexicon)
            pattern, count = np.unique(patterns(votes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(count.astype(np.int64))], ["pattern", "n"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            votes, hashes, bounds = votes_and_features(batch.column("text"), lexicon)
            words, _ = _slots(votes, hashes, bounds)
            rows = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(patterns(votes)), pa.array(rows, pa.binary()), batch.column("times")], ["pattern", "words", "times"])

    seen = docs.select("text").mapInArrow(look, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if not len(seen):
        return Scorer(np.zeros(DIMENSIONS, np.float32), 1.0, lexicon)
    posterior = dict(zip(seen["pattern"], fit_labellers(seen["pattern"].to_numpy(), seen["n"].to_numpy(float)), strict=True))
    rows = training_rows(docs, float(seen["n"].sum())).mapInArrow(sample, "pattern long, words binary, times long").toPandas()
    if not len(rows):
        return Scorer(np.zeros(DIMENSIONS, np.float32), 1.0, lexicon)
    rows = rows.loc[rows.index.repeat(rows["times"])].sort_values(["pattern", "words"], ignore_index=True)
    pattern = rows["pattern"].to_numpy()
    votes = pattern[:, None] // 2 ** np.arange(len(LABELLERS)) % 2
    _, flags = _slots(votes, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    words = [np.frombuffer(w, np.int32) for w in rows["words"]]
    return _train(words, flags, np.array([posterior[p] for p in pattern]), lexicon)


def score_quality(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score (probability of good), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            score = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(score >= KEEP_FROM)], ["doc_id", "score", "kept"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch.rename_columns([f"c{n}" for n in range(batch.num_columns)])]), f"c{at}"):
                kept = shared.value.score(part.column(at)) >= KEEP_FROM
                yield part.filter(pa.array(kept)).rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
