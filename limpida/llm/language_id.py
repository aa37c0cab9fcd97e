"""Language identification by bit-sliced Bloom filters of n-grams (operator 9).

Each language has a Bloom filter of the byte n-grams that make up at least ``MIN_SHARE`` of its
learning text; so no language can have more than 1 / MIN_SHARE of them, whatever the corpus. The
filters are bit-sliced: one table of positions, each with a mask in which bit l says whether
language l's filter has the position set. ANDing the masks of an n-gram's positions gives all
languages that contain it. Per language, the bits over a text's n-grams are counted and corrected
for the false positives that the filter's fill predicts; the highest corrected count decides.

N-gram counts are partial per task and summed by (language, n-gram); frequent n-grams of one
language are thinned that way before the shuffle. The table sent to all workers has ``POSITIONS``
masks, a fixed size; where ``lang`` has more than ``GROUP`` values, groups of them take turns and each row
carries the best language so far, so memory does not grow with the values of a dirty column. More than
``MOST_LANGUAGES`` values are an error, found by a bounded read.

Defined results: null text, or text without a letter, is ``und`` with score 0. A text in which no
n-gram is known gets the language with most learning text, score 0. Ties go to the language that
sorts first. Without any learning text all is ``und``. Repeated rows weigh as often as they come.
A row without id is never held out. Very long texts are counted whole, in one array of their bytes. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.llm.grams import Counts, windows
from limpida.llm.tables import stored
from limpida.llm.words import chunks, mix, utf8

N_GRAM = 5
MIN_SHARE = 3e-6
POSITIONS = 1 << 21
HASHES = 3
UNKNOWN = "und"
_PER_WORD = 63
#: Languages whose filters are sent together, 16 MB for each 63; further languages take further passes over the texts.
GROUP = 2 * _PER_WORD
#: Values of ``lang`` above which learning stops with an error.
MOST_LANGUAGES = 20_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (also over the end of a text), and the text offsets."""
    data, offsets = utf8(texts)
    n = int(offsets[-1])
    body = data[:n]
    body += ((body - np.uint8(65)) < 26).view(np.uint8) << 5
    return windows(data, n, N_GRAM), offsets


def _inside(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text: from, to."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - N_GRAM + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counts] = {}

    def out(everything: bool) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            for keys, n in counts.drain(everything):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    for batch in chunks(batches, "text"):
        grams, offsets = _grams(batch.column("text"))
        begin, end = _inside(offsets)
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            pick = np.zeros(len(grams) + 1, np.int8)
            np.add.at(pick, begin[own], 1)
            np.add.at(pick, end[own], -1)
            held.setdefault(lang, Counts()).add(grams[np.cumsum(pick[:-1], dtype=np.int8) > 0])
        yield from out(False)
    yield from out(True)


def _places(grams: np.ndarray) -> list[np.ndarray]:
    first = mix(grams, np.uint64(0))
    step = mix(first, grams) | np.uint64(1)
    return [((first + np.uint64(j) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for j in range(HASHES)]


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("gram").to_numpy().view(np.uint64)
        bit = batch.column("bit").to_numpy()
        mask = np.left_shift(np.int64(1), bit % _PER_WORD)
        for place in _places(grams):
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bit // _PER_WORD), pa.array(mask)], ["place", "word", "mask"])


class Model:
    """Languages in order, the masks by word and position, and each language's false-positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray) -> None:
        self.languages, self.masks = languages, masks
        fill = [np.count_nonzero(masks[b // _PER_WORD] >> (b % _PER_WORD) & 1) / POSITIONS for b in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    def hits(self, grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each text and language: how many n-grams the language's filter contains."""
        out = np.zeros((len(begin), len(self.languages)))
        places = _places(grams)
        for word in range(len(self.masks)):
            found = self.masks[word][places[0]]
            for place in places[1:]:
                found &= self.masks[word][place]
            for b in range(word * _PER_WORD, min(len(self.languages), (word + 1) * _PER_WORD)):
                total = np.append(0, np.cumsum(found >> (b % _PER_WORD) & 1))
                out[:, b] = total[end] - total[begin]
        return out

    def best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the best language, its corrected count and the second highest."""
        grams, offsets = _grams(texts)
        begin, end = _inside(offsets)
        n = (end - begin)[:, None]
        true = np.maximum(0, (self.hits(grams, begin, end) - n * self.false) / np.maximum(1e-9, 1 - self.false))
        second = np.sort(true, 1)[:, -2] if true.shape[1] > 1 else np.zeros(len(true))
        return np.array(self.languages, object)[true.argmax(1)], true.max(1), second


def learn(docs: DataFrame) -> tuple[list[Model], str]:
    """The filters of all rows with text and language, by groups of languages, and the language with most text."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = stored(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values: clean the column, or raise MOST_LANGUAGES")
    totals.sort(key=lambda r: r.lang.encode())
    models = []
    for lo in range(0, len(totals), GROUP):
        part = totals[lo : lo + GROUP]
        bits = docs.sparkSession.createDataFrame([(r.lang, b, r.total) for b, r in enumerate(part)], "lang string, bit long, total long")
        frequent = counts.join(F.broadcast(bits), "lang").where(F.col("n") >= F.col("total") * MIN_SHARE)
        places = (
            frequent.select("gram", "bit").mapInArrow(_set_bits, "place long, word long, mask long")
            .groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
        )
        masks = np.zeros(((len(part) - 1) // _PER_WORD + 1, POSITIONS), np.int64)
        masks[places["word"].to_numpy(), places["place"].to_numpy()] = places["mask"].to_numpy()
        models.append(Model([r.lang for r in part], masks))
    return models, max(totals, key=lambda r: r.total).lang if totals else UNKNOWN


_SO_FAR = "doc_id long, text string, best string, top double, second double"


def _better(shared):
    """Rows with the best language so far, after one more group of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            names, top, second = shared.value.best(batch.column("text"))
            best, first, next_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("best", "top", "second"))
            higher = top > first
            best = np.where(higher, names, best)
            next_ = np.where(higher, np.maximum(second, first), np.maximum(next_, top))
            columns = [pa.array(best, pa.string()), pa.array(np.maximum(top, first)), pa.array(next_)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "best", "top", "second"])

    return run


def _decided(most: str, known: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, second = (batch.column(c).to_numpy() for c in ("top", "second"))
            score = np.zeros(len(top))
            np.divide(top, top + second, out=score, where=top > 0)
            names = [most if b is None else b for b in batch.column("best").to_pylist()]
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not known or text is None or not any(map(str.isalpha, text)):
                    names[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, models: list[Model], most: str) -> DataFrame:
    """doc_id, lang_pred, score; only the text is looked at. Each group of languages is one pass over the texts."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("top"), F.lit(0.0).alias("second")
    )
    decided, scored = _decided(most, bool(models)), "doc_id long, lang_pred string, score double"
    for model in models[:-1]:
        rows = stored(rows.mapInArrow(_better(docs.sparkSession.sparkContext.broadcast(model)), _SO_FAR), "languages")
    if not models:
        return rows.mapInArrow(decided, scored)
    last = _better(docs.sparkSession.sparkContext.broadcast(models[-1]))
    return rows.mapInArrow(lambda batches: decided(last(batches)), scored)


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    models, most = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return predict(docs, models, most).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
