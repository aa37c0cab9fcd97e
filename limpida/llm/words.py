"""Words and word hashes of Arrow text columns, by whole arrays.

A word is a longest run of bytes other than ``[\\x20\\x09-\\x0D]``. In UTF-8 these blanks are
never part of another character, so working on bytes gives the words of the text.
Null texts count as empty and have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task; a longer single text is taken alone.
CHUNK_BYTES = 4 << 20

_PAD = 16
_ODD_1 = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


@dataclass
class Words:
    """Words of a run of texts: bytes ``data[starts[i]:ends[i]]``; text t has words first[t]:first[t+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row (padded) and the offset of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    padded = np.zeros(len(raw) + _PAD, np.uint8)
    padded[: len(raw)] = raw
    return padded, at - at[0]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(texts)
    n = len(data) - _PAD
    body = data[:n]
    if lower:
        body += ((body - np.uint8(65)) < 26).view(np.uint8) << 5
    solid = (body != 32) & ((body - np.uint8(9)) > 4)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid
    closes[:-1] &= ~np.append(solid[1:], False)[: n - 1] | edge[1:n] if n else True
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One round of a 64-bit hash: ``x`` goes into ``h``."""
    h = (h ^ x) * _ODD_1
    h ^= h >> _SHIFT
    h *= _ODD_2
    h ^= h >> _SHIFT
    return h


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, from all its bytes."""
    data = words.data
    at = np.ndarray((len(data) - 8,), "<u8", buffer=data, strides=(1,))
    size = words.ends - words.starts
    h = mix(size.astype(np.uint64), at[words.starts] & _TAIL[np.minimum(size, 8)])
    left, step = np.flatnonzero(size > 8), 8
    while len(left):
        rest = size[left] - step
        h[left] = mix(h[left], at[words.starts[left] + step] & _TAIL[np.minimum(rest, 8)])
        left = left[rest > 8]
        step += 8
    return h


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbouring words (also runs over the end of a text)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out, h[j : j + n])
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and the bounds of each text's part.

    A text of 1 to k - 1 words has its whole sequence as one shingle; without words it has none.
    """
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.append(0, np.cumsum(many))
    out = np.zeros(bounds[-1], np.uint64)
    full = run_hashes(h, k)
    begin = np.repeat(first[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    whole = np.repeat(count >= k, many)
    out[whole] = full[begin[whole]]
    for t in np.flatnonzero((count > 0) & (count < k)):
        out[bounds[t]] = run_hashes(h[first[t] : first[t + 1]], int(count[t]))[0]
    return out, bounds
