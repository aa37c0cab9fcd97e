"""Byte-level BPE encoding and decoding with a lazily determinised transducer (operator 6).

A token sequence is the BPE encoding of its bytes exactly if each two neighbours are: merging
``a + b`` gives ``[a, b]`` back. The merges are compiled into that relation and a byte trie of the
tokens. Together they are a transducer whose state is (last whole token, trie node of the token
begun), with several states alive until more bytes decide. It is determinised while it runs: a
deterministic state is a set of such pairs, each with the tokens not emitted yet, and a token goes
out as soon as all alive pairs agree on it. Each step taken is remembered, in tables of bounded size: a
state as packed bytes, read again only for a step not taken before, and a step as one number.

Decoding goes through an incremental UTF-8 state machine that holds back a character's first bytes
until the rest has come, so ids can be decoded in pieces of any size.

Defined results: null text counts as empty and has no tokens; ids outside the vocabulary raise;
decoding bytes that are not UTF-8 gives replacement characters in text and the bytes themselves in
the digest. Each row is worked on alone, so nulls, ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Deterministic states that a worker remembers before it begins anew.
MAX_STATES = 300_000
#: Whole pieces of text that it remembers in each of two generations: what the older holds and is asked for
#: moves to the newer one, which takes the older's place when it is full.
MAX_PIECES = 150_000

_NEVER = 1 << 60
#: A step is its state, with the number of what it emits above these bits.
_STATE_BITS = 32
_STATE = (1 << _STATE_BITS) - 1

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.step_of: dict[int, int] = {}
        self.token_at = [-1]
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        for token, rank in ranks.items():
            if len(token) == 1 or self._merged(token) == [rank]:
                node = 0
                for byte in token:
                    key = node << 8 | byte
                    node = self.step_of.get(key, 0)
                    if not node:
                        node = self.step_of[key] = len(self.token_at)
                        self.token_at.append(-1)
                self.token_at[node] = rank
        self.inner = {key >> 8 for key in self.step_of}
        self._forget()

    def _forget(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.steps: dict[int, int] = {}
        self.said: list[tuple[int, ...]] = [()]
        self.said_number: dict[tuple[int, ...], int] = {(): 0}
        self.start = self._state([(-1, 0, ())])

    def _state(self, pairs: list[tuple[int, int, tuple[int, ...]]], agreed: int = 0) -> int:
        """The number of a state, whose pairs hold tokens beyond the first ``agreed``."""
        flat: list[int] = []
        for last, node, held in pairs:
            flat += (last, node, len(held) - agreed, *held[agreed:])
        return self._number(array("i", flat).tobytes())

    def _number(self, packed: bytes) -> int:
        number = self.number.get(packed)
        if number is None:
            number = self.number[packed] = len(self.states)
            self.states.append(packed)
        return number

    def _pairs(self, state: int) -> list[tuple[int, int, tuple[int, ...]]]:
        flat = tuple(array("i", self.states[state]))
        at, out = 0, []
        while at < len(flat):
            end = at + 3 + flat[at + 2]
            out.append((flat[at], flat[at + 1], flat[at + 3 : end]))
            at = end
        return out

    def _emitted(self, tokens: tuple[int, ...]) -> int:
        if tokens not in self.said_number:
            self.said_number[tokens] = len(self.said)
            self.said.append(tokens)
        return self.said_number[tokens]

    def _merged(self, data: bytes, lefts: list | None = None, rights: list | None = None) -> list[int]:
        """Merging by rank, for the compilation: the lowest rank first, ties from the left.

        ``lefts`` and ``rights`` get each first and last part with the rank at which it was merged away.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            if lefts is not None and i == 0:
                lefts.append((parts[0], rank))
            if rights is not None and i == len(parts) - 2:
                rights.append((parts[-1], rank))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if lefts is not None and rights is not None:
            lefts.append((parts[0], _NEVER))
            rights.append((parts[-1], _NEVER))
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list]:
        """What a token's first and last part are while it is merged, each until which rank."""
        if token not in self.edges:
            lefts: list = []
            rights: list = []
            self._merged(self.bytes_of[token], lefts, rights)
            self.edges[token] = lefts, rights
        return self.edges[token]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b before either is whole.

        Ranks only grow while a text is merged, so rank is time: the last part of a and the first of b
        meet if both are there at once, and merge if that comes before each is merged inside its token.
        Equal ranks go from the left: a's own merge before the crossing one, that before b's.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * MAX_STATES:
                self.pairs.clear()
            known, since_a, ranks = True, -1, self.ranks
            for last, until_a in self._edges(a)[1]:
                since_b = -1
                for first, until_b in self._edges(b)[0]:
                    if since_a <= until_b and since_b <= until_a:
                        rank = ranks.get(last + first, _NEVER)
                        if rank < until_a and rank <= until_b and rank != _NEVER:
                            known = False
                    since_b = until_b
                since_a = until_a
            self.pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The next deterministic state, and the number of the tokens that are certain now above its bits.

        Pairs stand in the order in which their begun tokens start, so equal sets are equal tuples. The
        bytes so far have one encoding, so at most one pair completes a token that may follow its last.
        """
        alive = []
        whole = None
        get, token_at = self.step_of.get, self.token_at
        for last, node, held in self._pairs(state):
            to = get(node << 8 | byte)
            if to is None:
                continue
            if to in self.inner:
                alive.append((last, to, held))
            if whole is None and (token := token_at[to]) >= 0 and (last < 0 or self._may_follow(last, token)):
                whole = (token, 0, (*held, token))
        if whole is not None:
            alive.append(whole)
        first = alive[0][2]
        agreed = len(first)
        for _, _, held in alive:
            if not agreed:
                break
            if held[:agreed] != first[:agreed]:
                agreed = min(agreed, len(held))
                while held[:agreed] != first[:agreed]:
                    agreed -= 1
        return self._emitted(first[:agreed]) << _STATE_BITS | self._state(alive, agreed)

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text."""
        if len(self.states) > MAX_STATES:
            self._forget()
        state, out = self.start, []
        for byte in data:
            key = state << 8 | byte
            step = self.steps.get(key)
            if step is None:
                if len(self.states) > 2 * MAX_STATES:  # within one very long piece
                    packed = self.states[state]
                    self._forget()
                    state = self._number(packed)
                    key = state << 8 | byte
                step = self.steps[key] = self._step(state, byte)
            state = step & _STATE
            if step > _STATE:
                out.extend(self.said[step >> _STATE_BITS])
        for _, node, held in self._pairs(state):
            if node == 0:
                out.extend(held)
        return out


class Utf8Stream:
    """Bytes in pieces to whole characters: the state is what a character begun still waits for."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        """The bytes of all characters that are complete now."""
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte >= 0xC0:
                length = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut -= back if back < length else 0
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        held, self.held = self.held, b""
        return held


class Codec:
    """Encoding and decoding with one vocabulary, for the life of a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def _piece(self, piece: str) -> bytes:
        if len(self.known) >= MAX_PIECES:
            self.known, self.older = {}, self.known
        ids = self.older.get(piece) or np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        coded = self._piece
        return b"".join([self.known.get(p) or coded(p) for p in self.split(text)])

    def decode(self, ids: Iterable[int], piece: int = 4096) -> Iterator[bytes]:
        """Bytes of whole characters, piece by piece."""
        stream, ids = Utf8Stream(), list(ids)
        for lo in range(0, len(ids), piece):
            yield stream.feed(b"".join([self.bytes_of[i] for i in ids[lo : lo + piece]]))
        yield stream.end()

    def decode_text(self, ids: Iterable[int]) -> str:
        return "".join(part.decode("utf-8", "replace") for part in self.decode(ids))


_codec_of: list = []


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker, as long as the same vocabulary is asked for."""
    ranks = shared.value
    if not _codec_of or _codec_of[0] is not ranks or _codec_of[1] != pattern:
        _codec_of[:] = [ranks, pattern, Codec(ranks, pattern)]
    return _codec_of[2]


def shared_ranks(spark: SparkSession, path: str):
    """The vocabulary for all workers; it is a fixed file of some 50 000 entries, whatever the input."""
    return spark.sparkContext.broadcast(load_ranks(path))


def _texts(batch: pa.RecordBatch, step: int = 500) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` as doc_id and token_ids."""
    ranks = shared_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in (part for whole in batches for part in _texts(whole)):
            ids = [np.frombuffer(codec.encode(t or ""), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and token_ids back to doc_id and text."""
    ranks = shared_ranks(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in (part for whole in batches for part in _texts(whole)):
            texts = [codec.decode_text(ids or ()) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Each text encoded and decoded again: doc_id, n_tokens and digests of the ids and of the bytes."""
    ranks = shared_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in (part for whole in batches for part in _texts(whole)):
            count, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                coded = codec.encode(text or "")
                count.append(len(coded) // 4)
                of_ids.append(hashlib.sha256(coded).hexdigest())
                digest = hashlib.sha256()
                for part in codec.decode(np.frombuffer(coded, "<u4").tolist()):
                    digest.update(part)
                of_bytes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
