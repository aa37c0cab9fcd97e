"""Windows of bytes over many texts at once, and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distinct windows that a task gathers before it hands on what it has.
GATHER = 3_000_000


def windows(data: np.ndarray, n: int, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes from each of the first n positions, the first byte lowest."""
    at = np.ndarray((n,), "<u8", buffer=data, strides=(1,))
    return at & np.uint64((1 << (8 * size)) - 1) if size < 8 else at.copy()


class Counts:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.held += len(part[0])
        if len(self.parts) > 12:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        keys, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, counts, len(keys)).astype(np.int64)
        self.parts = [(keys, counts)]
        self.held = len(keys)
        return keys, counts

    def drain(self, all_of_it: bool = False, step: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has been counted, in slices, if it is time to hand it on."""
        if self.held < GATHER and not all_of_it:
            return
        keys, counts = self.merge()
        if self.held >= GATHER or all_of_it:
            self.parts, self.held = [], 0
            for lo in range(0, len(keys), step):
                yield keys[lo : lo + step], counts[lo : lo + step]
