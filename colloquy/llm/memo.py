"""Remembered values of distinct byte strings, kept by a Python worker across its tasks."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Distinct strings, and their bytes, kept at once; beyond either the memory starts afresh, so a worker's memory is bounded.
MOST, MOST_BYTES = 600_000, 32 << 20
#: Words alone, where little is saved by remembering one.
MOST_WORDS = 200_000
_held: dict = {}


def held(name: str, make):
    """What this worker remembers for one operator, made anew when it turns to another: one operator's memory at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class Memo(dict):
    """Byte string -> row number; new strings get the next number and wait in ``new`` for ``fill``."""

    def __init__(self):
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        self.bytes += len(key)
        return n

    def forget(self) -> None:
        self.clear()
        self.new, self.bytes = [], 0

    def full(self, most: int = MOST) -> bool:
        return len(self) > most or self.bytes > MOST_BYTES

    def rows(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class WordHashes:
    """64-bit BLAKE2b hashes of distinct words: no construction gives two words one hash."""

    def __init__(self):
        self.words, self.hashes = Memo(), np.zeros(0, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.words.full(MOST_WORDS):
            self.__init__()
        rows = self.words.rows(words)
        if new := self.words.new:
            made = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in new]), "<u8")
            self.hashes = np.concatenate([self.hashes, made])
            new.clear()
        return self.hashes[rows]


class Lists:
    """Integer lists one after another, by row number, in growing arrays."""

    def __init__(self, dtype=np.uint32):
        self.flat, self.ends, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0

    def extend(self, packed: list[bytes]) -> None:
        """Add lists, each as the bytes of its integers (bytes objects cost the garbage collector nothing)."""
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.flat.itemsize
        used = int(self.ends[self.n - 1]) if self.n else 0
        total = used + int(sizes.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(total, 2 * len(self.flat)) - used, self.flat.dtype)])
        if self.n + len(packed) > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n], np.zeros(max(len(packed), len(self.ends)) + self.n, np.int64)])
        self.flat[used:total] = np.frombuffer(b"".join(packed), self.flat.dtype)
        np.cumsum(sizes, out=self.ends[self.n : self.n + len(packed)])
        self.ends[self.n : self.n + len(packed)] += used
        self.n += len(packed)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these rows, joined; where each begins, and the end)."""
        sizes = self.sizes(rows)
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        if not at[-1]:
            return np.zeros(0, self.flat.dtype), at
        index = np.repeat(self.ends[rows] - sizes - at[:-1], sizes)
        index += np.arange(at[-1])
        return self.flat[index], at
