"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from array import array

import numpy as np
import xxhash
import zstandard

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that a worker spends on the words that it remembers (the memory starts anew when full), and those that an entry
#: takes beside its letters.
REMEMBERED_BYTES, _WORD_BYTES = 32 << 20, 200


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Numbers and hashes of words. Equal numbers of one call mean equal words, as equal hashes don't."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.table = array("Q")
        self.bytes = 0

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts in a row, and where each text ends."""
        known, table = self.known, self.table
        if self.bytes > REMEMBERED_BYTES:
            known.clear()
            del table[:]
            self.bytes = 0
        for words in texts:
            for w in set(words).difference(known):
                known[w] = len(table)
                table.append(xxhash.xxh3_64_intdigest(w))
                self.bytes += len(w) + _WORD_BYTES
        ends = np.cumsum([len(w) for w in texts], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        get = known.__getitem__
        return np.fromiter((i for words in texts for i in map(get, words)), np.int32, total), ends

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The hashes of words by their numbers."""
        return np.array(self.table, np.uint64)[numbers] if len(numbers) else np.zeros(0, np.uint64)

    def hashes(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts in a row, and where each text ends."""
        numbers, ends = self.numbers(texts)
        return self.of(numbers), ends


def runs(words: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each run of that many successive words; runs are doubled and added like a polynomial's values."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, out_size, power, power_size, rest = None, 0, words, 1, size
    raised = lambda k: np.uint64(pow(int(base), k, 1 << 64))
    while rest:
        if rest & 1:
            if out is None:
                out, out_size = power, power_size
            else:
                n = len(words) - out_size - power_size + 1
                out = out[:n] * raised(power_size) + power[out_size : out_size + n]
                out_size += power_size
        rest >>= 1
        if rest:
            n = len(words) - 2 * power_size + 1
            power = power[:n] * raised(power_size) + power[power_size : power_size + n]
            power_size *= 2
    return mix(out)


def inside(total: int, ends: np.ndarray, size: int) -> np.ndarray:
    """Which run of that many words starts where it ends in the same text."""
    ok = np.ones(max(0, total - size + 1), bool)
    for e in ends[:-1] if len(ends) else []:
        ok[max(0, e - size + 1) : e] = False
    return ok


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)
