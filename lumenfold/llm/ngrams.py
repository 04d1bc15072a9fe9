"""Word hashes, rolling n-gram hashes and winnowing over NumPy arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

# ASCII letters are lowered, ASCII digits and all other characters stay, other ASCII characters part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def ascii_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return text.translate(_WORDS).split()


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full, so memory stays bounded."""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 17)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of every n consecutive words, by doubling."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, size, base = None, 0, words, 1, _BASE
        for k in range(n.bit_length()):  # power: hashes of 2**k words; base: _BASE ** (2**k)
            if n >> k & 1:
                if out is None:
                    out = power[:count]
                else:
                    out = out * base + power[done : done + count]
                done += size
            if n >> (k + 1):
                power = power[:-size] * base + power[size:]
                size, base = 2 * size, base * base
        out = (out ^ (out >> np.uint64(33))) * _MIX
        return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many hashes, the position of its least hash, the rightmost among equals."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):
        out[at : at + (1 << 15)] = views[at : at + (1 << 15)].argmin(1)
    return np.arange(n) + (window - 1) - out


def spans_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the half-open spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
