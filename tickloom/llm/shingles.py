"""Word shingles of whole texts: as sets of words, and as 64-bit hashes.

A word's hash is a keyed cryptographic one, remembered per worker; a shingle's mixes those of its words by
their places. So texts that are alike in form share no hashes unless they share words.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

WORDS = 5
_U = np.uint64
_KEY = b"word shingles"
#: Distinct words remembered at once (about 20 MB).
MOST = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="uint64") * _U(0x9E3779B97F4A7C15) + _U(seed))


_ODD = randoms(WORDS, 12) | _U(1)


class WordHashes(dict):
    """64-bit hashes of words, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        return found


_KNOWN = WordHashes()


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased: runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_shingles(text: str) -> frozenset[tuple[bytes, ...]]:
    """The distinct shingles themselves; a text of one to four words has its whole sequence as its one shingle."""
    words = words_of(text)
    if len(words) < WORDS:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(WORDS))))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a text without words has none."""
    if len(_KNOWN) > MOST:
        _KNOWN.clear()
    split = [words_of(t) for t in texts]
    begins = np.cumsum([0, *map(len, split)]).tolist()
    empty = np.zeros(0, "uint64")
    with np.errstate(over="ignore"):
        words = mix(np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(split)), "uint64", begins[-1]))
        padded = np.concatenate([words, np.zeros(WORDS, "uint64")])
        whole = mix(sum(padded[k : k + len(words)] * _ODD[k] for k in range(WORDS)))
        out = []
        for a, b in zip(begins[:-1], begins[1:]):
            n = b - a
            if n >= WORDS:
                out.append(np.unique(whole[a : b - WORDS + 1]))
            elif n:
                short = sum((words[a + k] * _ODD[k] for k in range(n)), _U(n))
                out.append(mix(np.asarray([short], "uint64")))
            else:
                out.append(empty)
    return out
