"""Words and their hashes inside Python tasks, shared by the operators on shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes remembered per task before the table is emptied.
REMEMBERED = 200_000


class WordHash(dict):
    """64-bit hash of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at blanks and the ASCII controls from tab to return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.array([known[w] for w in words], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out
