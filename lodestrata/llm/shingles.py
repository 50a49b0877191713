"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SPAN = 5
WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SPAN + 1)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of a text's words, with a bounded memory of words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes of the words between ASCII white space, A-Z lower-cased; none for null."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.most:
                self.known.clear()
            for w in set(words):
                if w not in self.known:
                    self.known[w] = xxhash.xxh64_digest(w)
            got = list(map(self.known.get, words))
        return np.frombuffer(b"".join(got), np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of five words; of fewer words, the one of all; of none, none."""
    n = len(words)
    if not n:
        return words
    if n < SPAN:
        return mixed((words * WEIGHTS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    h = words[: n - SPAN + 1] * WEIGHTS[0]
    for k in range(1, SPAN):
        h = h + words[k : n - SPAN + 1 + k] * WEIGHTS[k]
    return np.unique(mixed(h))
