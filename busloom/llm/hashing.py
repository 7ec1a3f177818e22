"""64-bit hashes of words, remembered by a worker."""

from __future__ import annotations

import itertools
import operator

import numpy as np
import xxhash

MEMO_WORDS = 300_000


class WordHasher:
    def __init__(self) -> None:
        self.memo: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """xxh3 of each word."""
        found = list(map(self.memo.get, words))
        if None in found:
            missing = set(itertools.compress(words, map(operator.is_, found, itertools.repeat(None))))
            if len(self.memo) + len(missing) > MEMO_WORDS:
                self.memo.clear()
            if len(missing) <= MEMO_WORDS:
                self.memo.update((w, xxhash.xxh3_64_digest(w)) for w in missing)
            get, digest = self.memo.get, xxhash.xxh3_64_digest
            found = [h or get(w) or digest(w) for w, h in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (shift and multiply, as in splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
