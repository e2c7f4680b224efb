"""Word shingles as 64-bit hashes, computed per document in numpy; a worker keeps the hashes of words it has seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S31, S32 = np.uint64(27), np.uint64(31), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S31)) * MIX1
    x = (x ^ (x >> S27)) * MIX2
    return x ^ (x >> S32)


class WordHashes(dict):
    """word -> xxHash64; forgotten when it holds 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_list(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.lower().split()


def shingle_sequence(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hash of every run of `words` words in order; a shorter text is one shingle, an empty one none."""
    found = word_list(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    take = min(words, n)
    acc = mix(w[:n - take + 1] + np.uint64(take))
    for i in range(1, take):
        acc = (acc ^ (acc >> S32)) * MIX1 + w[i:n - take + 1 + i]
    return mix(acc)


def shingle_set(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_sequence(text, hashes, words))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_binary()), b"").to_pylist()
