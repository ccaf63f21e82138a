"""64-bit hashes of words, with a bounded cache."""

from __future__ import annotations


class WordHashes(dict):
    """Hash of a word's bytes; holds the latest words."""

    def __init__(self, size: int = 150_000) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        found = xxh3_64_intdigest(word)
        if len(self) >= self.size:
            self.clear()
        self[word] = found
        return found

    def array(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
