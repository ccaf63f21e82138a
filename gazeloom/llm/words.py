"""A word cache for tokenizers whose tokens never cross the start of a word."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """Maps a word to the bytes of its ids. Holds at most two generations of `size` words; older ones are computed again."""

    def __init__(self, encode: Callable[[str], bytes], size: int = 150_000) -> None:
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found
