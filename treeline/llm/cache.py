"""A bounded cache for workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Words kept in one generation of a worker's cache (there are two), and the longest that is kept.
CACHE_WORDS = 250_000
CACHE_CHARS = 64


class Cache(dict):
    """Values of a function by word in two generations: the older goes when the newer is full."""

    def __init__(self, make: Callable[[Any], Any], most: int | None = None):
        self.make, self.most, self.older = make, most or CACHE_WORDS, {}

    def __missing__(self, word: Any) -> Any:
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value
