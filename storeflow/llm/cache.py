"""A bounded cache for per-word work inside one Python worker."""

from __future__ import annotations

from collections.abc import Callable


class TwoGenerations(dict):
    """Dictionary that computes missing values and stays bounded.

    When it holds ``limit`` entries they become the old generation and a
    new one begins; values found in the old one move over, so frequent
    words stay.  Never more than ``2 * limit`` entries; keys longer than
    ``max_key`` are computed each time.
    """

    def __init__(self, compute: Callable, limit: int, max_key: int = 64):
        super().__init__()
        self.compute, self.limit, self.max_key, self.old = compute, limit, max_key, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.max_key:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
