"""Word-shingle sets of whole texts, hashed a run of documents at a time.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
set holds one 64-bit hash per distinct run of ``k`` words (a text of fewer
words: one for all of them).  Hashing works on the byte buffer of an Arrow
column with numpy, without a Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 18  # bytes hashed at a time, about (some 40 bytes of work space each)
# Odd multipliers and the shifts of a 64-bit finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
    lower[65:91] += np.uint64(32)
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return lower, word


LOWER, WORD = _tables()
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    def __init__(self, k: int):
        self.k = k
        self.up = self.down = np.empty(0, np.uint64)

    def _hash_run(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct hashes per document of one run of bytes."""
        n_docs, size = len(offsets) - 1, len(data)
        if len(self.up) < size + 1:
            self.up, self.down = _powers(BASE, size + 1), _powers(_INVERSE, size + 1)
        in_word = np.zeros(size + 2, bool)
        in_word[1:-1] = WORD[data]
        begins = in_word[1:-1] & ~in_word[:-2]
        ends = in_word[1:-1] & ~in_word[2:]
        edge = offsets[(offsets > 0) & (offsets < size)]  # a new text begins a new word
        begins[edge] = in_word[1:-1][edge]
        ends[edge - 1] = in_word[1:-1][edge - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(LOWER[data] * self.up[:size], out=total[1:])
        words = _mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        doc = np.searchsorted(offsets, first, "right") - 1
        count = np.bincount(doc, minlength=n_docs)
        start = np.cumsum(count) - count
        out = []
        if len(words) >= self.k:
            m = len(words) - self.k + 1
            runs = words[:m]
            for j in range(1, self.k):
                runs = _mix(runs * BASE + words[j:j + m])
        else:
            runs = words[:0]
        for d in range(n_docs):
            c, s = int(count[d]), int(start[d])
            if c >= self.k:
                out.append(np.unique(runs[s:s + c - self.k + 1]))
            elif c:
                h = np.array([c], np.uint64)
                for w in words[s:s + c]:
                    h = _mix(h * BASE + w)
                out.append(h)
            else:
                out.append(words[:0])
        return out

    def sets(self, column: pa.StringArray) -> Iterator[np.ndarray]:
        """One sorted array of distinct hashes (uint64) per text."""
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
            hi = min(hi, len(column))
            yield from self._hash_run(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            lo = hi


def set_key(tokens: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
