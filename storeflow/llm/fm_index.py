"""Bidirectional FM-index over a block of delimited words.

The text is ``$w1$w2$...$`` with the words in order, so the suffix that
starts with ``$w$`` has the word's place as its rank.  A match of a pattern
is an interval of suffix ranks in the text and one of equal size in the
reversed text; both are kept while the pattern grows to either side.
Searches run in lockstep over many patterns (arrays of intervals).
"""

from __future__ import annotations

import io

import numpy as np

BITS = 64


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes in order (a shorter one first), by prefix doubling from as
    many symbols as fit into 62 bits."""
    n, width = len(text), max(1, int(symbols).bit_length())
    start = max(1, 62 // width)
    padded = np.zeros(n + start, np.int64)
    padded[:n] = text + 1
    key = np.zeros(n, np.int64)
    for k in range(start):
        key = (key << width) | padded[k:k + n]
    step = start
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        step *= 2


class RankTable:
    """``less(c, i)``: symbols below ``c`` among the first ``i`` of a
    transformed text, from sums per 64 symbols and bit masks."""

    def __init__(self, last: np.ndarray, symbols: int):
        n = len(last)
        self.wide = symbols + 1
        blocks = n // BITS + 1
        padded = np.full(blocks * BITS, 255 if last.dtype == np.uint8 else -1, last.dtype)
        padded[:n] = last
        mask = np.zeros((blocks, self.wide), np.uint64)
        for c in range(symbols):
            own = np.packbits(padded == c, bitorder="little").view(np.uint64)
            mask[:, c + 1] = mask[:, c] | own
        inside = np.bitwise_count(mask).astype(np.int64)
        sums = np.zeros((blocks, self.wide), np.int64)
        np.cumsum(inside[:-1], axis=0, out=sums[1:])
        self.mask, self.sums = mask, sums
        self.flat_mask, self.flat_sums = mask.ravel(), sums.ravel()
        self.first = np.concatenate([[0], sums[-1][1:] + inside[-1][1:]])  # C: symbols below c in all

    def less(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = (i >> 6) * self.wide + c
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.flat_sums[at] + np.bitwise_count(self.flat_mask[at] & low)

    def less_all(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        block = i >> 6
        return self.sums[block] + np.bitwise_count(self.mask[block] & low[:, None])

    def extend(self, c, own, other, size):
        """Intervals with ``c`` added on this table's side."""
        end = own + size
        l0, l1 = self.less(c, own), self.less(c, end)
        o0, o1 = self.less(c + 1, own) - l0, self.less(c + 1, end) - l1
        return self.first[c] + o0, other + l1 - l0, o1 - o0


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word begins (one more)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


class FmIndex:
    def __init__(self, words: list[str], counts: np.ndarray, alphabet: np.ndarray | None = None,
                 left: np.ndarray | None = None, right: np.ndarray | None = None):
        """``words`` distinct and sorted.  ``left`` and ``right`` are the
        transformed text and reversed text, if known from before."""
        self.words, self.counts = words, counts
        if left is None:
            flat, starts = code_points(words)
            alphabet = np.unique(flat)
            text = np.zeros(len(flat) + len(words) + 1, np.int64)
            place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), np.diff(starts)) + 1
            text[place] = np.searchsorted(alphabet, flat) + 1
            kind = np.uint8 if len(alphabet) < 250 else np.int32
            left, right = (t[suffix_array(t, len(alphabet) + 2) - 1].astype(kind) for t in (text, text[::-1]))
        self.alphabet, self.left, self.right = alphabet, left, right
        symbols = len(alphabet) + 1
        self.to_left, self.to_right = RankTable(left, symbols), RankTable(right, symbols)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=np.frombuffer("\n".join(self.words).encode(), np.uint8), counts=self.counts,
                 alphabet=self.alphabet, left=self.left, right=self.right)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FmIndex:
        got = np.load(io.BytesIO(data))
        return cls(got["words"].tobytes().decode().split("\n"), got["counts"], got["alphabet"], got["left"], got["right"])

    def one_error(self, words: list[str], first_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(word, place)`` of every indexed word that one inserted, deleted
        or replaced code point makes of ``words[word]``.

        With ``first_exact`` the first half (rounded down) stands unchanged
        at the beginning and the search goes on to the right across the
        other; else the second half stands at the end and it goes left.
        Each word found is found once.
        """
        cps, starts = code_points(words)
        codes = np.searchsorted(self.alphabet, cps)
        known = codes < len(self.alphabet)
        known[known] = self.alphabet[codes[known]] == cps[known]
        codes = np.where(known, codes + 1, -1)
        codes = np.append(codes, -1)
        length = np.diff(starts)
        half = length // 2
        if first_exact:
            base, sign, exact, rest = starts[:-1] + half, 1, half, length - half
            side, back = self.to_right, self.to_left
        else:
            base, sign, exact, rest = starts[:-1] + half - 1, -1, length - half, half
            side, back = self.to_left, self.to_right

        # The exact half, from the middle outwards, and the delimiter.
        q = np.arange(len(words))
        own, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), len(self.left))
        done = []
        k = 0
        while len(q):
            end = exact[q] == k
            c = np.where(end, 0, codes[base[q] - sign * (k + 1)])
            ok = c >= 0
            q, own, other, size, c, end = (x[ok] for x in (q, own, other, size, c, end))
            other, own, size = back.extend(c, other, own, size)
            done.append([x[end & (size > 0)] for x in (q, own, other, size)])
            go = ~end & (size > 0)
            q, own, other, size = (x[go] for x in (q, own, other, size))
            k += 1
        q, own, other, size = (np.concatenate(x) for x in zip(*done))

        hits = []
        j = 0
        while len(q):
            end = rest[q] == j
            c = np.where(end, 0, codes[base[q] + sign * j])
            n0, n1 = side.less_all(own), side.less_all(own + size)
            below = n1 - n0
            sizes = np.diff(below, axis=1)
            # Another symbol here: replacing the next one, or before it.
            odd = sizes > 0
            odd[:, 0] = False
            odd[np.arange(len(q)), np.maximum(c, 0)] = False
            s, x = np.nonzero(odd)
            new_own = side.first[x] + n0[s, x + 1] - n0[s, x]
            new_other, new_size = other[s] + below[s, x], sizes[s, x]
            sub = ~end[s]
            # The next symbol left out; of a run of one symbol, the last.
            after = np.where(rest[q] > j + 1, codes[np.minimum(np.maximum(base[q] + sign * (j + 1), 0), len(codes) - 1)], 0)
            same = np.where(rest[q] > j + 1, cps_equal(cps, base[q] + sign * j, base[q] + sign * (j + 1)), False)
            out = ~end & ~same & (after >= 0)
            hits.append(self._finish(
                np.concatenate([q[s], q[s][sub], q[out]]),
                np.concatenate([np.full(len(s), j), np.full(int(sub.sum()) + int(out.sum()), j + 1)]),
                np.concatenate([new_own, new_own[sub], own[out]]), np.concatenate([new_other, new_other[sub], other[out]]),
                np.concatenate([new_size, new_size[sub], size[out]]), codes, base, sign, rest, side, first_exact))
            go = ~end & (c >= 0)
            s = np.flatnonzero(go)
            x = c[s]
            own, other, size, q = (side.first[x] + n0[s, x + 1] - n0[s, x], other[s] + below[s, x], sizes[s, x], q[s])
            q, own, other, size = (v[size > 0] for v in (q, own, other, size))
            j += 1
        found = [np.concatenate(x) for x in zip(*hits)] if hits else [np.empty(0, np.int64)] * 2
        return found[0], found[1]

    def _finish(self, q, at, own, other, size, codes, base, sign, rest, side, first_exact):
        """The rest of each pattern without a further error."""
        hits = []
        while len(q):
            end = rest[q] == at
            c = np.where(end, 0, codes[np.where(end, 0, base[q] + sign * at)])
            ok = c >= 0
            if not ok.all():
                q, at, own, other, size, c, end = (x[ok] for x in (q, at, own, other, size, c, end))
            own, other, size = side.extend(c, own, other, size)
            hit = end & (size > 0)
            hits.append((q[hit], (other if first_exact else own)[hit] - 1))
            go = ~end & (size > 0)
            q, at, own, other, size = q[go], at[go] + 1, own[go], other[go], size[go]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits))


def cps_equal(cps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = len(cps) - 1
    return cps[np.clip(a, 0, top)] == cps[np.clip(b, 0, top)]
