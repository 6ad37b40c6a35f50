"""Token ids by the ``tokenizers`` library, one white-space chunk at a time.

Merges of both supported kinds of files never cross the place between a
non-space and a white-space character, so a text's ids are those of its
chunks in a row.  A run of texts is cut at white space and its chunks are
dictionary-encoded by Arrow, so each distinct chunk of the run is looked at
once; numpy puts the ids of all occurrences together.  A chunk of plain
Latin characters is cut by the file's own pattern, and each part goes to
the library's merge model (recent parts are kept, bounded); any other chunk
goes through the library's whole encoder.  Files of an unknown kind are
encoded text by text.

A text that holds the string of an added token (``<|endoftext|>``) goes to
the library whole, which gives the token's own id, as
``encode(text, add_special_tokens=False)`` does.  With ``special_as_text``
such strings are ordinary text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cache import TwoGenerations

CACHE_PARTS = 350_000
RUN_BYTES = 1 << 24  # of text encoded at a time, about

# Unicode white space (the property White_Space).
_SPACE = "".join(map(chr, [
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LED_WORDS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# A space that does not stand alone between two other characters.
_ODD_SPACE = f"[{_SPACE}] | [{_SPACE}]|^[{_SPACE}]|[{_SPACE}]$"
# Characters whose case, class and normal form are the same in every
# Unicode version (U+0130 lowers to two characters).
_PLAIN = re.compile(f"[ -~\n\t\r{chr(0xA1)}-{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}]+")
_POINTS = ".,!?;:"
# Fixed value: the pattern that byte-level files split with.
_BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _byte_chars() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    chars, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            chars[b] = chr(b)
        else:
            chars[b] = chr(extra)
            extra += 1
    return chars


class SubwordEncoder:
    """``arrays(column)`` gives the ids of each text as ``dtype``."""

    def __init__(self, path: str, special_as_text: bool = False, cache_parts: int = CACHE_PARTS):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        added = [t["content"] for t in spec.get("added_tokens", []) if not (special_as_text and t["special"])]
        # Case aside, as some tokens are looked for in lower-cased text.
        self.added = "|".join(map(re.escape, added))
        self.model = self.library.model
        self.shown = _byte_chars()
        if self.kind == "words":
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            pattern = _BYTE_LEVEL_PATTERN
        self.pattern = regex.compile(pattern)
        self.by_part = TwoGenerations(self._part, cache_parts)

    def _part(self, part: str) -> bytes:
        mapped = part.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as bytes (native order, little-endian here)."""
        if not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        if self.kind == "words":
            chunk = chunk.lower()
            word = chunk
        else:
            word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return self.by_part[chunk]
        if word[-1:] in _POINTS and word[:-1].isalpha():
            return self.by_part[chunk[:-1]] + self.by_part[chunk[-1]]
        return b"".join(map(self.by_part.__getitem__, self.pattern.findall(chunk)))

    def _text(self, text: str) -> bytes:
        """Any text by its chunks, white space before a word with it."""
        return b"".join(map(self._chunk, _LED_WORDS.findall(text)))

    def _run(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        led = self.kind == "led words"
        if led:
            odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
            words = pc.split_pattern(texts, " ")
        else:
            odd = np.zeros(len(texts), bool)
            words = pc.ascii_split_whitespace(texts)
        whole = np.zeros(len(texts), bool)
        if self.added:
            whole = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        bounds = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        if led:
            ids = [self._chunk(" " + w) if w else b"" for w in distinct]
            # The first word of a text has no space before it.
            first = bounds[:-1]
            ids += [self._chunk(w) if w else b"" for w in words.values.take(pa.array(first)).to_pylist()]
            codes = codes.copy()
            codes[first] = len(distinct) + np.arange(len(texts))
        else:
            ids = [self._chunk(w) if w else b"" for w in distinct]
        flat = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        count = size[codes]
        ends = np.cumsum(count)
        out = flat[np.repeat(start[codes] - (ends - count), count) + np.arange(int(count.sum()))]
        edge = np.concatenate([[0], ends])[bounds]
        for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            if whole[i] or odd[i]:
                yield np.frombuffer((self._whole if whole[i] else self._text)(texts[i].as_py()), self.dtype)
            else:
                yield out[lo:hi]

    def arrays(self, column: pa.StringArray) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        if self.kind == "other":
            for text in column:
                yield np.frombuffer(self._whole(text.as_py()), self.dtype)
            return
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(column):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + RUN_BYTES, "right")))
            yield from self._run(column.slice(lo, hi - lo))
            lo = hi

    def encode(self, text: str) -> np.ndarray:
        return next(self.arrays(pa.array([text], pa.string())))


def _kind(spec: dict) -> str:
    """``words``: white space dropped, lower case, word ends; ``led words``:
    byte-level, a space belongs to the next word; else ``other``."""
    pre, norm, model = spec["pre_tokenizer"], spec["normalizer"], spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or pre is None:
        return "other"
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "led words"
    steps = [n["type"] for n in norm["normalizers"]] if norm and norm["type"] == "Sequence" else []
    if pre["type"] == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]:
        kinds = [p["type"] for p in pre["pretokenizers"]]
        if kinds == ["Split", "ByteLevel"]:
            first, second = pre["pretokenizers"]
            if first["behavior"] == "Removed" and first["invert"] and not second["use_regex"] \
                    and not second["add_prefix_space"]:
                return "words"
    return "other"


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> SubwordEncoder:
    """One encoder per worker process and file."""
    return SubwordEncoder(path, special_as_text)
