"""SentencePiece encoding by backtracking, and decoding.

A merge-type (BPE) model's result is the one row of pieces in which every
adjacent pair is stable, i.e. re-merging the pair's characters gives the
pair back.  The encoder walks a word from left to right: it takes the
longest piece that an Aho-Corasick automaton found at the position, checks
it against the piece before by re-merging, else tries the next shorter
prefix piece; when none fits it marks the position as failed in a bitfield
and takes the piece before back.  Pieces with a space inside do not exist,
so words (with the spaces before them) are encoded apart and recent words
are kept (bounded).

Defined results
---------------
* null and empty texts: the begin and end id alone (no space is put before
  an empty text, as in the library).
* an empty table gives an empty result; repeated rows give repeated rows;
  other columns are ignored.
* a model that is not of merge type, has no byte pieces, has user-defined
  pieces or a normaliser other than identity is refused with an error.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import TwoGenerations
from .common import empty_if_null

CACHE_WORDS = 250_000
CACHE_PAIRS = 400_000
SPACE = "\u2581"  # stands for a space in pieces (fixed value)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

codecs.register_error(
    "one_mark_per_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm, spec = m.normalizer_spec, m.trainer_spec
        if spec.model_type != proto.TrainerSpec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte pieces is required")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos = spec.bos_id, spec.eos_id
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(len(m.pieces), bool)
        self.is_text = np.zeros(len(m.pieces), bool)
        self.is_normal = np.zeros(len(m.pieces), bool)
        for i, p in enumerate(m.pieces):
            shown = b""
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                shown = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.NORMAL:
                self.id_of[p.piece], self.score[p.piece] = i, p.score
                self.is_text[i] = self.is_normal[i] = True
                shown = p.piece.replace(SPACE, " ").encode()
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece with a space inside")
            elif p.type == kinds.UNKNOWN:
                shown = spec.unk_surface.encode()
                self.is_text[i] = True
            elif p.type == kinds.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            self.surface.append(shown)
        self.lines_apart = not any("\n" in p for p in self.id_of)
        self.ids = {p: np.array([i], "<u4").tobytes() for p, i in self.id_of.items()}
        # Only pieces that their own characters merge to can come out.
        usable = [p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        known = set(usable)
        self.shorter = {}
        for p in usable:
            if len(p) > 1:
                self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in known), p[0])
        self.stable = TwoGenerations(self._stable, CACHE_PAIRS)
        self.by_word = TwoGenerations(self._word_ids, CACHE_WORDS)

    # ------------------------------------------------------------ merging

    def merge(self, text: str) -> list[str]:
        """The merge result itself: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, pair: tuple[str, str]) -> bool:
        return self.merge(pair[0] + pair[1]) == [*pair]

    # ----------------------------------------------------------- encoding

    def word(self, word: str) -> list[str]:
        """Pieces of one word by backtracking over longest matches."""
        n = len(word)
        longest = [1] * n
        for end, size in self.automaton.iter(word):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        usable = (1 << (n + 1)) - 1  # bit p: position p has not failed
        out: list[str] = []
        pos, stable, shorter = 0, self.stable, self.shorter
        token = word[:longest[0]]
        while True:
            end = pos + len(token)
            if usable >> end & 1 and (not out or stable[(out[-1], token)]):
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = word[pos:pos + longest[pos]]
                continue
            token = shorter.get(token)
            while token is None:
                # Nothing fits here: this position has failed.
                usable &= ~(1 << pos)
                back = out.pop()
                pos -= len(back)
                token = shorter.get(back)

    def _word_ids(self, word: str) -> bytes:
        if self.lines_apart and "\n" in word and len(word) > 1:
            return b"".join(map(self.by_word.__getitem__, re.findall("\n|[^\n]+", word)))
        ids = self.ids
        out = []
        for p in self.word(word):
            known = ids.get(p)
            if known is None:  # a character without a piece: its bytes
                known = np.array([self.byte_id[b] for b in p.encode()], "<u4").tobytes()
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end id, as little-endian unsigned 32-bit."""
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        if not text:
            return ends
        if not (self.prefix and text[0] != " ") or "  " in text or SPACE in text:
            escaped = text.replace(" ", SPACE)
            words = _WORDS.findall(SPACE + escaped if self.prefix else escaped)
        else:
            words = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        return ends[:4] + b"".join(map(self.by_word.__getitem__, words)) + ends[4:]

    # ----------------------------------------------------------- decoding

    def decode(self, ids: bytes) -> str:
        """The library's text of the ids (little-endian unsigned 32-bit)."""
        codes = np.frombuffer(ids, "<u4")
        raw = b"".join(map(self.surface.__getitem__, codes.tolist()))
        shown = codes[self.is_text[codes] | self.is_byte[codes]]
        if self.prefix and len(shown) and self.is_normal[shown[0]] and self.surface[shown[0]][:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "one_mark_per_byte")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_tokens`` and ``ids`` (array<int>) and ``decoded``,
    or with ``digests_only`` their SHA-256 (``ids_sha256`` over the ids as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` over UTF-8).

    A map without any shuffle: one batch of texts at a time is in memory.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"))
    ids_type = pa.string() if digests_only else pa.list_(pa.int32())
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            n, left, right = [], [], []
            for text in b.column("text"):
                ids = m.encode(text.as_py())
                decoded = m.decode(ids)
                n.append(len(ids) // 4)
                if digests_only:
                    left.append(hashlib.sha256(ids).hexdigest())
                    right.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    left.append(np.frombuffer(ids, "<i4"))
                    right.append(decoded)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(left, ids_type),
                 pa.array(right, pa.string())], names)

    kind = "string" if digests_only else "array<int>"
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, {names[2]} {kind}, {names[3]} string")
