"""Token ids, token files, sentence pieces: against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storeflow.llm import varbytes
from storeflow.llm.pieces import encode_decode, model
from storeflow.llm.queries import tokenizer
from storeflow.llm.subwords import encoder
from storeflow.llm.token_files import encode_documents, read_token_files

from .helpers import ODD_TEXTS, clashing, frame, odd_docs, rows_of

SPECIAL = st.lists(st.sampled_from([
    "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<", "a", "Bé", " ", "\n", "  ", ".", "你"]),
    max_size=9).map("".join)
MIXED = st.text(alphabet=st.sampled_from(list("abceT '.1\n\t é́ß你▁\x1c\xa0 ")), max_size=60)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=9))
def test_varbytes_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    values = np.array([v for d in docs for v in d], np.uint32)
    control, data = varbytes.encode(values, counts)
    assert len(control) == sum(-(-len(d) // 4) for d in docs)
    assert varbytes.decode(control, data, counts).tolist() == values.tolist()


def test_varbytes_refuses_damage():
    control, data = varbytes.encode(np.array([1, 300], np.uint32), np.array([2]))
    with pytest.raises(ValueError):
        varbytes.decode(control, data[:-1], np.array([2]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, monkeypatch):
    lib, own = library(name), encoder(tokenizer(name))

    @settings(max_examples=300, deadline=None)
    @given(MIXED | SPECIAL | st.text(max_size=30))
    def check(text):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids

    check()
    texts = ODD_TEXTS + ["of the was " * 50, "ab's it'S x.y, A!B? \u00e9t\u00e9. \n", "end.\n", " lead", "trail "]
    column = pa.array(["skipped", *texts]).slice(1)
    for text, got in zip(texts, own.arrays(column), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("storeflow.llm.subwords.RUN_BYTES", 40)
    for text, got in zip(texts, own.arrays(column), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    rows = odd_docs()
    random.Random(1).shuffle(rows)
    lib = library("word_bpe_49k.json")
    docs = clashing(frame(spark, rows)).repartition(5)
    stored = encode_documents(docs, tokenizer("word_bpe_49k.json"), 2)
    got = rows_of(read_token_files(spark, stored))
    assert len(got) == len(rows)
    assert sum(r["n_docs"] for r in rows_of(stored.files)) == len(rows)
    # starts are gapless in id order, nulls last
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    at = 0
    for r in ordered:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = sorted((repr(r[0]), lib.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == want
    # frequent ids have the low ranks
    counts = [r["n"] for r in sorted(rows_of(stored.dictionary), key=lambda r: r["rank"])]
    assert counts == sorted(counts, reverse=True)


def test_token_files_empty(spark):
    stored = encode_documents(frame(spark, []), tokenizer("word_bpe_49k.json"), 2)
    assert rows_of(read_token_files(spark, stored)) == []


def test_pieces_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    own = model(tokenizer("piece_bpe_32k.model"))

    @settings(max_examples=400, deadline=None)
    @given(MIXED | st.text(max_size=40) | st.text(alphabet="abnrsthe ", max_size=80))
    def check(text):
        ids = lib.encode(text, add_bos=True, add_eos=True)
        coded = own.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids
        assert own.decode(coded) == lib.decode(ids)

    check()
    for text in ODD_TEXTS:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_bos=True, add_eos=True)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.integers(0, 31999) | st.integers(0, 400), max_size=12))
    def any_ids(ids):
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)

    any_ids()


def test_pieces_query_columns(spark):
    rows = odd_docs()
    full = rows_of(encode_decode(clashing(frame(spark, rows)), tokenizer("piece_bpe_32k.model")))
    short = rows_of(encode_decode(frame(spark, rows), tokenizer("piece_bpe_32k.model"), digests_only=True))
    want = sorted((repr(r["doc_id"]), r["n_tokens"], hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in full)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in short) == want
    assert rows_of(encode_decode(frame(spark, []), tokenizer("piece_bpe_32k.model"))) == []


def test_rows_without_an_id_are_spread_over_files(spark):
    rows = [(None if i % 3 else i, f"text {i} " * (i % 7), "en", "s", 1) for i in range(600)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # as ranges of a large table stay apart
    try:
        stored = encode_documents(frame(spark, rows).repartition(4), tokenizer("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.set(coalesce, "true")
    sizes = [r["n_docs"] for r in stored.files.collect()]
    assert len(sizes) > 3 and max(sizes) < 250 and sum(sizes) == 600
    got = rows_of(read_token_files(spark, stored, with_ids=False))
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known) and len(got) == 600
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
