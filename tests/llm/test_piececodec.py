"""Encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from wearhouse.llm import piececodec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piececodec.Codec(MODEL)


def encode(codec: piececodec.Codec, texts: list[str]) -> list[list[int]]:
    parts = [list(codec.slices(t)) for t in texts]
    ids, n = codec.encode([p for own in parts for p in own])
    ends = np.cumsum(np.concatenate([[0], n]))
    at = np.cumsum([0] + [len(own) for own in parts])
    return [ids[ends[at[i]] : ends[at[i + 1]]].tolist() for i in range(len(texts))]


def odd_texts(library) -> list[str]:
    rng = random.Random(3)
    letters = ["abcdefgh ", "a ", "aab  \n\t", "éàüß ", "日本語の中文 x", "▁ ab", "😀👍🏽 é", "ABxyz019 .,;:-_/", "\0\x01\x7f​﻿ a", "thein er on at"]
    out = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(500)]
    for own in letters:
        out += ["".join(rng.choice(own) for _ in range(n)) for n in (1, 2, 5, 20, 100, 400)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000), 32])) for _ in range(rng.randrange(50))) for _ in range(500)]
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))).replace("▁", " ") for _ in range(1500)]
    return out + [" " * n for n in range(40)] + [" " * 3000, "a" * 3000, "ab" * 1500, "<s></s><unk><0x41>"]


def test_encode_equals_library(codec, library):
    texts = odd_texts(library)
    assert encode(codec, texts) == library.encode(texts)


def test_decode_equals_library(codec, library):
    rng = random.Random(4)
    runs = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(9))] for _ in range(5000)]
    runs += library.encode(odd_texts(library), add_eos=True)
    got = codec.decode(np.array([i for r in runs for i in r]), np.array([len(r) for r in runs]))
    assert got == [library.decode(r) if r else "" for r in runs]
    with pytest.raises(ValueError):
        codec.decode(np.array([32000]), np.array([1]))


def test_long_texts_are_cut_between_words(codec, library, monkeypatch):
    monkeypatch.setattr(piececodec, "CHARS", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc de\n") for _ in range(n)) for n in (49, 50, 51, 500, 5000)] + ["x" * 400 + " y", "é" * 120]
    assert any(len(list(codec.slices(t))) > 2 for t in texts)
    assert encode(codec, texts) == library.encode(texts)


def test_heap_and_rounds_agree(codec, library, monkeypatch):
    texts = odd_texts(library)[:800]
    monkeypatch.setattr(piececodec, "ROUNDS", 0)
    assert encode(codec, texts) == library.encode(texts)


def test_equal_hashes_do_not_join_words(codec, library, monkeypatch):
    monkeypatch.setattr(piececodec, "mix", lambda h: np.zeros_like(h))
    texts = ["one two three two one", "two tow owt"]
    assert encode(codec, texts) == library.encode(texts)


def test_query_over_a_table(spark, library, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " ", "\n", "é\0x"] + ["".join(rng.choice("abc de\n日") for _ in range(n)) for n in (10, 100, 3000)] + ["wort " * 40_000]
    rows = [(i, t, [1], 5, "x") for i, t in enumerate(texts)] + [(7, "seven again", [2], 5, "x")] * 2 + [(None, "no id", [3], 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens long, ids_sha256 string").repartition(3)
    got = piececodec.decode_ids(piececodec.encode_texts(docs, MODEL), MODEL)
    assert got.columns == ["doc_id", "ids", "text"]
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, ids, library.decode(ids)))
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(piececodec, "documents", lambda *_: docs)
    digests = sorted(
        ((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want), key=str
    )
    assert sorted((tuple(r) for r in piececodec.op11_piece_codec(spark, "").collect()), key=str) == digests
    assert piececodec.decode_ids(piececodec.encode_texts(docs.limit(0), MODEL), MODEL).count() == 0
    bare = spark.createDataFrame([(1, None), (2, []), (3, [2])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in piececodec.decode_ids(bare, MODEL).collect()) == [(1, None), (2, ""), (3, "")]
