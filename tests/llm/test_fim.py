"""Fill in the middle against a regular expression that splits the units off."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from wearhouse.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm=80, units=TOKEN.findall):
    text = text or ""
    name = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[i : i + 8], 16) for i in range(0, 32, 8)]
    own = units(text)
    n = len(own)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size)
        matrix = fim.WaveletMatrix(values)
        begin = rng.integers(0, size + 1, 50)
        end = np.array([rng.integers(b, size + 1) for b in begin])
        for c in range(8):
            assert matrix.rank(c, begin, end).tolist() == [int((values[x:y] == c).sum()) for x, y in zip(begin, end)]
        some = [1, 4, 6]
        have = matrix.before(some, begin, end)
        k = np.array([rng.integers(0, h + 1) for h in have])
        hits = [np.flatnonzero(np.isin(values[x:y], some)) for x, y in zip(begin, end)]
        want = [int(x) if not n else int(x + h[n - 1] + 1) for x, h, n in zip(begin, hits, k)]
        assert matrix.place(some, begin, end, k).tolist() == want


def rows():
    rng = random.Random(2)
    own = [None, "", " ", "\n\n", "x", " x ", "a<P>b", "<S>", "<M> y", "a < b <p>", "<<S", "é 日本\x0b語  x y", "w " * 40_000, "z" * 50_000]
    own += ["".join(rng.choice("ab \n\t<>é") for _ in range(rng.randrange(60))) for _ in range(200)]
    out = list(enumerate(own)) + [(5, "same id, other text"), (6, own[6]), (None, "no id here"), (None, None)]
    return out + [out[100], out[100]]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, 3, "plain", "clash", 1) for i, t in rows()]
    return spark.createDataFrame(data, "doc_id long, text string, n int, form string, output string, prefix_chars int").repartition(3)


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_against_brute_force(docs, rate, spm):
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs, rate=rate, spm=spm).collect()), key=str)
    assert got == sorted((brute(i, t, rate, spm) for i, t in rows()), key=str)


def test_lines(docs):
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs, unit="line").collect()), key=str)
    assert got == sorted((brute(i, t, units=lambda x: x.splitlines(True) if "\x0b" not in x else re.findall(r"[^\n]*\n|[^\n]+", x)) for i, t in rows()), key=str)
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="page")


def test_texts_share_matrices(monkeypatch, docs):
    monkeypatch.setattr(fim, "CHARS", 64)
    texts = [t or "" for _, t in rows()]
    assert [i for p in fim._packs(texts) for i in p] == list(range(len(texts)))


def test_query_restores_the_text(docs, monkeypatch, spark):
    monkeypatch.setattr(fim, "documents", lambda *_: docs)
    got = sorted((tuple(r) for r in fim.op12_fill_in_middle(spark, "").collect()), key=str)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = [(*b[:5], sha(b[5]), sha(t or "")) for (i, t), b in ((r, brute(*r)) for r in rows())]
    assert got == sorted(want, key=str)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
