"""Independent versions of the learned operators and of the fingerprints, on a
small table with repeated rows and extra columns with clashing names."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_operators import prose
from wearhouse.llm import fingerprint, langid, quality, toxicity

M64 = (1 << 64) - 1


def mixed(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def one_permutation(text: str, bins: int, size: int) -> bytes:
    """Bins as a dict, each empty bin filled by trying one bin after another."""
    ws = [w for w in text.encode().lower().split()]
    if not ws:
        return b""
    size = min(size, len(ws))
    least: dict[int, int] = {}
    for i in range(len(ws) - size + 1):
        h = size
        for j in range(size):
            h += xxhash.xxh3_64_intdigest(ws[i + j]) * pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)
        h = mixed(h & M64)
        b = (h >> 32) * bins >> 32
        least[b] = min(h, least.get(b, M64))
    out = []
    for b in range(bins):
        k = 0
        to = b
        while to not in least:
            to = mixed((k * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03 + 1) & M64) % bins
            k += 1
        out.append(least[to] & 255)
    return bytes(out)


def test_bins_and_densification():
    rng = random.Random(1)
    for n in (0, 1, 3, 5, 6, 20, 300, 3000):
        text = prose(rng, n)
        for bins in (16, 256):
            assert fingerprint.fingerprint(text, bins) == one_permutation(text, bins, 5)


def test_factorisation_machine_by_pairs():
    rng = np.random.default_rng(2)
    d = quality.WIDTH
    m = quality.Machine(rng.normal(0, 1, d).astype(np.float32), rng.uniform(0.5, 2, d).astype(np.float32), 0.3, rng.normal(0, 0.1, d), rng.normal(0, 0.1, (d, 4)))
    f = quality.Features()
    x = np.stack([f.row(t) for t in (prose(random.Random(3), 80), "", "A b 1 !! b b", None)])
    for row, got in zip(x, m.scores(x)):
        z = np.clip((row - m.mean) / m.scale, -4, 4).astype(np.float64)
        logit = m.w0 + sum(m.w[i] * z[i] for i in range(d))
        for i in range(d):
            logit += float((z[i] * (m.v[i + 1 :] @ m.v[i]) * z[i + 1 :]).sum())
        assert got == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-4)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        words = prose(rng, rng.randint(5, 60), "qz"[i % 2]).split()
        if i % 3 == 0:
            words += ["vilex", "vilexy"]
        rows.append((i, " ".join(words), "qz"[i % 2] * 2, int(i % 3 == 0), "x", 5, 0.5))
    rows += [rows[3], rows[3], (4, "qother text of id four", "qq", 0, "x", 5, 0.5), (90, None, "qq", 1, "x", 5, 0.5), (91, "", "zz", 0, "x", 5, 0.5), (92, "qa qa", None, None, "x", 5, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, word string, n long, score double").repartition(3)
    return rows, docs


def test_language_counts_and_backoff(table):
    rows, docs = table
    model = langid.train(docs, min_count=1)
    words, grams = defaultdict(Counter), {k: defaultdict(Counter) for k in langid.ORDERS}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            for w in langid.words(text):
                words[w][lang] += 1
    for w, by in words.items():
        for lang, n in by.items():
            for k in langid.ORDERS:
                for i in range(len(w) + 3 - k):
                    grams[k][f" {w} "[i : i + k]][lang] += n
    langs = ["qq", "zz"]

    def logs(counts):
        total = {lang: sum(c[lang] for c in counts.values()) for lang in langs}
        return {key: [math.log((c[lang] + 0.5) / (total[lang] + 0.5 * len(counts))) for lang in langs] for key, c in counts.items()}

    known, tables = logs(words), {k: logs(g) for k, g in grams.items()}

    def scored(word):
        if word in known:
            return known[word]
        out, i, word = [0.0, 0.0], 0, f" {word} "
        while i < len(word):
            for k in langid.ORDERS:
                row = tables[k].get(word[i : i + k]) if i + k <= len(word) else None
                if row:
                    out, i = [a + b for a, b in zip(out, row)], i + k
                    break
            else:
                i += 1
        return out

    texts = [*(t for _, t, *_ in rows), "unseenqab zzzunseen", "ß 12"]
    frame = docs.sparkSession.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    for i, t in enumerate(texts):
        ws = langid.words(t)
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        sums = [sum(scored(w)[k] for w in ws) for k in range(2)]
        p = [math.exp((s - max(sums)) / math.sqrt(len(ws))) for s in sums]
        assert got[i].lang_pred == langs[p.index(max(p))] and got[i].score == pytest.approx(max(p) / sum(p), rel=1e-3)


def test_toxicity_counts_lexicon_and_scale(table):
    rows, docs = table
    sample = {i: y for i, _, _, y, *_ in rows if y is not None and i != 4}
    frame = docs.sparkSession.createDataFrame(list(sample.items()), "doc_id long, y int")
    counts = toxicity.word_counts(docs, frame)
    want = defaultdict(lambda: [0, 0, 0])
    for i, text, *_ in rows:
        for w in set(toxicity.words(text)):
            want[w][0] += 1
            if i in sample:
                want[w][1 if sample[i] else 2] += 1
    assert {r.word: [r.n, r.n1, r.n0] for r in counts.collect()} == dict(want)
    model = toxicity.lexicon(counts)
    forms = defaultdict(lambda: [0, 0, 0])
    for w, c in want.items():
        for f in [w + toxicity.END, *(w[:k] for k in toxicity.PREFIXES if len(w) >= k)]:
            forms[f] = [a + b for a, b in zip(forms[f], c)]
    n, n1, n0 = (sum(c[k] for c in want.values()) for k in range(3))
    a0, share = toxicity.PRIOR * (n1 + n0), n1 / (n1 + n0)
    terms = {}
    for f, (m, m1, m0) in forms.items():
        y1, y0 = m1 + m * a0 / n, m0 + m * a0 / n
        s = math.log(y1 / (n1 + a0 - y1)) - math.log(y0 / (n0 + a0 - y0)) - math.sqrt(1 / y1 + 1 / y0) / 2
        ratio = 2 * ((m1 * math.log(m1 / ((m1 + m0) * share)) if m1 else 0) + (m0 * math.log(m0 / ((m1 + m0) * (1 - share))) if m0 else 0))
        if m1 > 1 and m1 > (m1 + m0) * share and ratio >= toxicity.LEAST_Z**2 and s > 0:
            terms[f] = s
    assert set(model.terms) == set(terms) and any(f.startswith("vilex") for f in terms)
    assert all(model.terms[f] == pytest.approx(s) for f, s in terms.items())
    # lambda: the expected growth of a clean text's segment is one a word
    tops = [f for f in terms if not any(f[:k] in terms for k in range(1, len(f)))]
    p = [(forms[f][2] + forms[f][0] * a0 / n) / (n0 + a0) for f in tops]
    total = sum(q * math.exp(model.scale * terms[f]) for f, q in zip(tops, p)) + (1 - min(0.9, sum(p))) * math.exp(model.scale * model.other)
    assert model.scale in (1.0, 50.0) or total == pytest.approx(1, abs=1e-3)
    # evidence by trying every range of words
    text = "qa vilex vilexy vilex qb qc"
    ws = toxicity.words(text)
    own = [toxicity.known_form(model.terms, w) for w in ws]
    best = max(sum(model.other if s is None else s for s in own[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1))
    found = toxicity.evidence(model, text)[1]
    assert found and max(s for s, _, _ in found) == pytest.approx(best)
