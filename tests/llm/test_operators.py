"""Every operator on a small table with nulls, empty and long texts, repeated
rows and extra columns with clashing names, against brute force."""

from __future__ import annotations

import hashlib
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from wearhouse.llm import decontam, fingerprint, langid, linededup, neardup, packing, quality, tokencount, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, th long, kept boolean, item_id long"


def prose(rng: random.Random, n: int, base: str = "") -> str:
    words = [base + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, n, 12)]
    return "\n".join(lines)


BENCH = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards watch quietly from afar."),
    (2, "Short item here"),
    (3, "The quick brown fox jumps over the lazy dog while nobody else is looking at it"),
    (4, ""),
    (5, None),
    (None, "an item without an id is hit like any other but never counted here today"),
    (2, "Short item here"),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randint(5, 150))) for i in range(60)]
    base = texts[7][1]
    for i in range(60, 72):  # near copies and copies
        words = base.split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = "changedword"
        texts.append((i, " ".join(words)))
    line = prose(rng, 12)
    texts += [(100, f"{line}\n{line}\n{prose(rng, 30)}"), (101, f"{prose(rng, 20)}\n{line[:-1]}"), (102, line + "x"), (103, line[1:5] + "Z" + line[6:])]
    quick = "the QUICK brown fox, jumps over the lazy dog while seven wizards watch!"
    texts += [(110, prose(rng, 40) + " " + quick + " " + prose(rng, 5)), (111, "xx short item HERE yy"), (112, "the quick brown fox jumps over")]
    texts += [(113, prose(rng, 20) + "\nso AN ITEM without an id is hit like any other, then")]
    texts += [(120, None), (121, ""), (122, " \n\t "), (123, "é"), (124, "日本語 テキスト\n\n"), (125, "w " * 30_000), (None, prose(rng, 30)), (126, "3 # !!")]
    texts += [texts[3], texts[3], (5, "another text with the id of five and some words of its own " * 3)]
    return texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None, 1, 0.5, 7, True, 9) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_token_counts(docs, none, rows):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 20) for i, t in rows)
    assert Counter(map(tuple, tokencount.count_tokens(docs, model, limit=20).collect())) == want
    assert tokencount.count_tokens(none, model).count() == 0


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    vocab, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(vocab)
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 128)):
            want[i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    got = packing.pack(docs, vocab, ranks, cap=128).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
    assert len(by) <= -(-sum(r.length for r in got) // 128) + 2
    assert packing.pack(none, vocab, ranks).count() == 0


def shingle_set(t: str | None, size: int) -> set:
    w = (t or "").encode().lower().split()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, none, rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[k][0], len(sets[k]), least[group[k]] if sets[k] else rows[k][0]) for k in range(len(rows)))
    got = neardup.near_duplicates(docs, size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(not r.kept for r in got) >= 11
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_crowded_entries(spark, monkeypatch):
    """Blocks, and links that only the second pass finds: a chain of texts in
    which each is like its neighbours only."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = [f"w{k}" for k in range(260)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, size=4).collect()}
    assert got == dict.fromkeys(range(40), 0)


def test_drop_near_duplicates(docs):
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert not set(ids) & set(range(60, 72)) and {7, 120, 121, 122, 123} <= set(ids) and None in ids


def brute_lines(rows, tau, least, hashes, copied=None):
    unique = {(i, hashes[i, t], t) for i, t in rows}
    places = [(i, h, k, x) for i, h, t in unique for k, x in enumerate((t or "").split("\n")) if len(x) >= least]
    order = lambda p: (p[0] is not None, p[0] or 0, *p[1:3])
    first = {}
    for p in sorted(places, key=order, reverse=True):
        first[p[3]] = p
    lines = list(first)
    links = defaultdict(set)
    for a in range(len(lines)):
        for b in range(a):
            if linededup.within(lines[a], lines[b], tau):
                links[lines[a]].add(lines[b])
                links[lines[b]].add(lines[a])
    out = {(i, h): [0, 0, 0, 0, i, []] for i, h, _ in unique}
    for p in places:
        r, x = out[p[:2]], p[3]
        again, near = first[x] != p, any(order(first[o]) < order(first[x]) for o in links[x])
        r[0] += 1
        r[1] += again
        r[2] += near and not again
        r[3] += len(links[x])
        ids = [q[0] for q in [first[x], *(first[o] for o in links[x])] if q[0] is not None]
        r[4] = min([y for y in [r[4], *ids] if y is not None], default=None)
        if again or near:
            r[5].append(p[2])
            source = min([first[x], *(first[o] for o in links[x])], key=order)[:2]
            if copied is not None and source != p[:2]:
                copied.setdefault(p[:2], Counter())[source] += len(x)
    return {k: (*v[:5], sorted(v[5])) for k, v in out.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_line_dedup(docs, none, rows, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    monkeypatch.setattr(linededup, "CHARS", 400)
    hashes = {(r[0], r[1]): r[2] for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    want = brute_lines(rows, 2, 24, hashes)
    got = {(r.doc_id, r.text_hash): (r.n_lines, r.n_exact, r.n_near, r.n_links, r.class_id, list(r.dropped)) for r in linededup.dedup_lines(docs).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 20 and sum(v[2] for v in want.values()) >= 3
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_line_threshold_grows_with_the_line(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    shared = " ".join(word() for _ in range(12))
    lines = []
    for n in (10, 18, 20, 22, 25, 40, 90, 200, 800):  # words; around and above the border between the two joins
        for _ in range(2):
            base = [word() for _ in range(n // 2)] + [shared] + [word() for _ in range(n // 2)]
            lines.append(" ".join(base))
            for changes in (1, 1, 2, n // 40 + 1, n // 15 + 1):
                new = list(base)
                for _ in range(changes):
                    new[rng.randrange(len(new))] = word()
                lines.append(" ".join(new))
    lines = list(dict.fromkeys(lines))
    want = {(a, b) for a in range(len(lines)) for b in range(a) if linededup.within(lines[a], lines[b], max(2, min(len(lines[a]), len(lines[b])) // 40))}
    assert sum(not linededup.within(lines[a], lines[b], 2) for a, b in want) > 20
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_near, r.n_links) for r in linededup.dedup_lines(docs).collect()}
    assert got == {a: (any((a, b) in want for b in range(a)), sum(a in p for p in want)) for a in range(len(lines))}


def test_drop_lines(docs, rows):
    hashes = {(r[0], r[1]): r[2] for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    copied = {}
    gone = {k: set(v[5]) for k, v in brute_lines(rows, 2, 24, hashes, copied).items()}
    wholes = 0
    want = Counter()
    for i, t in rows:
        g = gone[i, hashes[i, t]]
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) if g else t
        if not g or new.strip():
            whole = g and max(copied.get((i, hashes[i, t]), Counter([0])).values()) >= 0.5 * len(t)
            wholes += bool(whole)
            want[(i, t, 1) if whole else (i, new, len(new) if g else 1)] += 1
    assert wholes >= 3
    left = linededup.drop_lines(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in left.collect()) == want


def bench_words(t: str | None) -> list[str]:
    out, word = [], ""
    for c in (t or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("a" <= c <= "z" or "0" <= c <= "9"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def test_decontamination(docs, none, bench, rows):
    windows = defaultdict(set)
    for item, t in BENCH:
        w = bench_words(t)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])] |= set() if item is None else {str(item)}
    want = set()
    for i, t in rows:
        w, hit, items = bench_words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want.add((i, len(w), len(hit), len(items), digest, bool(hit)))
    got = decontam.decontaminate(docs, bench).drop("text_hash").collect()
    assert set(map(tuple, got)) == want and len(got) == len({(i, t) for i, t in rows})
    assert {r.doc_id for r in got if r.contaminated} == {110, 111, 113}
    assert decontam.decontaminate(none, bench).count() == 0
    assert not decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 3


def test_every_shared_span_is_found(spark):
    rng = random.Random(8)
    words = [f"a{k}" for k in range(6)]  # few words, so that hashes tie and repeat
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for k in range(30)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for k in range(60)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.decontaminate(d, b).collect()}
    for i, t in texts:
        w, hit, found = t.split(), set(), set()
        for item, u in items:
            v = u.split()
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(item)
        assert got[i] == (len(hit), len(found))


def test_fingerprints(docs, none, rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        new = fingerprint.edited(t, following)
        f, g, h = (fingerprint.fingerprint(x) for x in (t, new, following))
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), f.hex(), g.hex(), fingerprint.likeness(f, g), fingerprint.likeness(f, h)] += 1
    assert Counter(map(tuple, fingerprint.fingerprints(docs).collect())) == want
    assert fingerprint.fingerprints(none).count() == 0
    (one,) = fingerprint.fingerprints(docs.where("doc_id = 7")).collect()
    assert one.near_next == 1.0


def test_url_filters(spark):
    urls = {
        1: ("https://a.example.org/en/1/x?q", "example.org/en/1", "block"),
        2: ("http://EXAMPLE.org/es/", "example.org/es/", "block"),
        3: ("http://example.org/es", "org/", "allow"),
        4: ("http://example.org", None, "allow"),
        5: ("ftp://x.com/fr/y", "com/fr/", "allow"),
        6: ("http://x.com/de/", "com/de/", "block"),
        7: ("http://xcom/de/", None, "allow"),
        8: ("http://m.casino-win.example.net/en/", None, "block"),
        9: (None, None, "allow"),
        10: ("example.org/en/1", None, "allow"),
        11: ("http://notexample.org/es/", "org/", "allow"),
        12: ("", None, "allow"),
        13: ("http://x.net/a.org/", None, "allow"),
        14: ("http://x.com/" + "y" * 5000 + "/de/", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "", "v") for k, (u, _, _) in urls.items()], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {k: v[1:] for k, v in urls.items()}
    assert (got[1].host, got[1].path, got[9].host, got[10].path) == ("a.example.org", "/en/1/x", "", "")
    assert urlfilter.judge(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Two languages; toxic texts hold words of a toxic stem, poor ones repeat themselves."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(500):
        toxic, good = i % 5 == 0, i % 4 > 0
        words = prose(rng, rng.randint(20, 120), "q" if i % 2 else "z").split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice("aeiou") + rng.choice("xyz"))
        if not good:
            words = [w for w in words[:15] for _ in range(6)] + (words[-3:] if toxic else []) + [w for w in words if w.startswith("vile")]
        docs.append((i, " ".join(words), "qq" if i % 2 else "zz"))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None, "qq"), (901, "", None), (902, "12 34 !!", "zz"), (None, "qabc qdef", "qq"), (903, "w " * 20_000, None)]
    labels += [(901, None, None), (None, 1, 1), (0, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(labelled, none):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(500) if held_out(i)]
    assert sum((got[i].score >= 0.5) != (i % 5 == 0) for i in held) <= 1
    assert all(got[i].score < 0.5 and got[i].passages == [] for i in (900, 901, 902, 903, None))
    assert any("vile" in p.text for i in held for p in got[i].passages)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.values():  # whole, in order, disjoint
        ws = toxicity.words(texts[r.doc_id])
        assert all(p.text == " ".join(ws[p.first : p.last + 1]) for p in r.passages)
        assert all(p.last < q.first for p, q in zip(r.passages, r.passages[1:]))
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == docs.count() - sum(r.score >= 0.5 for r in got.values())
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, blank).collect()} == {True}


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.terms == b.terms and (a.bias, a.slope) == (b.bias, b.slope)


def test_quality(labelled, none):
    docs, labels = labelled
    machine = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    held = [i for i in range(500) if held_out(i)]
    assert sum((got[i] >= 0.5) != (i % 4 > 0) for i in held) <= 2
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(none, machine).count() == 0


def test_language(labelled, none):
    docs, _ = labelled
    model = langid.train(docs.where("doc_id < 300"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == ("qq" if i % 2 else "zz") for i in range(300, 500))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred in ("qq", "zz") and 0 <= got[903].score <= 1
    assert langid.predict(none, model).count() == 0
    blank = langid.train(none.where("lang = 'x'"))
    assert {r.lang_pred for r in langid.predict(docs, blank).collect()} == {"und"}


def test_rare_language_keeps_its_entries(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    many = [" ".join(word("abcdefghijklmnopqrst") for _ in range(60)) for _ in range(60)]
    own = [word("бвгджзклмн") for _ in range(30)]
    few = [" ".join(rng.choice(own) for _ in range(20)) for _ in range(4)]
    data = [(i, t, lang) for i, (t, lang) in enumerate([(t, "aa") for t in many] + [(t, "zz") for t in few])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, max_words=40, max_grams=100, min_count=1)
    assert set(own) & set(" ".join(few).split()) <= set(model.words)
    chars = {c for t in many + few for c in t}
    assert {g for g in model.grams if len(g) == 1} == chars
    words = Counter(w for t in few for w in t.split())
    n_keys = len({w for t in many + few for w in t.split()})
    for w, n in words.items():
        assert abs(model.words[w][model.langs.index("zz")] - np.log((n + 0.5) / (words.total() + 0.5 * n_keys))) < 1e-4
    texts = [(900 + i, " ".join(word("бвгджзклмн") for _ in range(8))) for i in range(5)]
    got = langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert {r.lang_pred for r in got} == {"zz"}


def test_language_backoff_needs_no_known_word(spark):
    docs = spark.createDataFrame([(1, "haus maus laus", "de"), (2, "house mouse louse", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs, min_count=5)  # no word is frequent enough
    assert not model.words
    scorer = langid.Scorer(model, remember=2)
    assert scorer.predict("graus raus blaus")[0] == "de" and scorer.predict("spouse rouse douse")[0] == "en"


def test_language_model_takes_the_driver_few_bytes_a_key(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
    data = [(i, " ".join(word("abcdefgh" if i % 2 else "efghijkl") for _ in range(200)), "aa" if i % 2 else "zz") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    langid.train(docs.limit(1), min_count=1)  # what is loaded only once
    tracemalloc.start()
    model = langid.train(docs, min_count=1)
    size = len(pickle.dumps(model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = len(model.words) + len(model.grams)
    assert len(model.words) > 15_000 and len(model.grams) > 15_000
    assert size < 30 * keys and peak < 120 * keys + 1_000_000
    again = pickle.loads(pickle.dumps(model))
    some = list(model.words)[::997]
    assert list(again.words) == list(model.words) and all((again.words[w] == model.words[w]).all() for w in some)
    assert [langid.Scorer(again).predict(t) for _, t, _ in data[:4]] == [langid.Scorer(model).predict(t) for _, t, _ in data[:4]]


def test_components(spark):
    from wearhouse.llm.components import components

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
