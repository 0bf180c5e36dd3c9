"""The operators' inner methods against brute force, without Spark."""

from __future__ import annotations

import bisect
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest

from wearhouse.llm import common, fingerprint, linededup, neardup, packing, quality, toxicity, urlfilter
from wearhouse.llm.tokencount import TokenCounter


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng: random.Random, a: str, times: int, letters: str) -> str:
    b = list(a)
    for _ in range(times):
        kind = rng.random()
        if kind < 0.33 and b:
            b[rng.randrange(len(b))] = rng.choice(letters)
        elif kind < 0.66:
            b.insert(rng.randint(0, len(b)), rng.choice(letters))
        elif b:
            del b[rng.randrange(len(b))]
    return "".join(b)


def test_banded_distance():
    rng = random.Random(1)
    pairs, limits = [], []
    for _ in range(2500):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 60)))
        b = changed(rng, a, rng.randint(0, 9), "abcé") if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        pairs.append((a, b))
        limits.append(rng.choice([0, 1, 2, 3, 5, 8, 12, 31, 32, 33, 40]))
    want = [edits(a, b) <= t for (a, b), t in zip(pairs, limits)]
    assert linededup.close(pairs, np.array(limits)).tolist() == want
    assert linededup.close([], np.zeros(0, np.int64)).tolist() == []


def met(entries, tau: int, long: bool) -> int:
    return sum(len(a) for a, _ in linededup.within_keys(*entries, tau, 40, long, long))


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_lines_within_tau_meet(tau):
    rng = random.Random(tau)
    for _ in range(800):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(12, 20)))
        b = changed(rng, a, rng.randint(1, tau), "abé")
        assert a == b or met(linededup.Lines([a, b]).short(tau), tau, False), (a, b)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij "])
def test_long_lines_within_their_share_meet(letters):
    rng, tau, share = random.Random(5), linededup.TAU, linededup.SHARE
    sizes = [118, 119, 120, 121, 159, 160, 200, 410, 479, 480, 1023, 1700, 2047, 2048, 2060, 4090, 5200, 12_000]
    found = 0
    for _ in range(250):
        a = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        if rng.random() < 0.2:  # a few words, over and over
            a = "".join(rng.choice(["again ", "and ", "once"]) for _ in range(len(a) // 6 + 20))
        b = changed(rng, a, int(linededup.allowed(len(a), tau, share)), letters)
        least = min(len(a), len(b))
        if a == b or least < share * (tau + 1) - tau or not linededup.within(a, b, int(linededup.allowed(least, tau, share))):
            continue
        entries = linededup.Lines([a, b]).long(tau, share)
        assert met(entries, tau, True), (a, b)
        found += 1
        for divide in (linededup._by_side, linededup._by_place):  # and in the divided keys
            entries = divided(divide, entries)
            assert met_plainly(entries, tau), (divide, a, b)
    assert found > 120


def divided(divide, entries):
    """What ``divide`` makes of (key, name, code), without Spark."""
    import pyarrow as pa

    seen = {}

    def catch(_, run, __):
        batches = list(run(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in entries], names=["key", "name", "code"])])))
        seen["out"] = tuple(np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(3))

    kept, linededup.map_arrow = linededup.map_arrow, catch
    try:
        divide(None, 40)
    finally:
        linededup.map_arrow = kept
    return seen["out"]


def met_plainly(entries, tau: int) -> int:
    return sum(len(a) for a, _ in linededup.within_keys(*entries, tau, 40, True, False))


def test_template_lines_are_no_candidates():
    """One long common start and unlike ends: of 79,800 pairs almost none is looked at closely."""
    rng = random.Random(6)
    start = "".join(rng.choice("abcdefghij ") for _ in range(88))
    lines = [start + "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(100, 140))) for _ in range(400)]
    pairs = {p for a, b in linededup.within_keys(*linededup.Lines(lines).long(2, 40), 2, 40, True, True) for p in zip(a.tolist(), b.tolist())}
    assert len(pairs) < len(lines)


def test_alike_is_the_edit_distance():
    rng = random.Random(10)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    lines += [changed(rng, x, rng.randint(1, 6), "abcé") for x in lines]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    want = [edits(lines[x], lines[y]) <= max(2, min(len(lines[x]), len(lines[y])) // 10) for x, y in zip(i, j)]
    assert linededup.alike(lines, i, j, 2, 10).tolist() == want
    assert linededup._trimmed("abcde", "abXde") == ("c", "X") and linededup._trimmed("aaa", "aa") == ("a", "") and linededup._trimmed("", "b") == ("", "b")


def test_workers_give_memory_back_after_a_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "ship", lambda _: None)
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    frame = SimpleNamespace(sparkSession=None, mapInArrow=lambda run, _: run)
    task = common.map_arrow(frame, lambda batches: (b for b in batches), "x long")(iter([1, 2]))
    assert next(task) == 1 and not given
    assert list(task) == [2] and given == [1]


def brute_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Maximal scoring subsequences by their definition: recursively the best
    contiguous range, then left and right of it."""

    def best(lo: int, hi: int) -> list[tuple[int, int]]:
        top, where = 0.0, None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += scores[j]
                if s > top + 1e-9 or (where and abs(s - top) <= 1e-9 and j - i < where[1] - where[0]):
                    top, where = s, (i, j)
        return [] if where is None else best(lo, where[0]) + [where] + best(where[1] + 1, hi)

    return best(0, len(scores))


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(400):
        n, other = rng.randint(1, 25), -rng.uniform(0.1, 1.0)
        scored = [(i, rng.uniform(0.2, 3.0)) for i in range(n) if rng.random() < 0.4]
        scores = [dict(scored).get(i, other) for i in range(n)]
        got = toxicity.segments(scored, n, other)
        assert [(a, b) for _, a, b in got] == brute_segments(scores)
        for s, a, b in got:
            assert s == pytest.approx(sum(scores[a : b + 1]))


def test_token_counts_equal_the_library():
    counter = TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    signs = list(" \n\tab1é▁日😀　\x00\x85<s>/'") + ["  ", " the", "hello", "<s>", "</s>", "▁▁"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert counter.counts(texts) == [len(x) for x in counter.sp.encode(texts, num_threads=1)]


def test_token_table_may_overflow():
    counter = TokenCounter(public_tokenizers.path("piece_bpe_32k.model"), remember=16_000)
    texts = [f"word{i} other{i * 7} " + "x" * 100 + str(i) for i in range(600)]
    got = [n for i in range(0, 600, 50) for n in counter.counts(texts[i : i + 50])]
    assert got == [len(x) for x in counter.sp.encode(texts, num_threads=1)]


def test_packing_ids_equal_the_library():
    enc = packing.IdEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    signs = [" "] * 4 + list("\n\tab1é▁日😀　\x00\x85<'s!\x1c") + ["<|endoftext|>", "'ll", "   "]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert enc.ids(t) == np.array(enc.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 2048, 5000])
def test_cut(n):
    parts = packing.cut(n, 1024)
    assert sum(size for _, size in parts) == n and all(size == 1024 for _, size in parts[1:])
    assert [s for s, _ in parts] == list(np.cumsum([0] + [size for _, size in parts[:-1]]))


def unpack(places, n_sequences, cap):
    rooms: dict[int, list[tuple[int, int]]] = {}
    for length, lo, hi, first, offset in places:
        for k in range(hi - lo):
            rooms.setdefault(first + k, []).append((offset, length))
    assert sorted(rooms) == list(range(n_sequences))
    for row in rooms.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= cap


def best_fit(lengths, cap):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i < len(rooms):
            left = rooms.pop(i) - x
        else:
            left, n = cap - x, n + 1
        if left:
            bisect.insort(rooms, left)
    return n


@pytest.mark.parametrize("cap,n,groups", [(16, 40, 4), (64, 500, 64), (1024, 3000, 1024), (1024, 3000, 64)])
def test_plan_is_a_packing(cap, n, groups):
    rng = random.Random(n + groups)
    for _ in range(5):
        lengths = [rng.randint(1, cap - 1) for _ in range(n)]
        hist = Counter(lengths)
        places, total = packing.plan(hist, cap, groups)
        got = Counter()
        for length, lo, hi, _, _ in places:
            assert lo == got[length]
            got[length] += hi - lo
        assert got == hist
        unpack(places, total, cap)
        # rounding up costs at most one group's items; with a group per length, next to nothing
        spare = 0.01 * n if groups >= cap // 2 else -(-n // groups)
        assert total <= best_fit(lengths, cap) + spare + 1


def test_plan_of_nothing_and_of_one_length():
    assert packing.plan({}) == ([], 0)
    places, total = packing.plan({100: 25}, 1024)
    assert total == 3
    unpack(places, total, 1024)


def fits(glob: str, text: str) -> bool:
    out = "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in packing_tokens(glob))
    return re.fullmatch(out, text, re.S) is not None


def packing_tokens(glob):
    return urlfilter._tokens(glob)


def test_automaton_against_regexes():
    rng = random.Random(9)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))]
        machine = urlfilter.Automaton(tuple(urlfilter.Rule("block", g, g) for g in globs))
        urls = ["".join(rng.choice("ab/.c") for _ in range(rng.randint(0, 10))) for _ in range(40)]
        got = machine.match(urls)
        for i, u in enumerate(urls):
            for k, g in enumerate(globs):
                assert got[i, k] == fits(g, u), (g, u)


def test_host_and_path():
    assert urlfilter.host_of("HTTP://A.Org/X/Y?q#f") == ("a.org", "/X/Y")
    assert urlfilter.host_of("http://a.org?x/y") == ("a.org", "")
    assert urlfilter.host_of("a.org/x") == ("", "") == urlfilter.host_of(None)
    assert urlfilter.host_of("x://y://z") == ("y:", "//z")


def test_fingerprints_estimate_similarity():
    rng = random.Random(4)
    errors = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 400))]
        other = list(words)
        for _ in range(rng.randint(0, 30)):
            other[rng.randrange(len(other))] = f"v{rng.randrange(5000)}"
        a, b = " ".join(words), " ".join(other)
        x, y = (set(fingerprint.shingles(t).tolist()) for t in (a, b))
        errors.append(fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_fingerprint_corner_cases():
    f = fingerprint.fingerprint
    assert f(None) == f("") == f(" \n\t ") == b"" and len(f("one")) == fingerprint.BINS
    assert f("A b  C") == f("a B c") and f("É") != f("é")
    assert fingerprint.likeness(f("x"), f("x")) == 1.0 and fingerprint.likeness(f("x"), b"") == 0.0 and fingerprint.likeness(b"", b"") == 1.0
    assert fingerprint.edited("abcde", "XY") == "abcXY" and fingerprint.edited("abcdef", "X") == "abcX" and fingerprint.edited("", "x") == ""


def test_signatures_within_the_distance_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, neardup.COMPONENTS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.COMPONENTS, neardup.DISTANCE, replace=False)
        b[at] ^= np.uint16(1) + rng.integers(0, 1 << 15, neardup.DISTANCE).astype(np.uint16)
        assert set(neardup.entries(a).tolist()) & set(neardup.entries(b).tolist())


def test_factorisation_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, quality.WIDTH), np.float32)
    x[:, 1:3] = rng.choice([-1, 1], (2000, 2))
    y = (x[:, 1] * x[:, 2] > 0).astype(np.float32)  # no single input says anything
    m = quality.fit(x[:1500], y[:1500])
    assert ((m.scores(x[1500:]) >= 0.5) == (y[1500:] > 0)).mean() > 0.98
    z = m.inputs(x[:20])
    pairs = [m.w0 + z[i] @ m.w + sum(float(m.v[j] @ m.v[k]) * z[i, j] * z[i, k] for j in range(4) for k in range(j + 1, 4)) for i in range(20)]
    v0 = m.v.copy()
    v0[4:] = 0
    small = quality.Machine(m.mean, m.scale, m.w0, m.w, v0)
    assert np.allclose(small.logits(x[:20]), pairs, atol=1e-3)


def test_machine_without_rows_or_with_one_label():
    none = quality.fit(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0, np.float32))
    ones = quality.fit(np.ones((5, quality.WIDTH), np.float32), np.ones(5, np.float32))
    x = np.zeros((1, quality.WIDTH), np.float32)
    assert none.scores(x)[0] == pytest.approx(0.5) and ones.scores(x)[0] > 0.8


def test_features_of_odd_texts():
    f = quality.Features(remember=3)
    for t in (None, "", " \n ", "a", "x" * 100_000, "日本 \x00 é\n\n!!"):
        row = f.row(t)
        assert row.shape == (quality.WIDTH,) and np.isfinite(row).all()
    assert (f.row(None) == f.row(" ")).all()
