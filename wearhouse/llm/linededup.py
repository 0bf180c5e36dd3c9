"""Line dedup by a segment-partition edit join (operator 3).

Lines (of at least ``MIN_CHARS`` characters) are linked if their edit distance
is at most ``TAU``, or one edit for every ``SHARE`` characters of the shorter
line where that is more (``allowed``).  With t edits allowed, a line is split into
t + 1 even segments; of two linked lines the longer one holds some segment of the
shorter one unchanged, at about the same distance from both ends.  So every
line is entered under its own segments and probes with its substrings, and two
lines that meet are compared: an own segment on one side, a substring on the
other.  Nothing else pairs lines, and nothing is lost:

* Lines below SHARE * (TAU + 1) characters look up the few substrings that
  lengths and places allow; keys hold length, segment number and substring.
* Longer lines have too many such substrings (they grow with t^3).  A segment is
  entered under its anchor, the ``GRAM`` characters with the smallest hash in it,
  and a line probes with every substring that can be an anchor: those with the
  smallest hash of some window as long as the shortest segment that may meet it.
  A segment has ``room`` characters to the right or to the left of its anchor;
  these must be equal, too, so lines meet on GRAM + room characters.

A candidate must also pass the distances from both ends (together at most t
apart) and the character counts (``SIGNATURE``; together at most 2 t apart), all
held in the entries.  Then the texts are joined, and the banded bit-parallel edit
distance (``close``) decides, for many pairs at once in numpy.

Keys with many members are divided before any pair is made: by the characters
beside the anchor, then by place and length; what is still crowded is paired in
blocks of bounded size.  Of every line text, the first occurrence (by doc_id, text
hash, line number) stays, unless a line with an earlier first occurrence is
linked to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, map_arrow, materialize, rows_of
from wearhouse.llm.fingerprint import mix

TAU = 2
#: One edit for so many characters, and characters of an anchor.
SHARE = 40
GRAM = 12
MIN_CHARS = 24
#: Characters that are looked at in one go, members of a key per block, and
#: pairs that are looked at in one go.
CHARS = 500_000
BLOCK = 1024
PAIRS = 500_000
#: Members of an anchor that a task divides by the characters beside it itself.
CROWD = 50_000
#: Share of a document's characters in another one that makes it a copy.
COPY = 0.5
#: Pairs whose distances are computed side by side.
ROWS = 1024
#: Smaller neighbours of a line that are compared with it in one unit.
TEXTS = 512
#: Buckets of the characters' pairs that are counted before distances.
BAGS = 256
#: Lines a task remembers to have entered.
REMEMBER = 300_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SALT = np.uint64(0xD1B54A32D192ED03)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 2 * CHARS)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def segment(n: np.ndarray, i: np.ndarray | int, tau: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` of lines of ``n`` characters: even
    segments, the last ones one longer."""
    short, longer = n // (tau + 1), n % (tau + 1)
    extra = np.maximum(0, i - (tau + 1 - longer))
    return short * i + extra, short + (i >= tau + 1 - longer)


def lookups(tau: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift of the substring against the segment's
    start) of every lookup of a short line besides its own segments."""
    return [
        (less, i, x)
        for less in range(tau + 1)
        for i in range(tau + 1)
        for x in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)
        if (less, x) != (0, 0)
    ]


def allowed(n: np.ndarray | int, tau: int, share: int):
    """Edits allowed between lines of which the shorter has ``n`` characters."""
    return np.maximum(tau, n // share)


def shortest_segment(n: np.ndarray | int, tau: int, share: int):
    """Characters of the shortest segment of any line that may be linked to one of ``n``."""
    t = allowed(n, tau, share)
    return np.minimum(share * t, np.maximum(n, 1)) // (t + 1)


def room(tau: int, share: int) -> int:
    """Characters that every segment of a long line has beside its anchor, on one side."""
    return (share * (tau + 1) // (tau + 2) - GRAM) // 2


# An entry's code, from its high bits: 2 for the kind, 1 for lines of ``_WRAP`` or
# more characters, 7 for the allowed edits (of such lines: for the logarithm of
# the length, base ``_STEP``), 11 and 11 for the characters before and from the
# anchor on, modulo ``_WRAP``, 1 unused, 1 if the line has the key at several places;
# 6 counts of 5 bits (see ``may_be_close``).  Short lines: kind and 62 parities.
_TOP = 127  # of the 7 bits: as many or more
_STEP = 1.025
_MANY = 1 << 30
_WRAP = 2048
_BEFORE, _AFTER = 43, 32
_COUNTS, _COUNT = 6, 5
#: Kinds: a substring; a segment with room to the right of its anchor, to the left.
_PROBE, _RIGHT, _LEFT = 0, 1, 2
_EXT = 13  # bits of the characters' hash on each side, in the key's low bits


class Lines:
    """Names, codes and keys of a list of lines, all at once."""

    def __init__(self, lines: list[str]):
        self.name = np.fromiter((_hash64(x) for x in lines), np.int64, len(lines))
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.n) - self.n
        value = (self.chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _power(_BASE, len(self.chars)), dtype=np.uint64)])

    def _hash(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of ``n`` characters from ``at`` on (a place in all lines together)."""
        return (self.sums[at + n] - self.sums[at]) * _power(_BASE_INV, len(self.sums))[at]

    def _parity(self) -> np.ndarray:
        bit = np.uint64(1) << (self.chars % np.uint32(62)).astype(np.uint64)
        return np.bitwise_xor.reduceat(bit, self.start).view(np.int64)

    def _counts(self) -> np.ndarray:
        """``_COUNTS`` numbers of characters, modulo 2 ** ``_COUNT`` each, packed."""
        kind = (self.chars % np.uint32(_COUNTS)).astype(np.int64)
        out = np.zeros(len(self.n), np.int64)
        for k in range(_COUNTS):
            out |= np.add.reduceat((kind == k).astype(np.int64), self.start) % (1 << _COUNT) << _COUNT * k
        return out

    def short(self, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, name, code) of all segments and substrings of short lines."""
        keys, names, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.n):
            return keys[0], names[0], codes[0]
        parity = self._parity()
        for less, i, shift in [(0, i, 0) for i in range(tau + 1)] + lookups(tau):
            at, size = segment(self.n - less, i, tau)
            ok = (at + shift >= 0) & (at + shift + size <= self.n)
            tag = ((self.n - less) * 16 + i).astype(np.uint64) * _SALT
            key = mix(self._hash(np.where(ok, self.start + at + shift, 0), np.where(ok, size, 0)) + tag)
            keys.append(key[ok].view(np.int64))
            names.append(self.name[ok])
            codes.append((parity | (_RIGHT if (less, shift) == (0, 0) else _PROBE) << 62)[ok])
        return tuple(np.concatenate(x) for x in (keys, names, codes))

    def long(self, tau: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, name, code) of all anchors of long lines, those of their own
        segments marked."""
        out = [(np.zeros(0, np.int64),) * 3]
        if not len(self.n):
            return out[0]
        counts, edits = self._counts(), allowed(self.n, tau, share)
        beside, wide = room(tau, share), shortest_segment(self.n, tau, share) - GRAM + 1
        for w in np.unique(wide).tolist():
            mine = np.flatnonzero(wide == w)
            n, start = self.n[mine], self.start[mine]
            size = n - GRAM + 1
            first = np.cumsum(size) - size
            line = np.repeat(np.arange(len(n)), size)
            at = np.arange(size.sum()) - first[line]
            h = mix(self._hash(start[line] + at, GRAM))
            low = _slide(np.minimum, h, w)  # by the window's first place
            low[line[: len(low)] != line[w - 1 :]] = 0
            edge = np.zeros(w - 1, np.uint64)
            picked = h == _slide(np.maximum, np.concatenate([edge, low, edge]), w)
            kind = np.zeros(len(h), np.int64)
            # the smallest hash of every own segment, over the grams that lie in it
            t = edits[mine]
            owner = np.repeat(np.arange(len(n)), t + 1)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(t + 1) - t - 1, t + 1)
            begin, length = segment(n[owner], number, t[owner])
            a, grams = first[owner] + begin, length - GRAM + 1
            places = np.repeat(a - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
            least = np.minimum.reduceat(h[places], np.cumsum(grams) - grams)
            hit = h[places] == np.repeat(least, grams)
            places, offset = places[hit], (places - np.repeat(a, grams))[hit]
            kind[places] = np.where(np.repeat(length, grams)[hit] - offset - GRAM >= beside, _RIGHT, _LEFT)
            some = np.flatnonzero(picked | (kind != _PROBE))
            line, at, h, kind = line[some], at[some], h[some], kind[some]
            place, rest = start[line] + at, n[line] - at
            right = self._side(place + GRAM, rest - GRAM >= beside, beside)
            left = self._side(place - beside, at >= beside, beside)
            key = h >> np.uint64(2 * _EXT) << np.uint64(2 * _EXT) | right << np.uint64(_EXT) | left
            size = np.where(n < _WRAP, t, 0)
            if (n >= _WRAP).any():
                size[n >= _WRAP] = np.log(n[n >= _WRAP] / _WRAP) / np.log(_STEP)
            code = kind << 62 | (n[line] >= _WRAP).astype(np.int64) << 61 | np.minimum(size, _TOP)[line] << 54
            code |= at % _WRAP << _BEFORE | rest % _WRAP << _AFTER | counts[mine][line]
            out.append(_once(line, key.view(np.int64), self.name[mine][line], code))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _side(self, at: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
        h = mix(self._hash(np.where(fits, at, 0), np.where(fits, n, 0)) + _SALT)
        return np.where(fits, h, 0) >> np.uint64(64 - _EXT)


def _once(line: np.ndarray, key: np.ndarray, name: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, name, code) with one entry for each line, key and kind: repetitive
    lines have the same anchor at very many places."""
    kind = _kind(code)
    order = np.argsort(mix(key.view(np.uint64) + (line << 2 | kind).astype(np.uint64) * _SALT), kind="stable")
    line, key, name, code, kind = (x[order] for x in (line, key, name, code, kind))
    new = np.ones(len(key), bool)
    new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    return key[first], name[first], code[first] | (times > 1) * _MANY


def _slide(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """``f`` over every ``w`` neighbours."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def _circular(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    d = np.abs(x - y)
    return np.minimum(d, size - d)


def _long(code: np.ndarray) -> np.ndarray:
    return code >> 61 & 1 == 1


def _size(code: np.ndarray) -> np.ndarray:
    return code >> 54 & _TOP


_LONGEST = np.append(np.ceil(_WRAP * _STEP ** np.arange(1, _TOP + 1)).astype(np.int64), 1 << 40)


def _edits(code: np.ndarray, share: int) -> np.ndarray:
    """Allowed edits of the line, of the longest ones an upper bound."""
    return np.where(_long(code), _LONGEST[_size(code)] // share, _size(code))


def may_be_close(a: np.ndarray, b: np.ndarray, tau: int, share: int, long: bool) -> np.ndarray:
    """Do places and characters leave the lines within the allowed edits?"""
    if not long:
        return np.bitwise_count((a ^ b) & ((1 << 62) - 1)) <= 2 * tau
    t = np.minimum(_edits(a, share), _edits(b, share))
    moved = sum(_circular(a >> s & _WRAP - 1, b >> s & _WRAP - 1, _WRAP) for s in (_BEFORE, _AFTER))
    mask = (1 << _COUNT) - 1
    changed = sum(_circular(a >> _COUNT * k & mask, b >> _COUNT * k & mask, 1 << _COUNT) for k in range(_COUNTS))
    alike = ~(_long(a) & _long(b)) | (np.abs(_size(a) - _size(b)) <= 2)
    return alike & ((moved <= t) | ((a | b) & _MANY != 0)) & (changed <= 2 * t)


def _kind(code: np.ndarray) -> np.ndarray:
    return code >> 62 & 3


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the smaller name first; no line with itself."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    return a[new], b[new]


def _lengths(code: np.ndarray) -> np.ndarray:
    """Characters of a line, from ``_WRAP`` on in steps of their logarithm."""
    n = (code >> _BEFORE & _WRAP - 1) + (code >> _AFTER & _WRAP - 1)
    return np.where(_long(code), _WRAP + _size(code), n)


def _matches(group: np.ndarray, own: np.ndarray, name: np.ndarray, code: np.ndarray, tau: int, share: int, long: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of an own segment (``own``) with any entry of its group
    that is not much longer or shorter, ``PAIRS`` or so at a time."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    group = group[order]
    place = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])) * (4 * _WRAP)
    reach = np.zeros(len(place), np.int64)
    if long:
        place += _lengths(code[order])
        again = np.argsort(place, kind="stable")
        order, place = order[again], place[again]
        reach = np.minimum(_edits(code[order], share), 2 * _WRAP // share)
    name, code = name[order], code[order]
    mine = np.flatnonzero(own[order])
    low = np.searchsorted(place, place[mine] - reach[mine])
    high = np.searchsorted(place, place[mine] + reach[mine], side="right")
    size = np.cumsum(high - low)
    begin = 0
    while begin < len(mine):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + PAIRS, side="right")))
        n = (high - low)[begin:end]
        i = np.repeat(mine[begin:end], n)
        j = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        differ = name[i] != name[j]
        if long:  # the shorter line's segments are enough
            differ &= (place[i] < place[j]) | ((place[i] == place[j]) & ((name[i] < name[j]) | _long(code[i])))
        i, j = i[differ], j[differ]
        ok = may_be_close(code[i], code[j], tau, share, long)
        if ok.any():
            yield _distinct(name[i[ok]], name[j[ok]])
        begin = end


def within_keys(key: np.ndarray, name: np.ndarray, code: np.ndarray, tau: int, share: int, long: bool, sides: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs under the keys.  With ``sides`` a key's low bits are the
    characters beside the anchor, of which a segment compares those on its own side."""
    if not sides:
        yield from _matches(key, _kind(code) != _PROBE, name, code, tau, share, long)
        return
    yield from _matches(key >> _EXT, _kind(code) == _RIGHT, name, code, tau, share, long)
    other = key >> 2 * _EXT << _EXT | key & (1 << _EXT) - 1
    yield from _matches(other, _kind(code) == _LEFT, name, code, tau, share, long)


# -- the banded bit-parallel edit distance


def _common(a: str, b: str) -> int:
    """Characters that the lines have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # equal up to low, not up to high
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The lines without a common start and end, which cost no edits."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def _bags(lines: list[str]) -> np.ndarray:
    """Numbers of each line's pairs of neighbouring characters, by a hash."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    line = np.repeat(np.arange(len(lines)), n)
    inside = line[1:] == line[:-1]
    pair = ((chars[:-1] * np.uint32(0x9E3779B1) + chars[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(16)) % np.uint32(BAGS)
    return np.bincount(line[1:][inside] * BAGS + pair[inside], minlength=len(lines) * BAGS).reshape(-1, BAGS).astype(np.int32)


def alike(lines: list[str], i: np.ndarray, j: np.ndarray, tau: int, share: int) -> np.ndarray:
    """Which pairs (i, j) of the lines are within the allowed edits?  An edit
    changes at most four of the counts of ``_bags`` by one."""
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    bags = _bags(lines)
    for at in range(0, len(i), 2048):
        x, y = i[at : at + 2048], j[at : at + 2048]
        limits = allowed(np.minimum(n[x], n[y]), tau, share)
        ok = np.abs(n[x] - n[y]) <= limits
        ok[ok] = np.abs(bags[x[ok]] - bags[y[ok]]).sum(1) <= 4 * limits[ok]
        out[at : at + 2048] = ok
    good = np.flatnonzero(out)
    limits = allowed(np.minimum(n[i[good]], n[j[good]]), tau, share)
    at, size = 0, np.cumsum(n[i[good]] + n[j[good]])
    while at < len(good):  # some pairs of strings at a time
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 16 * CHARS)))
        some = good[at:end]
        out[some] = close([(lines[x], lines[y]) for x, y in zip(i[some].tolist(), j[some].tolist())], limits[at:end])
        at = end
    return out


def close(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Is the edit distance (in code points) of each pair at most its limit?

    Row i of column j is bit i - j + k of a word, k the limit: the band around
    the diagonal.  Bands of up to 63 bits run for many pairs at once, wider ones
    as Python integers.
    """
    out = np.zeros(len(pairs), bool)
    pairs = [_trimmed(a, b) for a, b in pairs]
    sizes = np.array([(max(len(a), len(b)), min(len(a), len(b))) for a, b in pairs], np.int64).reshape(-1, 2)
    fits = sizes[:, 0] - sizes[:, 1] <= limits
    order = np.argsort(sizes[:, 1], kind="stable")
    narrow = order[(fits & (limits < 32))[order]]
    for at in range(0, len(narrow), ROWS):
        some = narrow[at : at + ROWS]
        out[some] = _narrow([pairs[i] for i in some], sizes[some], limits[some])
    for i in np.flatnonzero(fits & (limits >= 32)):
        out[i] = _wide(*pairs[i], int(limits[i]))
    return out


def _narrow(pairs: list[tuple[str, str]], sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    k, count = int(limits.max()), len(pairs)
    wide = 32 if k < 16 else 64  # places that are looked at in a column
    width = int(sizes[:, 0].max())
    # the longer lines as columns of characters, with k places in front of them
    a = np.full((count, width + k + 65), 0xFFFFFFFF, np.uint32)
    b = np.full((count, int(sizes[:, 1].max()) + 1), 0xFFFFFFFE, np.uint32)
    for row, (x, y) in enumerate(pairs):
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        a[row, k : k + len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        b[row, : len(y)] = np.frombuffer(y.encode("utf-32-le"), np.uint32)
    band = np.uint64((1 << 2 * k + 1) - 1)
    top, one = np.uint64(1 << 2 * k), np.uint64(1)
    alive = np.arange(count)
    longer, shorter = sizes[:, 0], sizes[:, 1]
    score = np.zeros(count, np.int64)
    vp = np.full(count, band ^ np.uint64((1 << k + 1) - 1), np.uint64)  # column 0: one more in every row below 0
    vn = np.zeros(count, np.uint64)
    out = np.zeros(count, bool)

    def finish(rows: np.ndarray) -> None:
        extra = (longer - shorter)[alive[rows]]
        below = ((one << extra.astype(np.uint64)) - one) << np.uint64(k + 1)
        far = score[rows] + np.bitwise_count(vp[rows] & below).astype(np.int64) - np.bitwise_count(vn[rows] & below)
        out[alive[rows]] = far <= limits[alive[rows]]

    column = 0
    while len(alive):
        ended = shorter[alive] == column
        hopeless = score - (longer - shorter)[alive] > limits[alive]
        if ended.any() or (column % 16 == 0 and hopeless.any()):
            finish(np.flatnonzero(ended))
            going = ~(ended | hopeless)
            alive, score, vp, vn, a, b = (x[going] for x in (alive, score, vp, vn, a, b))
            if not len(alive):
                break
        equal = np.packbits(a[:, column : column + wide] == b[:, column, None], axis=1, bitorder="little").view(f"<u{wide // 8}").ravel() & band
        vp, vn = vp >> one | top, vn >> one
        zero = (((equal & vp) + vp) ^ vp) | equal | vn  # diagonal steps that cost nothing
        score += (zero >> np.uint64(k) & one ^ one).astype(np.int64)
        right, back = (vn | ~(zero | vp)) << one | one, (vp & zero) << one
        vp, vn = (back | ~(zero | right)) & band, right & zero & band
        column += 1
    return out


def _wide(x: str, y: str, k: int) -> bool:
    if len(x) < len(y):
        x, y = y, x
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    band, top = (1 << 2 * k + 1) - 1, 1 << 2 * k
    score, vp, vn, spare = 0, band ^ ((1 << k + 1) - 1), 0, len(x) - len(y)
    for j, c in enumerate(y):
        seen = where.get(c, 0)
        equal = (seen >> j - k if j >= k else seen << k - j) & band
        vp, vn = vp >> 1 | top, vn >> 1
        zero = ((((equal & vp) + vp) ^ vp) | equal | vn) & band
        score += ~zero >> k & 1
        if score - spare > k:
            return False
        right, back = (vn | ~(zero | vp)) << 1 | 1, (vp & zero) << 1
        vp, vn = (back | ~(zero | right)) & band, right & zero & band
    below = ((1 << spare) - 1) << k + 1
    return score + (vp & below).bit_count() - (vn & below).bit_count() <= k


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Is the edit distance (in code points) at most ``tau``?"""
    return bool(close([(a, b)], np.array([tau]))[0])


# -- over tables


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list, list[str]]]:
    """Lists of (doc_id, text hash, line number, length) and of the lines, about
    ``CHARS`` characters at a time.  A document also gives a place with line
    number -1, its number of lines as the length, and the empty line."""
    places, lines, size = [], [], 0
    for ids, hashes, texts in rows_of(batches, 128):
        for doc, th, text in zip(ids, hashes, texts):
            own = [(k, x) for k, x in enumerate((text or "").split("\n")) if len(x) >= least]
            places.append((doc, th, -1, len(own)))
            lines.append("")
            for k, line in own:
                places.append((doc, th, k, len(line)))
                lines.append(line)
                size += len(line)
                if size > CHARS:
                    yield places, lines
                    places, lines, size = [], [], 0
    if places:
        yield places, lines


def _hash64(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def _hash128(line: str) -> tuple[int, int]:
    """Two halves; the first is the name in the join."""
    h = xxhash.xxh64_intdigest(line.encode(), 7)
    return _hash64(line), h - (1 << 64) if h >> 63 else h


OCCURRENCES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line_no", pa.int32()), ("n", pa.int32()), ("line", pa.int64()), ("line2", pa.int64())])


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, line_no, n, line, line2) of every line of at least ``least``
    characters, the last two its 128-bit hash; a row with line_no -1 for every
    document has their number as n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, lines in _chunks(batches, least):
            h = [_hash128(x) if x else (None, None) for x in lines]
            yield emit(OCCURRENCES, *zip(*places), [x for x, _ in h], [y for _, y in h])

    return map_arrow(_keyed(docs), run, "doc_id long, th long, line_no int, n int, line long, line2 long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


_ENTRY = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("code", pa.int64())])
_ENTRY_SQL = "key long, name long, code long"


def _record(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _entries(docs: DataFrame, least: int, tau: int, share: int, long: bool) -> DataFrame:
    """(key, name, code) of shorter or of longer lines; a pair of which the
    shorter is below both borders is found among the shorter ones."""
    border = share * (tau + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a frequent line enters once per task (and per REMEMBER lines)
        for _, lines in _chunks(batches, least):
            lines = dict.fromkeys(x for x in lines if x and (len(x) >= border - tau if long else len(x) < border))
            new = []
            for x in lines:
                h = _hash64(x)
                if h not in seen:
                    new.append(x)
                    seen.add(h)
            if len(seen) > REMEMBER:
                seen.clear()
            if new:
                found = Lines(new)
                yield _record(_ENTRY, *(found.long(tau, share) if long else found.short(tau)))

    return map_arrow(_keyed(docs), run, _ENTRY_SQL)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("code", pa.int64())])
_FOUND_SQL = "a long, b long, key long, code long"


def _meet(entries: DataFrame, tau: int, share: int, long: bool, sides: bool) -> DataFrame:
    """Candidate pairs (a, b) of every key; the members of a key with more than
    ``BLOCK`` of them (with ``sides``: ``CROWD``) come out singly (a, NULL, key, code)."""
    bits = 2 * _EXT if sides else 0
    limit = CROWD if sides else BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64),) * 3
        crowded = None  # the key whose members already came out singly

        def work(k: np.ndarray, name: np.ndarray, code: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, crowded
            group = k >> bits
            cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            alone = np.diff(np.append(cut, len(k))) == 1
            alone[-1] &= last
            if crowded is not None:
                alone &= group[cut] != crowded
            keep = np.ones(len(k), bool)
            keep[cut[alone]] = False  # keys that only one line has
            k, name, code = k[keep], name[keep], code[keep]
            order = np.lexsort((code, name, k))
            k, name, code = k[order], name[order], code[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (name[1:] != name[:-1]) | (code[1:] != code[:-1])
            k, name, code = k[new], name[new], code[new]
            rest = tuple(x[:0] for x in (k, name, code))
            if not len(k):
                return
            group = k >> bits
            cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            size = np.diff(np.append(cut, len(k)))
            crowd = size > limit
            if crowded is not None:
                crowd |= group[cut] == crowded
            if crowd[-1]:
                crowded = group[-1]
            ready = np.repeat(~crowd, size)
            if not last and not crowd[-1]:
                rest = tuple(x[cut[-1] :] for x in (k, name, code))
                ready[cut[-1] :] = False
            many = np.repeat(crowd, size)
            if many.any():
                n = int(many.sum())
                yield pa.RecordBatch.from_arrays([pa.array(name[many]), pa.nulls(n, pa.int64()), pa.array(k[many]), pa.array(code[many])], schema=_FOUND)
            for a, b in within_keys(k[ready], name[ready], code[ready], tau, share, long, sides):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], schema=_FOUND)

        for batch in batches:
            now = tuple(np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns))
            if len(now[0]):
                yield from work(*now, False)
        if len(rest[0]):
            yield from work(*rest, True)

    dealt = entries.repartition(F.shiftright("key", bits)) if bits else entries.repartition("key")
    return map_arrow(dealt.sortWithinPartitions("key"), run, _FOUND_SQL)


def _by_side(members: DataFrame, share: int) -> DataFrame:
    """(key, name, code) of crowded anchors' members by the characters beside
    them: a segment on its own side, a substring on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, name, code = (c.to_numpy() for c in batch.columns)
            gram = (key >> 2 * _EXT).view(np.uint64) * _SALT
            for side, low in ((_RIGHT, key >> _EXT & (1 << _EXT) - 1), (_LEFT, key & (1 << _EXT) - 1)):
                own = _kind(code) == side
                marked = code & ((1 << 62) - 1) | own.astype(np.int64) << 62
                yield _record(_ENTRY, mix(gram + (low << 2 | side).astype(np.uint64)).view(np.int64), name, marked)

    return map_arrow(members, run, _ENTRY_SQL)


def _by_place(members: DataFrame, share: int) -> DataFrame:
    """(key, name, code) of crowded members by place and length: two lines whose
    distances from both ends allow their edits share a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, name, code = (c.to_numpy() for c in batch.columns)
            t, n = _edits(code, share), _lengths(code)
            many = code & _MANY != 0

            def entered(cell: np.ndarray, some: np.ndarray, code: np.ndarray = code) -> pa.RecordBatch:
                named = mix(key.view(np.uint64) + cell.astype(np.uint64) * _SALT).view(np.int64)
                return _record(_ENTRY, named[some], name[some], code[some])

            # by length alone only lines with several places meet the others
            marked = code & ((1 << 62) - 1) | many.astype(np.int64) << 62
            for up in (0, 1):  # lines of one band of allowed edits, or of neighbouring ones
                band = np.frexp(np.minimum(t, _WRAP))[1].astype(np.int64) + up
                before = (code >> _BEFORE & _WRAP - 1) >> band
                for x in (0, 1):
                    yield entered(1 << 40 | band << 26 | (n >> band) + x, n < _WRAP, marked)
                    for y in (0, 1):
                        yield entered(band << 26 | before + x << 13 | (n >> band) + y, (n < _WRAP) & ~many)
            yield entered(np.full(len(key), 1 << 41), n + t >= _WRAP)  # the places of long lines wrap: one cell

    return map_arrow(members, run, _ENTRY_SQL)


def _blocks(members: DataFrame, tau: int, share: int, long: bool) -> DataFrame:
    """Candidate pairs (a, b) of keys that are still crowded: every two blocks
    of a key's members are one unit of work."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unit(names: list[int], codes: list[int], homes: list[int]) -> Iterator[pa.RecordBatch]:
        name, code, home = np.array(names, np.int64), np.array(codes, np.int64), np.array(homes, np.int64)
        own = _kind(code) != _PROBE
        for x, y in ((home.min(), home.max()), (home.max(), home.min())):
            left, right = np.flatnonzero(own & (home == x)), np.flatnonzero(home == y)
            step = max(1, PAIRS // max(1, len(right)))
            for at in range(0, len(left), step):
                i = np.repeat(left[at : at + step], len(right))
                j = np.tile(right, len(left[at : at + step]))
                ok = (name[i] != name[j]) & may_be_close(code[i], code[j], tau, share, long)
                if ok.any():
                    yield _record(schema, *_distinct(name[i[ok]], name[j[ok]]))
            if x == y:
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, ([], [], [])
        for key, i, j, *row in rows_of(batches, 8192):
            for where, *values in zip(zip(key, i, j), *row):
                if where != now:
                    if now is not None:
                        yield from unit(*rows)
                    now, rows = where, ([], [], [])
                for column, v in zip(rows, values):
                    column.append(v)
        if now is not None:
            yield from unit(*rows)

    n = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    units = (
        members.join(n, "key")
        .withColumn("home", F.pmod(F.xxhash64("name"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "name", "code", "home")
    )
    return map_arrow(units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def _units(pairs: DataFrame) -> DataFrame:
    """(unit, a, b): the pairs (a < b) dealt into units that share lines, so that a
    line's text is sent to few places.  Of lines that many pairs connect, most have
    the same smallest neighbour; a line with many smaller neighbours has them
    cut into blocks, and so are the lines on the other side."""
    smaller = Window.partitionBy("b")
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*").over(smaller) / TEXTS)))).cast("long")
    dealt = pairs.select("a", "b", F.min("a").over(smaller).alias("hub"), blocks.alias("blocks"))
    i, j = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
    return dealt.select(F.xxhash64("hub", "blocks", i, j).alias("unit"), "a", "b")


_PLACE = [("doc_id", pa.int64()), ("th", pa.int64()), ("line_no", pa.int32())]
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())] + [(f"{side}_{n}", t) for side in "ab" for n, t in _PLACE])
_LINK_SQL = ", ".join(["a long, b long"] + [f"{side}_doc_id long, {side}_th long, {side}_line_no int" for side in "ab"])


def _verify(pairs: DataFrame, texts: DataFrame, tau: int, share: int) -> DataFrame:
    """The candidate pairs within the allowed edits, each once: the uids a < b of
    two lines and the first occurrence of each."""

    def judged(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        place = {s[0]: k for k, s in enumerate({s[0]: s for p in pairs for s in p}.values())}
        lines = list({s[0]: s[4] for p in pairs for s in p}.values())
        i, j = (np.fromiter((place[p[k][0]] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
        good = np.flatnonzero(alike(lines, i, j, tau, share))
        rows = [sorted((pairs[k][0][:4], pairs[k][1][:4]), key=lambda r: r[0]) for k in good]
        return emit(_LINK, *(list(c) for c in zip(*((a[0], b[0], *a[1:], *b[1:]) for a, b in rows)))) if rows else emit(_LINK, *[[]] * len(_LINK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}  # a unit's texts come first: name -> its lines (uid, place, text)
        todo, size = [], 0
        for unit, a, b, *line in rows_of(batches, 4096):
            for u, x, y, *own in zip(unit, a, b, *line):
                if u != now:
                    now, held = u, {}
                if y is None:
                    held.setdefault(x, []).append(tuple(own))
                    continue
                for s in held[x]:
                    for t in held[y]:
                        if s[0] != t[0]:
                            todo.append((s, t))
                            size += len(s[4]) + len(t[4])
                if size > 8 * CHARS:
                    yield judged(todo)
                    todo, size = [], 0
        if todo:
            yield judged(todo)

    units = materialize(_units(pairs))
    wanted = units.select("unit", F.col("a").alias("name")).unionByName(units.select("unit", F.col("b").alias("name"))).distinct()
    columns = ["uid", "doc_id", "th", "line_no", "text"]
    rows = wanted.join(texts, "name").select("unit", F.col("name").alias("a"), F.lit(None).cast("long").alias("b"), *columns)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    dealt = rows.unionByName(units.select("unit", "a", "b", *none)).repartition("unit")
    dealt = dealt.sortWithinPartitions(F.col("unit"), F.col("b").asc_nulls_first())
    return map_arrow(dealt, run, _LINK_SQL).distinct()


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, uid, first occurrence, text) of the wanted lines."""
    d, w = _keyed(docs).alias("d"), wanted.alias("w")
    rows = d.join(w, F.expr("d.doc_id <=> w.doc_id AND d.th = w.th"))
    return rows.select("w.name", "w.uid", "w.doc_id", "w.th", "w.line_no", F.element_at(F.split("d.text", "\n"), F.col("w.line_no") + 1).alias("text")).distinct()


def _candidates(docs: DataFrame, least: int, tau: int, share: int, long: bool) -> DataFrame:
    """(a, b): names of lines that meet."""

    def parts(met: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = materialize(met)
        return met.where("key IS NULL").select("a", "b"), met.where("key IS NOT NULL").select("key", F.col("a").alias("name"), "code").distinct()

    pairs, crowded = parts(_meet(_entries(docs, least, tau, share, long), tau, share, long, long))
    for divide in (_by_side, _by_place) if long else ():
        more, crowded = parts(_meet(divide(crowded, share), tau, share, long, False))
        pairs = pairs.unionByName(more)
    return pairs.unionByName(_blocks(crowded, tau, share, long))


def line_links(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, distinct lines, links): links are pairs (a, b) of uids of
    different lines within the allowed edits, each pair once, with the first
    occurrence of both."""
    if shortest_segment(share * (tau + 1), tau, share) < GRAM + 2 or least < tau + 1:
        raise ValueError(f"one edit for {share} characters, or {tau} in {least}, is too much for segments of {GRAM}")
    places = materialize(occurrences(docs, least))
    lines = places.where("line_no >= 0").groupBy("line", "line2", "n").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count("*").alias("times"))
    lines = materialize(lines.withColumn("uid", F.monotonically_increasing_id()))
    pairs = _candidates(docs, least, tau, share, False).unionByName(_candidates(docs, least, tau, share, True))
    # different lines of one name are compared, too
    namesakes = lines.groupBy("line").count().where("count > 1").select(F.col("line").alias("a"), F.col("line").alias("b"))
    pairs = materialize(pairs.unionByName(namesakes).distinct())
    names = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    wanted = lines.join(names, "line", "left_semi").select(F.col("line").alias("name"), "uid", "first.*")
    return places, lines, materialize(_verify(pairs, materialize(_line_texts(docs, wanted)), tau, share))


def _marks(docs: DataFrame, tau: int, least: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(occurrences, marks): marks hold every occurrence that is linked or that
    repeats an earlier one (doc_id, th, line_no, n, links, is_near, again,
    class_id), ``source`` being the earliest document with such a line before it."""
    places, lines, links = line_links(docs, tau, least, share)
    # a link tells either line where the other one first occurs
    sides = [links.select(F.col(x).alias("uid"), F.struct(*(F.col(f"{y}_{c}").alias(c) for c, _ in _PLACE)).alias("before")) for x, y in ("ab", "ba")]
    near = sides[0].unionByName(sides[1]).groupBy("uid").agg(F.count("*").alias("links"), F.min("before").alias("before"))
    told = lines.join(near, "uid", "left").where("times > 1 OR links IS NOT NULL").select("line", "line2", "n", "first", "before", "links")
    here = F.struct("doc_id", "th", "line_no")
    earliest = F.least("first", "before")
    marks = places.where("line_no >= 0").join(told, ["line", "line2", "n"]).select(
        "doc_id", "th", "line_no", "n", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce(F.col("before") < F.col("first"), F.lit(False)).alias("is_near"), (here != F.col("first")).alias("again"),
        F.least("first.doc_id", "before.doc_id").alias("class_id"),
        F.struct(earliest["doc_id"].alias("doc_id"), earliest["th"].alias("th")).alias("source"),
    ).distinct()
    return places, marks


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS, share: int = SHARE) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_exact, n_near, n_links, class_id, dropped)
    for every document of ``docs``.

    n_lines: lines of at least ``least`` characters; shorter ones are left
    alone.  n_exact: dropped repeats of an equal line; n_near: dropped lines
    with an earlier line within the allowed edits (``allowed``); ``dropped``: their line numbers
    from 0, sorted.  n_links: links of its lines to different lines.  class_id:
    the smallest doc_id among the first occurrences of its lines and of the
    lines they link to, itself included.  NULL and empty texts have no lines.
    Rows equal in doc_id and text are one document; rows that share only the
    doc_id are told apart by their text hash.  A NULL doc_id sorts first.
    Other columns are not read.
    """
    places, marks = _marks(docs, tau, least, share)
    gone = F.col("is_near") | F.col("again")
    zero = F.lit(0).cast("long")
    told_rows = marks.select(
        "doc_id", "th", zero.alias("lines"), (F.col("again")).cast("long").alias("exact"), (F.col("is_near") & ~F.col("again")).cast("long").alias("near"),
        "links", "class_id", F.when(gone, F.col("line_no")).alias("line_no"),
    )
    base = places.where("line_no < 0").select("doc_id", "th", F.col("n").cast("long").alias("lines")).distinct()
    base = base.select("doc_id", "th", "lines", zero.alias("exact"), zero.alias("near"), zero.alias("links"), F.col("doc_id").alias("class_id"), F.lit(None).cast("int").alias("line_no"))
    return (
        base.unionByName(told_rows)
        .groupBy("doc_id", "th")
        .agg(
            F.sum("lines").alias("n_lines"), F.sum("exact").alias("n_exact"), F.sum("near").alias("n_near"), F.sum("links").alias("n_links"),
            F.min("class_id").alias("class_id"), F.sort_array(F.collect_set("line_no")).alias("dropped"),
        )
        .withColumnRenamed("th", "text_hash")
    )


def _gone(docs: DataFrame, tau: int, least: int, share: int) -> DataFrame:
    """(__id, __th, __dropped, __copied): the lines to drop of every document that
    has some, and the most characters of them that one other document has."""
    _, marks = _marks(docs, tau, least, share)
    by_source = marks.where("is_near OR again").groupBy("doc_id", "th", "source").agg(F.collect_set("line_no").alias("lines"), F.sum("n").alias("chars"))
    own = F.struct("doc_id", "th").eqNullSafe(F.col("source"))
    return by_source.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(
        F.flatten(F.collect_list("lines")).alias("__dropped"), F.coalesce(F.max(F.when(~own, F.col("chars"))), F.lit(0)).alias("__copied")
    )


def drop_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS, share: int = SHARE, copy: float = COPY) -> DataFrame:
    """The rows of ``docs``, all columns, without the dropped lines (``n_chars``
    follows the text where there is such a column).  Rows of which nothing but
    white space is left, while there was more, go.  A row of which one earlier
    document has ``copy`` or more (as a share of its characters) in equal or near
    lines, but not all, is a copy rather than a text with repeated lines: it is
    left whole for the dedup of documents to judge, which a remnant would escape."""
    gone = _gone(docs, tau, least, share)
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    rows = rows.withColumn("__left", left).where(F.col("__dropped").isNull() | F.col("__left").rlike(r"\S"))
    whole = F.col("__copied") >= copy * F.length("text")
    rows = rows.withColumn("__dropped", F.when(~whole, F.col("__dropped")))
    rows = rows.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.col("__left")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
