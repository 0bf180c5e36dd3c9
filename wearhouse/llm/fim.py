"""Fill-in-the-middle transformation by ranks over a wavelet matrix (operator 12).

A text is cut into units; two cuts make prefix, middle and suffix, which are put
into the order that a model learns to fill from.  Where units end follows from
character classes alone: each character is white space or not, ends a unit or
not, ends a line or not, which makes one three-bit class.  A wavelet matrix over
the classes of all texts of a batch answers how often a class occurs before any
place; the ranks of the classes that end a unit add up to the number of units
that end there (``WaveletMatrix.before``), so a text's units are counted by two
rank queries, and both cuts of all texts are found at once by bisection on these
ranks.  No unit is ever split off as a string.

Which cuts and which order a document gets follows from a SHA-256 of seed and
doc_id alone, so a rerun, another layout or a lost executor changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, map_arrow, rows_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a character class.
SPACE, UNIT, LINE = 1, 2, 4
#: Characters that share one wavelet matrix (a longer text has its own).
CHARS = 1_000_000


class WaveletMatrix:
    """Rank queries over an array of small numbers below 2 ** ``bits``."""

    def __init__(self, values: np.ndarray, bits: int = 3):
        self.levels = []  # (packed words, ones before each word, zeros in all)
        for bit in reversed(range(bits)):
            one = (values >> bit & 1).astype(bool)
            padded = np.zeros((len(one) // 64 + 1) * 64, np.uint8)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, np.cumsum(ones) - ones, len(one) - int(ones.sum())))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, value: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs at the places from ``begin`` up to ``end``."""
        for depth, (words, before, zeros) in enumerate(self.levels):
            one = value >> (len(self.levels) - 1 - depth) & 1
            begin, end = (self._map(words, before, zeros, one, i) for i in (begin, end))
        return end - begin

    @staticmethod
    def _map(words: np.ndarray, before: np.ndarray, zeros: int, one: int, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        ones = before[i >> 6] + np.bitwise_count(words[i >> 6] & low).astype(np.int64)
        return zeros + ones if one else i - ones

    def before(self, values: list[int], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often any of ``values`` occurs: the sum of their ranks."""
        return sum(self.rank(v, begin, end) for v in values)

    def place(self, values: list[int], begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The first place up to which any of ``values`` occurs ``k`` times from
        ``begin`` on, at most ``end``, by bisection; ``begin`` for 0."""
        low, high = begin.copy(), end.copy()
        for _ in range(int(np.max(end - begin, initial=0)).bit_length()):
            mid = (low + high) // 2
            reached = self.before(values, begin, mid) >= k
            low, high = np.where(reached, low, np.minimum(mid + 1, high)), np.where(reached, mid, high)
        return high


def classes(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of every character; ``first`` marks the first one of each text.

    A unit (token) is white space and the run of other characters after it, or
    the white space at the end of a text; a line goes up to its line feed, or to
    the end of the text."""
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    last = np.append(first[1:], True)
    turns = ~space & np.append(space[1:], True)
    return space * SPACE + (turns | last) * UNIT + ((chars == 10) | last) * LINE


UNITS = {"token": [c for c in range(8) if c & UNIT], "line": [c for c in range(8) if c & LINE]}


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 for a document; a NULL id counts as no text."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(name[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(texts: list[str], drawn: np.ndarray, unit: str = "token") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, characters in front of the first cut, of the second) of each text;
    ``drawn`` holds a row of draws for each, whose first two choose the cuts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    begin = end - size
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(chars), bool)
    first[begin[size > 0]] = True
    matrix = WaveletMatrix(classes(chars, first))
    n = matrix.before(UNITS[unit], begin, end)
    ks = drawn[:, :2] % (n[:, None] + 1)

    def ends(k: np.ndarray) -> np.ndarray:
        return matrix.place(UNITS[unit], begin, end, k) - begin

    return n, ends(ks.min(1)), ends(ks.max(1))


def _packs(texts: list[str]) -> Iterator[range]:
    """Neighbouring texts of about ``CHARS`` characters together."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHARS:
            yield range(at, k)
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield range(at, len(texts))


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``rate`` percent of the documents are transformed, of these ``spm`` percent
    with the suffix first; ``unit`` is "token" or "line".  Empty and NULL texts
    and texts that hold one of the three marks stay plain: the output is the
    text (empty for NULL), the two lengths are NULL.  Repeated rows each come
    out, alike; rows that share only the doc_id draw the same numbers.  Other
    columns are not read; an empty table gives an empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            texts = [t or "" for t in texts]
            for pack in _packs(texts):
                own = [texts[i] for i in pack]
                drawn = np.array([draws(seed, ids[i]) for i in pack], np.int64)
                n, one, two = cut(own, drawn, unit)
                forms, prefix, middle, out = [], [], [], []
                for text, a, b, (_, _, h3, h4) in zip(own, one.tolist(), two.tolist(), drawn.tolist()):
                    plain = not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    form = "plain" if plain else "spm" if h4 % 100 < spm else "psm"
                    p, m, s = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
                    forms.append(form)
                    prefix.append(None if plain else a)
                    middle.append(None if plain else b - a)
                    out.append(text if plain else s + p + m if form == "spm" else p + s + m)
                yield emit(OUT, [ids[i] for i in pack], n, forms, prefix, middle, out)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a row's output was made of, from output and form alone: no
    part holds a mark, so each mark's first place is its own."""

    def part(mark: str, *nexts: str) -> Column:
        tail = F.substring_index(output, mark, -1)
        for other in nexts:
            tail = F.substring_index(tail, other, 1)
        return tail

    whole = F.concat(part(PREFIX, SUFFIX, MIDDLE), part(MIDDLE), part(SUFFIX, PREFIX, MIDDLE))
    return F.when(form == "plain", output).otherwise(whole)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), e AS (
  SELECT doc_id, t, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form,
         array_to_string(u[1:least(k1, k2)], '') AS a,
         array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS b,
         array_to_string(u[greatest(k1, k2) + 1:n], '') AS c
  FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
