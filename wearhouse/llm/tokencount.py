"""Token counts by the whole-token shortcut (operator 9).

A SentencePiece BPE text is a dummy blank plus the text, blanks written as one
mark.  When no vocabulary string holds a blank mark behind another character,
no merge can cross the border in front of a blank run, so a text's count is the
sum over its blank-led pre-tokens.  Per worker, once: every vocabulary string
that encodes alone as its own single token is proven by encoding it and goes
into a table; matching pre-tokens count 1 directly and only the rest are
merged (each distinct one once, remembered in a bounded table).

Texts where the borders are not certain (a literal blank mark, or characters
the model's normaliser rewrites) are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wearhouse.llm.common import documents, emit, rows_of, map_arrow

MARK = "▁"
#: Remembered pre-tokens per worker; the table starts anew when it is full.
REMEMBER = 400_000
#: Longer pre-tokens are merged without being remembered.
LONGEST = 64


class TokenCounter:
    """Counts tokens of whole texts; one per Python worker."""

    def __init__(self, model: str, remember: int = REMEMBER):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.remember = remember
        size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(size)]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        words = [(i, p[1:]) for i, p in enumerate(pieces) if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        alone = self.sp.encode([w for _, w in words], num_threads=1)
        self.whole = {w: 1 for (i, w), ids in zip(words, alone) if ids == [i]}
        if MARK in pieces:
            self.whole[""] = 1  # a single blank at the end of a text
        else:
            self.splits = False
        self.known = dict(self.whole)
        self.odd = re.compile(f"[^{self._plain()}]")
        self.runs = re.compile(" +[^ ]*")

    def _plain(self) -> str:
        """Ranges, as a regex class body, of the characters proven to pass the
        normaliser as they are (so none of them turns into a blank)."""
        chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) != MARK]
        tried = [f"x{c}x" for c in chars]
        kept = self.sp.decode(self.sp.encode(tried, num_threads=1))
        good = [ord(c) for c, t, k in zip(chars, tried, kept) if t == k]
        ranges: list[list[int]] = []
        for c in good:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in ranges)

    def _words(self, text: str) -> list[str] | None:
        """The blank-led pre-tokens of a text, each without its first blank;
        None if the text has to be encoded whole."""
        if not self.splits or self.odd.search(text):
            return None
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [run[1:] for run in self.runs.findall(" " + text)]
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  Unknown pre-tokens of the batch are merged
        together, each distinct one once."""
        words = [self._words(t) if t else [] for t in texts]
        known = self.known
        new = {w for ws in words if ws for w in ws if w not in known}
        long = {w for w in new if len(w) > LONGEST}
        if len(known) + len(new) > self.remember:
            known = self.known = dict(self.whole)
            new = {w for ws in words if ws for w in ws if w not in known}
        merged = list(new)
        known.update(zip(merged, map(len, self.sp.encode(merged, num_threads=1))))
        out = [len(self.sp.encode(t, num_threads=1)) if ws is None else sum(map(known.__getitem__, ws)) for t, ws in zip(texts, words)]
        for w in long:
            known.pop(w, None)
        return out


_counters: dict[str, TokenCounter] = {}


def _counter(model: str) -> TokenCounter:
    if model not in _counters:
        _counters[model] = TokenCounter(model)
    return _counters[model]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    NULL or empty text: 0 bytes, 0 tokens.  Repeated rows are each counted;
    other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for ids, texts in rows_of(batches):
            texts = [t or "" for t in texts]
            n = counter.counts(texts)
            yield emit(SCHEMA, ids, [len(t.encode()) for t in texts], n, [x > limit for x in n])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
