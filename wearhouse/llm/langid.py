"""Language identification by word-first backoff (operator 2).

Training counts every word of every training text per language.  A text's
words that the model knows are scored by their log frequency per language; an
unseen word falls back to character n-grams of the word with its borders: at
each place the longest known n-gram counts, and shorter and shorter ones where
none is known.  Every language has its own quota of its most frequent words and
n-grams (``max_words``, ``max_grams``), which bounds what workers hold; n-grams
of one and two characters are always kept.  Frequencies are shares of all that
was counted for a language, kept or not.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, fold, map_arrow, materialize, rows_of

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: N-grams up to this length are outside the quota.
SHORT = 2
#: Per language.
MAX_WORDS = 50_000
MAX_GRAMS = 60_000
MIN_COUNT = 3
#: Distinct entries a worker counts before it hands them on.
FLUSH = 300_000
#: Remembered unseen words per worker.
REMEMBER = 200_000
UNDETERMINED = "und"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of ``docs`` (text, lang)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield emit(schema, [lang] * len(c), list(c), list(c.values()))
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for langs, texts in rows_of(batches):
            for lang, text in zip(langs, texts):
                counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield from flush(counts)
        yield from flush(counts)

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = map_arrow(rows, run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of the bordered words, weighted by the words' counts."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def flush(sums: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, c in sums.items():
            yield emit(schema, [lang] * len(c), list(c), list(c.values()))
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        for langs, ws, ns in rows_of(batches, 4096):
            for lang, word, n in zip(langs, ws, ns):
                c, word = sums.setdefault(lang, {}), f" {word} "
                for k in ORDERS:
                    for i in range(len(word) - k + 1):
                        g = word[i : i + k]
                        c[g] = c.get(g, 0) + n
            if sum(map(len, sums.values())) > FLUSH:
                yield from flush(sums)
        yield from flush(sums)

    return map_arrow(counts.select("lang", "word", "n"), run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, key: str, langs: list[str], limit: int, least: int, always: int = 0) -> tuple[pa.Table, dict[int, tuple[int, dict[str, int]]]]:
    """The ``limit`` most frequent keys of every language, and all keys of at
    most ``always`` characters: (key, its order, its counts in all of ``langs``);
    number of all keys and all counts per language, by order (0: words)."""
    order = F.length(key) if always else F.lit(0)
    total = counts.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    total = materialize(total.withColumn("k", order))
    full: dict[int, tuple[int, dict[str, int]]] = {r.k: (r.keys, {}) for r in total.groupBy("k").agg(F.count("*").alias("keys")).collect()}
    for r in counts.groupBy(order.alias("k"), "lang").agg(F.sum("n").alias("n")).collect():
        full[r.k][1][r.lang] = r.n
    short = F.length(key) <= always
    rows = total.where((F.col("total") >= least) & ~short).select(key, F.explode("by_lang").alias("lang", "n"))
    crowded = [r.lang for r in rows.groupBy("lang").count().where(F.col("count") > limit).collect()]
    kept = rows.where(~F.col("lang").isin(crowded)).select(key)
    for lang in sorted(crowded):
        kept = kept.unionByName(rows.where(F.col("lang") == lang).orderBy(F.desc("n"), key).limit(limit).select(key))
    kept = total.join(kept.distinct(), key, "left_semi").unionByName(total.where(short & (F.col("total") >= least)))
    by_lang = [F.coalesce(F.element_at("by_lang", F.lit(lang)), F.lit(0).cast("long")) for lang in langs]
    return kept.select(F.col(key).alias("key"), "k", F.array(*by_lang).cast("array<long>").alias("n")).toArrow(), full


class Rows(Mapping):
    """Keys and their rows of a matrix.  Both lie in one piece each, and so they go
    to the workers; the places of the keys are looked up where they are first used,
    so the driver holds no object for a key."""

    def __init__(self, keys: pa.Array, rows: np.ndarray):
        self._keys, self.rows = keys, rows

    @functools.cached_property
    def at(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self._keys.to_pylist())}

    def __getstate__(self) -> dict:
        return {"_keys": self._keys, "rows": self.rows}

    def __len__(self) -> int:
        return len(self._keys)

    def __iter__(self) -> Iterator[str]:
        return iter(self.at)

    def __getitem__(self, key: str) -> np.ndarray:
        return self.rows[self.at[key]]


class Model:
    """Log frequencies per language of words and of n-grams of each order."""

    def __init__(self, words_: DataFrame, grams: DataFrame, max_words: int, max_grams: int, min_count: int):
        self.langs = sorted(r.lang for r in words_.select("lang").distinct().collect())
        self.words = self._logs(*_top(words_, "word", self.langs, max_words, min_count))
        self.grams = self._logs(*_top(grams, "gram", self.langs, max_grams, 1, SHORT))

    def _logs(self, kept: pa.Table, full: dict[int, tuple[int, dict[str, int]]], add: float = 0.5) -> Rows:
        keys, orders, n = (kept[c].combine_chunks() for c in ("key", "k", "n"))
        orders, m = orders.to_numpy(), n.flatten().to_numpy().reshape(len(kept), len(self.langs))
        rows = np.empty(m.shape, np.float32)
        for k, (n_keys, totals) in full.items():
            some = orders == k
            rows[some] = np.log((m[some] + add) / (np.array([totals.get(lang, 0) for lang in self.langs]) + add * n_keys))
        return Rows(keys, rows)


class Scorer:
    """One per worker task: adds up score rows of a text's words."""

    def __init__(self, model: Model, remember: int = REMEMBER):
        self.m, self.remember = model, remember
        self.rows = np.zeros((len(model.words) + remember + 1, max(1, len(model.langs))), np.float32)
        if model.words:
            self.rows[: len(model.words)] = model.words.rows
        self.at = dict(model.words.at)

    def backoff(self, word: str) -> np.ndarray:
        """Sum over the longest known n-grams that cover the bordered word."""
        word, out, i = f" {word} ", np.zeros(max(1, len(self.m.langs)), np.float32), 0
        at, rows = self.m.grams.at, self.m.grams.rows
        while i < len(word):
            step = 1
            for k in ORDERS:
                row = at.get(word[i : i + k]) if i + k <= len(word) else None
                if row is not None:
                    out, step = out + rows[row], k
                    break
            i += step
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        ws = words(text)
        if not self.m.langs or not ws or not (any(map(str.isalpha, ws)) or any(map(str.isalpha, "".join(ws)))):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.m.langs))
        for a in range(0, len(ws), 100_000):
            ids = []
            for w in ws[a : a + 100_000]:
                i = self.at.get(w)
                if i is None:
                    if len(self.at) >= len(self.rows) - 1:
                        total, ids = total + self.rows[ids].sum(0, dtype=np.float64), []
                        self.at = dict(self.m.words.at)
                    self.at[w] = i = len(self.at)
                    self.rows[i] = self.backoff(w)
                ids.append(i)
            total = total + self.rows[ids].sum(0, dtype=np.float64)
        p = np.exp((total - total.max()) / np.sqrt(len(ws)))
        best = int(p.argmax())
        return self.m.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, min_count: int = MIN_COUNT) -> Model:
    """A model from all rows of ``docs`` with text and lang."""
    counts = materialize(word_counts(docs))
    grams = materialize(gram_counts(counts))
    return Model(counts, grams, max_words, max_grams, min_count)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``.

    Text that is NULL, empty or has no letter: ``und`` with score 0; the same
    if there was nothing to learn from.  Ties go to the language that sorts
    first.  Repeated rows are each predicted; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for ids, texts in rows_of(batches):
            got = [scorer.predict(t) for t in texts]
            yield emit(schema, ids, [x for x, _ in got], [s for _, s in got])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold(F.col("doc_id"), 3) != 1))
    held = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")
