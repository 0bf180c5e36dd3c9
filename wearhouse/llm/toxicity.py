"""Toxicity by maximum-scoring segments (operator 1).

* Tokens: a word counts as its longest known form, the whole word or a prefix
  of ``PREFIXES`` letters, so that unseen forms of a toxic stem are found.
* Token scores: log-odds of a form in toxic against clean training texts, with
  an informative Dirichlet prior from the word counts of *all* documents, less
  half their standard deviation.  Forms whose counts do not differ significantly
  (signed root of the likelihood ratio) are unknown; words without a known
  form share one slightly negative score.
* Passages: a linear-time scan over the word scores finds all maximal-scoring
  segments of a text (each toxic passage, whole and disjoint).
* Calibration: segment scores of chance texts follow an extreme-value law,
  E = K n exp(-lambda S); lambda solves sum p exp(lambda s) = 1 over the
  words of clean texts.  A text's evidence is the sum of log(1/E) over its significant
  segments, mapped to a probability by a logistic curve.  The curve is fitted
  to one training fold, the lexicon to the others, so that words that differ
  by chance do not look better than they are.

The labelled sample is bounded (``max_rows``), and with it the lexicon, which
holds words of its toxic texts only; counts cover all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, fold, label_sample, map_arrow, materialize, rows_of, table

WORD = re.compile(r"[^\W\d_]+")
MAX_ROWS = 20_000
#: Weight of the prior as a share of the labelled words, and the least signed
#: root of a term's likelihood ratio.
PRIOR = 0.1
LEAST_Z = 4.5
#: Lengths of the prefixes that count as forms; a whole word ends with END.
PREFIXES = (3, 4, 5, 6, 7)
END = "$"
#: Karlin-Altschul's K, and the E below which a segment is significant.
K = 0.1
MOST_E = 0.5
FLUSH = 400_000
#: Words a worker remembers the score of.
REMEMBER = 300_000
BINS = 256


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(word, n, n1, n0): in how many documents a word occurs, over all, and
    over the sampled toxic and clean training texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n1", pa.int64()), ("n0", pa.int64())])

    def flush(every: Counter, by: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        every = every + by[0] + by[1]
        yield emit(schema, list(every), list(every.values()), [by[1][w] for w in every], [by[0][w] for w in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, by = Counter(), {0: Counter(), 1: Counter()}
        for texts, labels in rows_of(batches):
            for text, y in zip(texts, labels):
                (every if y is None else by[int(y > 0)]).update(set(words(text)))
            if len(every) > FLUSH:
                yield from flush(every, by)
                every, by = Counter(), {0: Counter(), 1: Counter()}
        yield from flush(every, by)

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "y")  # max_rows rows
    parts = map_arrow(rows, run, "word string, n long, n1 long, n0 long")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "n0")))


def form_counts(counts: DataFrame) -> DataFrame:
    """The same counts for every form: whole words and prefixes."""
    cut = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in PREFIXES]
    forms = F.explode(F.array_compact(F.array(F.concat("word", F.lit(END)), *cut)))
    return counts.select(forms.alias("word"), "n", "n1", "n0").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "n0")))


def known_form(terms: dict[str, float], word: str) -> float | None:
    s = terms.get(word + END)
    for k in reversed(PREFIXES):
        if s is None and len(word) >= k:
            s = terms.get(word[:k])
    return s


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # significant words' scores
    other: float = -0.05  # every other word's score
    scale: float = 1.0  # lambda
    bias: float = -4.0  # logistic curve over the evidence
    slope: float = 1.0
    remembered: dict[str, float | None] = field(default_factory=dict)

    def score_of(self, word: str) -> float | None:
        try:
            return self.remembered[word]
        except KeyError:
            if len(self.remembered) >= REMEMBER:
                self.remembered.clear()
            self.remembered[word] = s = known_form(self.terms, word)
            return s


def lexicon(counts: DataFrame) -> Model:
    """Scores from the word counts.  All significant forms reach the driver: words
    that occur more than once in the toxic texts of the labelled sample, which
    is bounded, whatever the corpus."""
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n1", "n0"))).first()
    if not total["n1"] or not total["n0"]:
        return Model()
    a0 = PRIOR * (total["n1"] + total["n0"])
    prior = F.col("n") * F.lit(a0 / total["n"])
    y1, y0 = F.col("n1") + prior, F.col("n0") + prior
    log_odds = F.log(y1 / (F.lit(total["n1"] + a0) - y1)) - F.log(y0 / (F.lit(total["n0"] + a0) - y0))
    sd = F.sqrt(1 / y1 + 1 / y0)
    share = total["n1"] / (total["n1"] + total["n0"])
    seen = F.col("n1") + F.col("n0")
    ratio = 2 * (F.col("n1") * F.log(F.col("n1") / (seen * share)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (seen * (1 - share)))).otherwise(0.0))
    kept = (
        form_counts(counts).where((F.col("n1") > 1) & (F.col("n1") > seen * share) & (ratio >= LEAST_Z * LEAST_Z))
        .select("word", (y1 / (total["n1"] + a0)).alias("p1"), (y0 / (total["n0"] + a0)).alias("p0"), (log_odds - sd / 2).alias("s"))
        .where("s > 0")
        .orderBy(F.desc("s"), "word")
        .collect()
    )
    terms = {r["word"]: r["s"] for r in kept}
    # a word counts under several forms; the share of words with a known form is that of the shortest ones
    tops = [r for r in kept if not any(r["word"][:k] in terms for k in range(1, len(r["word"])))]
    seen1, seen0 = (min(0.9, sum(r[c] for r in tops)) for c in ("p1", "p0"))
    other = min(-1e-3, math.log(1 - seen1) - math.log(1 - seen0))
    # lambda: sum over clean text of p exp(lambda s) = 1
    p = np.array([r["p0"] for r in tops] + [1 - seen0])
    s = np.array([r["s"] for r in tops] + [other])
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        if _log_sum(p, s * mid) > 0:
            high = mid
        else:
            low = mid
    scale = low if kept and p @ s < 0 else 1.0
    return Model(terms, other, float(min(scale, 50.0)))


def _log_sum(p: np.ndarray, x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.maximum(1e-300, (p * np.exp(x - top)).sum())))


def segments(scored: list[tuple[int, float]], n: int, other: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, last word), disjoint and
    in order; ``scored`` has the words with a score of their own, the other
    words score ``other`` < 0.  Linear time (each candidate is merged once)."""
    # candidates: [left sum before it, right sum after it, first, last]
    found: list[list[float]] = []
    total, at = 0.0, 0
    for i, s in scored:
        total += other * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        left, right, first = total, total + s, i
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][1] >= right:
                found.append([left, right, first, i, j])
                break
            left, first = found[j][0], int(found[j][2])
            del found[j:]
    return [(r - lft, int(a), int(b)) for lft, r, a, b, _ in found]


def evidence(model: Model, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
    """Sum of log(1/E) over the significant segments, and those segments."""
    ws = words(text)
    scored = [(i, s) for i, s in enumerate(map(model.score_of, ws)) if s is not None]
    if not scored:
        return 0.0, []
    base = math.log(K * len(ws))
    good = [(s, a, b) for s, a, b in segments(scored, len(ws), model.other) if base - model.scale * s < math.log(MOST_E)]
    return sum(model.scale * s - base for s, _, _ in good), good


def squash(e: float) -> float:
    return math.log1p(e)


def calibrate(docs: DataFrame, sample: DataFrame, model: Model) -> Model:
    """Fits the logistic curve on a histogram of the sample's evidence."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("y", pa.int32()), ("bin", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for texts, ys in rows_of(batches):
            x = [min(BINS - 1, int(squash(evidence(m, t)[0]) * 32)) for t in texts]
            yield emit(schema, [int(y > 0) for y in ys], x)

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    hist = map_arrow(rows, run, "y int, bin int").groupBy("y", "bin").agg(F.count("*").alias("n")).collect()  # 2 * BINS rows at most
    if hist:
        x = np.array([r["bin"] / 32 for r in hist])
        y = np.array([r["y"] for r in hist], float)
        w = np.array([r["n"] for r in hist], float)
        beta, ridge = np.zeros(2), np.array([1e-3, 1e-2]) * max(1.0, w.sum() / 1000)
        z = np.stack([np.ones_like(x), x], 1)
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (w * (y - p)) - ridge * beta
            beta = beta + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
        model.bias, model.slope = float(beta[0]), float(beta[1])
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Lexicon, scale and curve.  Labels of held-out documents (crc32 fold 0 of
    5) are never read.  Without both labels the model gives one low score."""
    sample = materialize(label_sample(labels, "toxic", max_rows))
    curve = fold(F.col("doc_id"), 5) == 4
    model = lexicon(materialize(word_counts(docs, sample.where(~curve))))
    return calibrate(docs, sample.where(curve), model) if model.terms else model


def probability(model: Model, e: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * squash(e)))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) for every row of ``docs``; passages: an array of
    (first, last, weight, text) with the numbers of the first and last word from 0,
    the segment's score and its words, in order.

    NULL and empty texts have no evidence, no passage and the score of a text
    without any toxic passage.  Repeated rows are each scored; other columns are
    not read.
    """
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("weight", pa.float64()), ("text", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(passage))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # forms of the labelled sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in rows_of(batches):
            got = [evidence(m, t) for t in texts]
            spans = []
            for t, (_, found) in zip(texts, got):
                ws = words(t) if found else []
                spans.append([{"first": a, "last": b, "weight": s, "text": " ".join(ws[a : b + 1])} for s, a, b in found])
            yield emit(schema, ids, [probability(m, e) for e, _ in got], spans)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, passages array<struct<first:int,last:int,weight:double,text:string>>")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = [probability(m, evidence(m, t.as_py())[0]) < least for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        F.expr("array_max(transform(passages, p -> struct(p.weight, p.first, p.text))).text").alias("top_passage"),
    )
