"""Quality classifier: a factorisation machine (operator 10).

Features of a text: hashed words and word shapes (log counts, unit length),
structure statistics (repeats, line and symbol shares, ...) and metadata that
the text itself gives (its lengths in words and characters).  The machine
scores  w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
all pairwise interactions at a cost linear in the features.  It is fitted on
the driver to a bounded sample of labelled rows (``max_rows``) by Adam steps
on the log loss, and applied to every row where it lies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, fold, label_sample, map_arrow, materialize, rows_of, table

MAX_ROWS = 6_000
BUCKETS = 512
SHAPES = 64
RANK = 6
EPOCHS = 250
REMEMBER = 300_000
STATS = 22
WIDTH = STATS + SHAPES + BUCKETS

_SHAPE = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0")]


class Features:
    """Feature rows of texts; remembers the buckets of words it has seen."""

    def __init__(self, remember: int = REMEMBER):
        self.known: dict[str, int] = {}
        self.remember = remember

    def _buckets(self, word: str) -> int:
        """Word bucket + BUCKETS * shape bucket."""
        shape = word
        for pattern, sign in _SHAPE:
            shape = pattern.sub(sign, shape)
        b = zlib.crc32(word.lower().encode()) % BUCKETS + BUCKETS * (zlib.crc32(shape.encode()) % SHAPES)
        if len(self.known) >= self.remember:
            self.known = {}
        self.known[word] = b
        return b

    def row(self, text: str | None) -> np.ndarray:
        x = np.zeros(WIDTH, np.float32)
        text = text or ""
        ws = text.split()
        x[0] = not ws
        if not ws:
            return x
        get = self.known.get
        both = np.fromiter((self._buckets(w) if (b := get(w)) is None else b for w in ws), np.int64, len(ws))
        n = len(ws)
        for at, size, b in ((STATS, SHAPES, both // BUCKETS), (STATS + SHAPES, BUCKETS, both % BUCKETS)):
            c = np.log1p(np.bincount(b, minlength=size))
            x[at : at + size] = c / np.sqrt((c * c).sum())
        data = np.frombuffer(text.encode(), np.uint8)
        c = np.bincount(data, minlength=256) / len(data)
        counts = Counter(ws)
        lines = [ln for ln in text.split("\n") if ln.strip()]
        same = sum(a == b for a, b in zip(ws, ws[1:]))
        top = counts.most_common(1)[0][1]
        trigrams = list(zip(ws, ws[1:], ws[2:]))
        shares = [
            0.0,
            math.log1p(n),
            math.log1p(len(text)),
            len(text) / n,
            len(counts) / n,
            len(counts) / math.sqrt(n),
            same / n,
            top / n,
            len(set(trigrams)) / max(1, len(trigrams)),
            len(set(lines)) / max(1, len(lines)),
            math.log1p(len(lines)),
            math.log1p(n / max(1, len(lines))),
            c[65:91].sum(),
            c[97:123].sum(),
            c[48:58].sum(),
            c[128:].sum(),
            c[33] + c[63],
            c[44] + c[46],
            c[124],
            c[35:39].sum() + c[42] + c[43] + c[64] + c[94:97].sum(),
            c[60:63].sum() + c[40] + c[41] + c[47] + c[91:94].sum() + c[123] + c[125],
            sum(ln.rstrip()[-1:] in ".!?" for ln in lines) / max(1, len(lines)),
        ]
        x[:STATS] = shares
        return x


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = self.inputs(x)
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7, decay: float = 2e-3) -> Machine:
    """Full-batch Adam on the log loss.  With no rows, or one label only, a
    machine that gives the share of label 1 (0.5 without rows)."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(np.zeros(d, np.float32), np.ones(d, np.float32), float(np.log(share / (1 - share))), np.zeros(d, np.float32), np.zeros((d, rank), np.float32))
    if not len(y) or y.min() == y.max():
        return m
    m.mean = x.mean(0).astype(np.float32)
    sd = x.std(0)
    m.scale = np.where(sd > 1e-6, sd, 1).astype(np.float32)
    m.scale[STATS:] = 0.05 + m.scale[STATS:]  # hashed parts: rare buckets are not blown up
    z = m.inputs(x)
    z2 = z * z
    m.v = rng.normal(0, 0.01, (d, rank)).astype(np.float32)
    p = [np.array([m.w0], np.float32), m.w, m.v]
    a, b = [np.zeros_like(t) for t in p], [np.zeros_like(t) for t in p]
    for t in range(1, epochs + 1):
        s = z @ p[2]
        logit = p[0] + z @ p[1] + 0.5 * (s * s - z2 @ (p[2] * p[2])).sum(1)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y).astype(np.float32) / len(y)
        grads = [np.array([g.sum()], np.float32), z.T @ g + decay * p[1], z.T @ (g[:, None] * s) - (z2.T @ g)[:, None] * p[2] + decay * p[2]]
        for i, gr in enumerate(grads):
            a[i] = 0.9 * a[i] + 0.1 * gr
            b[i] = 0.999 * b[i] + 0.001 * gr * gr
            p[i] = p[i] - 0.02 * (a[i] / (1 - 0.9**t)) / (np.sqrt(b[i] / (1 - 0.999**t)) + 1e-8)
    m.w0, m.w, m.v = float(p[0][0]), p[1], p[2]
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold."""
    sample = materialize(label_sample(labels, "quality", max_rows))
    schema = pa.schema([("x", pa.binary()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for texts, ys in rows_of(batches):
            yield emit(schema, [f.row(t).tobytes() for t in texts], [int(y > 0) for y in ys])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows ids
    # of several rows with one id the one with the smallest text hash
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y")
    got = map_arrow(rows, run, "x binary, y int").collect()  # at most max_rows rows, as documented
    got.sort(key=lambda r: bytes(r["x"]))  # the same model whatever the order of the rows
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), WIDTH)
    return fit(x, np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row of ``docs``.

    NULL, empty and blank texts have the same features and one score.  Repeated
    rows are each scored; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # WIDTH * (RANK + 3) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Features(), shared.value
        for ids, texts in rows_of(batches):
            yield emit(schema, ids, m.scores(np.stack([f.row(t) for t in texts])).astype(np.float64))

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
