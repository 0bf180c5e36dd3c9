"""Embedding whitening by a polarisation covariance (operator 13).

Cross-covariances follow from variances alone: 2 cov(a, b) = var(a + b) -
var(a) - var(b).  So the tasks aggregate nothing but squares of centred values,
for every dimension and for every sum of two dimensions, and the differences of
these variances are the covariance matrix.

All of it is exact.  Vectors are whole numbers x = floor(SCALE * c) + SHIFT.
With the sums S over n vectors, m = floor(S / n), u = x - m and r = S - n * m, a
value's centred form is x - S / n = (n * u - r) / n, and because the u add up to
r, the sum of (n * u - r)^2 is n^2 * sum(u^2) - n * r^2: the tasks sum squares
of the small u in whole numbers, the driver puts them together in Python
integers and rounds each covariance once.  Only the n, d sums and d * (d + 1) / 2
sums of squares (d dimensions, whatever the number of rows) come to the driver,
for the eigenvectors of a d x d matrix.

Three scans of the vectors: sums, squares, and the whitened values' own
covariance; whitening itself is a fourth, one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import map_arrow, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that are worked on in one go.
ROWS = 4096

_LIMB = 40  # whole numbers of any size travel in parts of so many bits
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors, sums per dimension, the covariance and
    the directions (components x dimensions) by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @property
    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """(m, r) of every dimension: S = n * m + r, 0 <= r < n."""
        return tuple(np.array(x, object) for x in zip(*(divmod(s, self.n) for s in self.sums)))


def whole(values: np.ndarray) -> np.ndarray:
    """x of the entries: int64, or Python integers where they would not fit."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * values)
    if np.abs(y, dtype=np.float64).max(initial=0) < 2.0**60:
        return y.astype(np.int64) + SHIFT
    out = np.array([[int(v) for v in row] for row in np.floor(values).tolist()], object)  # floor first: 1024 * c may be infinite
    big = np.isfinite(y)
    return np.where(big, np.array([[int(v) if np.isfinite(v) else 0 for v in row] for row in y.tolist()], object), out * SCALE) + SHIFT


def _vectors(batch: pa.RecordBatch, dims: int | None = None) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(dimension, rows, vectors) of the batch's usable vectors: no NULL, no NULL
    or non-finite entry; column 0 is the id, column 1 the vector."""
    col = batch.column(1)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL entries are NaN here
    size = col.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (size > 0) & (wrong[ends] == wrong[ends - size])
    for d in np.unique(size[usable]).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(usable & (size == d))
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield d, batch.column(0).take(pa.array(part)), flat[(ends - size)[part][:, None] + np.arange(d)]


def pair_squares(u: np.ndarray) -> np.ndarray:
    """Sums over the rows of (u_i + u_j)^2 for i <= j, row by row of the upper
    triangle; the diagonal holds u_i^2."""
    d = u.shape[1]
    out = []
    for i in range(d):
        both = u[:, i:] + u[:, i : i + 1]
        both[:, 0] = u[:, i]
        out.append((both * both).sum(0) if u.dtype == object else np.einsum("ij,ij->j", both, both))
    return np.concatenate(out)


def _small(x: np.ndarray) -> np.ndarray:
    """The numbers as int64 if sums of squares of pairs fit, else as Python integers."""
    if x.dtype == object and x.size and max(abs(int(x.min())), abs(int(x.max()))) < 1 << 60:
        x = x.astype(np.int64)
    if x.dtype != object and 4 * int(np.abs(x).max(initial=0)) ** 2 * max(1, len(x)) >= _SAFE:
        x = x.astype(object)
    return x


def _totals(vectors: DataFrame, sums: Callable[[int, np.ndarray], np.ndarray], dims: int | None = None) -> dict[int, list[int]]:
    """Exact sums of whole numbers over all vectors, by dimension: ``sums`` gives
    those of one block of vectors.  Every task adds its own up first; Spark
    adds the parts of each number's digits."""
    schema = pa.schema([("d", pa.int64()), ("at", pa.int64()), ("limb", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, v in _vectors(batch, dims):
                got = sums(d, v).astype(object)
                own[d] = own[d] + got if d in own else got
        for d, row in own.items():
            out = []
            for at, value in enumerate(row.tolist()):
                limb = 0
                while value or not limb:
                    value, part = divmod(value, 1 << _LIMB) if not -(1 << _LIMB) < value < 1 << _LIMB else (0, value)
                    out.append((d, at, limb, part))
                    limb += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    rows = map_arrow(vectors, run, "d long, at long, limb long, part long").groupBy("d", "at", "limb").agg(F.sum("part").alias("part"))
    out: dict[int, list[int]] = {}
    for d, at, limb, part in rows.orderBy("d", "at").collect():  # dimensions squared, whatever the rows
        got = out.setdefault(d, [])
        got += [0] * (at + 1 - len(got))
        got[at] += part << _LIMB * limb
    return out


def centred(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x - m, in the smallest type that ``_small`` allows."""
    if x.dtype != object and max(abs(k) for k in m.tolist()) < 1 << 61:
        return _small(x - m.astype(np.int64))
    return _small(x.astype(object) - m)


def _column_sums(d: int, v: np.ndarray) -> np.ndarray:
    x = whole(v)
    if x.dtype != object and int(np.abs(x).max(initial=0)) * len(x) >= _SAFE:
        x = x.astype(object)
    return np.append(x.sum(0).astype(object), len(x))


def polarised(n: int, r: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix (divisor ``n``), each entry rounded once, from the
    sums of squares of ``pair_squares`` and the sums ``r`` of the same values."""
    d = len(r)
    place = {}
    for i in range(d):
        for j in range(i, d):
            place[i, j] = len(place)
    total = [n * squares[place[i, i]] - r[i] ** 2 for i in range(d)]  # n^2 times the variance
    out = np.zeros((d, d))
    for (i, j), k in place.items():
        both = n * squares[k] - (r[i] + r[j]) ** 2
        twice = 2 * total[i] if i == j else both - total[i] - total[j]
        out[i, j] = out[j, i] = float(Fraction(twice, 2 * n * n))
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (id, vector).

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are
    left out, and where vectors differ in length all but the most frequent
    length (of equally frequent ones the greatest); None if nothing is left.
    Directions without variance (eigenvalue at most 1e-12 of the greatest) are
    no components, so there can be fewer than asked for.
    """
    found = _totals(vectors, _column_sums)
    if not found:
        return None
    d = max(found, key=lambda k: (found[k][-1], k))
    *sums, n = found[d]
    m = np.array([s // n for s in sums], object)

    def squares(_: int, v: np.ndarray) -> np.ndarray:
        return pair_squares(centred(whole(v), m))

    # every length's squares would be too many; only the one that is fitted
    got = _totals(vectors, squares, d)[d]
    v = polarised(n, [s - n * int(k) for s, k in zip(sums, m)], got)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-12 * max(values.max(), 0)]
    trace = float(np.trace(v))
    return Whitening(n, sums, v, values[order], columns[:, order].T.copy(), values[order] / trace if trace else values[order])


def _project(w: Whitening, v: np.ndarray) -> np.ndarray:
    """Whitened coordinates (rows x components) of the vectors."""
    m, r = w.split
    u = centred(whole(v), m).astype(np.float64) - np.array([float(Fraction(int(k), w.n)) for k in r])
    return u @ w.directions.T / np.sqrt(w.values)


def deviations(w: Whitening, v: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2 of each vector, exactly."""
    m, r = w.split
    u = centred(whole(v), m)
    if u.dtype != object and int(np.abs(u).max(initial=0)) * w.n * len(r) < _SAFE:
        cross = (u @ r.astype(np.int64)).tolist()
        squares = (u * u).sum(1).tolist()
    else:
        u = u.astype(object)
        cross, squares = (u * r).sum(1).tolist(), (u * u).sum(1).tolist()
    rest = sum(int(k) ** 2 for k in r)
    return [w.n**2 * s - 2 * w.n * c + rest for s, c in zip(squares, cross)]


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, absolute, of the whitened values' covariance less the
    identity, measured over all rows."""
    k, d = len(w.values), len(w.sums)
    schema = pa.schema([("at", pa.int64()), ("part", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k + 1, k))
        for batch in batches:
            for _, _, v in _vectors(batch, d):
                y = _project(w, v)  # already centred by the exact means
                own += np.vstack([y.T @ y, y.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.size)), pa.array(own.ravel())], schema=schema)

    got = dict(map_arrow(vectors, run, "at long, part double").groupBy("at").agg(F.sum("part")).collect())
    own = np.array([got.get(i, 0.0) for i in range((k + 1) * k)]).reshape(k + 1, k) / w.n
    return float(np.abs(own[:k] - np.outer(own[k], own[k]) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for
    every usable row of ``rows`` and every component, from 1 by falling
    eigenvalue.

    deviation is a decimal without digits after the point; NULL where it needs
    more than 38 digits.  Which rows are left out, and when there are fewer
    components, see ``fit``; with no component (a single vector, or only equal
    ones) the result is empty.  Repeated rows, equal ids and NULL ids each come
    out.  Other columns are not read.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    w = fit(vectors, components)
    names = f"{id_col} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], names)
    error = identity_error(vectors, w)
    k, d = len(w.values), len(w.sums)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(["id", "component", "n", "deviation", "whitened", "explained", "identity_error"], types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for _, ids, v in _vectors(batch, d):
                y = _project(w, v)
                dev = pa.array([Decimal(x) if x < 10**38 else None for x in deviations(w, v)], types[3])
                each = pa.array(np.repeat(np.arange(len(ids)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(each), w.n)),
                        dev.take(each), pa.array(y.ravel()), pa.array(np.tile(w.explained, len(ids))), pa.array(np.full(len(each), error)),
                    ],
                    schema=schema,
                )

    out = map_arrow(vectors, run, names.replace(id_col, "id", 1))
    return out.withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
