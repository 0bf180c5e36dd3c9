"""Document fingerprints by one-permutation MinHash (operator 4).

Each distinct five-word shingle is hashed once.  Its high bits choose one of
``BINS`` bins, the smallest hash of each bin is kept, bins that got none are
filled by optimal densification (a fixed hash of bin and attempt points to
another bin until a filled one is found), and of each bin only the low
``BITS`` bits are stored, packed.  The likeness of two fingerprints is the
share of equal bins, corrected for chance agreement of ``BITS`` bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, map_arrow, materialize, rows_of

SHINGLE = 5
BINS = 256
BITS = 8

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(32)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that high and low bits are both even."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: words are split at
    ASCII white space, A-Z lower-cased; fewer words than ``size`` are one shingle."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    size = min(size, len(ws))
    n = len(ws) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _MULTIPLIERS[j]
    out = mix(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


_ATTEMPTS = 64


def _directions(bins: int, block: int) -> np.ndarray:
    """Bins tried by attempts block * 64 .. of every empty bin (a 2-universal
    family would do; the mixer gives one function per attempt)."""
    a = np.arange(block * _ATTEMPTS, (block + 1) * _ATTEMPTS, dtype=np.uint64)[:, None]
    i = np.arange(bins, dtype=np.uint64)[None, :]
    return (mix(a * np.uint64(0x9E3779B97F4A7C15) + i * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


_tried: dict[tuple[int, int], np.ndarray] = {}


def fingerprint(text: str | None, bins: int = BINS, size: int = SHINGLE) -> bytes:
    """Packed low bytes of the densified bins; no words: no bytes."""
    h = shingles(text, size)
    if not len(h):
        return b""
    at = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # sorted as h is
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low = np.zeros(bins, np.uint8)
    filled = np.zeros(bins, bool)
    low[at[first].astype(np.int64)] = (h[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    filled[at[first].astype(np.int64)] = True
    empty, block = np.flatnonzero(~filled), 0
    while len(empty):
        if (bins, block) not in _tried:
            _tried[bins, block] = _directions(bins, block)
        to = _tried[bins, block][:, empty]
        hit = filled[to]
        which = hit.argmax(0)
        done = hit[which, np.arange(len(empty))]
        low[empty[done]] = low[to[which, np.arange(len(empty))][done]]
        empty, block = empty[~done], block + 1
    return low.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity; two empty fingerprints are alike."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as
    many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
    + [("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DDL = "kind int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_RESULT, _LAST, _FIRST = 0, 1, 2


def _row(doc_id: int | None, text: str, fp: bytes, following: str, next_fp: bytes) -> tuple:
    new = edited(text, following)
    new_fp = fingerprint(new)
    return (_RESULT, doc_id, None, len(text), hashlib.sha256(new.encode()).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, next_fp))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: each document with its successor.  The first
    and the last document go out with their texts, to be paired across partitions."""
    before = None
    for ids, texts in rows_of(batches, 256):
        out = []
        for doc_id, text in zip(ids, texts):
            text = text or ""
            fp = fingerprint(text)
            if before is None:
                out.append((_FIRST, doc_id, text, *[None] * 6))
            else:
                out.append(_row(*before, text, fp))
            before = (doc_id, text, fp)
        yield emit(RESULT, *zip(*out))
    if before is not None:
        yield emit(RESULT, *zip((_LAST, before[0], before[1], *[None] * 6)))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, following in rows_of(batches, 256):
        yield emit(RESULT, *zip(*(_row(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(ids, texts, following))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row of ``docs``.

    The next document is that of the next larger doc_id, after the last the
    first.  NULL text counts as empty; a NULL id sorts before all others; rows
    with one id follow each other in the order of their texts.  Other columns
    are not read.  An empty table gives no rows.

    The texts are shuffled once, by ranges of doc_id.  Only each partition's
    first and last document cross its border: their ids, one pair per
    partition, are put in order by one small window.
    """
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    staged = materialize(map_arrow(rows, _in_order, DDL).withColumn("part", F.spark_partition_id()))
    ends = staged.where(F.col("kind") != _RESULT).select("part", "kind", "doc_id", "text")
    firsts = ends.where(F.col("kind") == _FIRST).select("part", "doc_id")
    order = Window.orderBy(F.asc_nulls_first("doc_id"))  # one row per partition
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next_part"))
    last = ends.where(F.col("kind") == _LAST).select("part", "doc_id", "text").join(after, "part")
    first = ends.where(F.col("kind") == _FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    borders = map_arrow(last.join(first, "next_part").select("doc_id", "text", "following"), _across, DDL)
    result = staged.where(F.col("kind") == _RESULT).drop("part").unionByName(borders)
    return result.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
