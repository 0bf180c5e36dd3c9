"""Near duplicates by a multi-index Hamming join of b-bit signatures (operator 8).

* A document is its set of word shingles; its signature is ``COMPONENTS``
  MinHash values of 16 bits.  Equal sets are one class from the start.
* Multi-index: the signature is split into chunks of ``CHUNK`` components.  If
  two signatures differ in at most ``DISTANCE`` components, then by the
  pigeonhole some chunk differs in at most one; every chunk is therefore
  entered once per allowed error position, with that component left out, and
  two classes that meet in an entry are candidates.  All pairs within
  ``DISTANCE`` meet; a pair at the similarity threshold is further apart with
  a probability of about 3.3 in a million, and is then dropped.
* Large entries are not expanded into pairs.  First each class is held against
  one hub: of each entry the member that meets most others, of a class's
  entries the hub it shares most with.  The confirmed links are joined into
  components, and entries that lie inside one component are done.  Only in the
  others are members of different components compared, in blocks of bounded
  size, each pair in the first entry that it shares, by the whole signatures
  and by sketches (the ``SKETCH`` smallest shingle hashes, all of them in
  shorter texts).  One link between two components is enough.
* Candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, map_arrow, materialize, rows_of
from wearhouse.llm.components import components
from wearhouse.llm.fingerprint import mix, shingles

COMPONENTS = 48
CHUNK = 4
DISTANCE = 2 * (COMPONENTS // CHUNK) - 1
#: Members of an entry that are compared in one go.
BLOCK = 512
#: Smallest shingle hashes of a sketch; the estimate from them may miss by
#: ``SIGMAS`` standard deviations before a pair is passed over.
SKETCH = 256
SIGMAS = 5

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """MinHash over shingle hashes, 16 bits of each minimum."""
    least = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[at : at + 2048, None] * _A + _B).min(0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def entries(sig: np.ndarray) -> np.ndarray:
    """The entries of a signature: per chunk and left-out component a hash of
    chunk number, component number and the other components; its low byte is
    the entry's number."""
    chunks = sig.astype(np.uint64).reshape(-1, CHUNK)
    out = []
    for skip in range(CHUNK):
        key = np.arange(len(chunks), dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(skip)
        for c in range(CHUNK):
            if c != skip:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + chunks[:, c] + np.uint64(1))
        out.append(key)
    number = np.arange(COMPONENTS, dtype=np.uint64)
    return (np.concatenate(out) << np.uint64(8) | number).view(np.int64)


def first_entry(same: np.ndarray) -> np.ndarray:
    """Number of the first entry that pairs share, from the equality of their
    signatures' components (a row per pair); ``COMPONENTS`` if none."""
    chunks = same.reshape(len(same), COMPONENTS // CHUNK, CHUNK)
    agree = chunks.sum(2)
    out = np.full(len(same), COMPONENTS)
    for skip in reversed(range(CHUNK)):
        hit = (agree == CHUNK) | ((agree == CHUNK - 1) & ~chunks[:, :, skip])
        out = np.where(hit.any(1), skip * agree.shape[1] + hit.argmax(1), out)
    return out


def sketch(h: np.ndarray) -> bytes:
    """The smallest hashes, shortened to 32 bits; a leading 1 if these are all."""
    return np.concatenate([[len(h) <= SKETCH], h[:SKETCH] >> np.uint64(32)]).astype(np.uint32).tobytes()


class Sketches:
    """Sketches of a block's members, for one against many."""

    def __init__(self, raw: list[bytes]):
        rows = [np.frombuffer(x, np.uint32) for x in raw]
        self.values = [x[1:] for x in rows]
        self.limit = np.array([np.iinfo(np.uint32).max if x[0] else x[-1] for x in rows], np.uint32)
        self.whole = np.array([bool(x[0]) for x in rows])

    def alike(self, at: int, to: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``to`` may have the similarity with ``at``, and which surely
        have: exactly (but for one colliding hash) where both sketches are
        whole, else by the estimate, which is never sure."""
        own, flat = self.values[at], np.concatenate([self.values[i] for i in to])
        sizes = np.array([len(self.values[i]) for i in to])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        limit = np.minimum(self.limit[to], self.limit[at])
        seen = flat <= np.repeat(limit, sizes)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat(seen & (own[place] == flat), starts)
        union = np.add.reduceat(seen, starts) + np.searchsorted(own, limit, side="right") - both
        share = percent / 100
        whole = self.whole[to] & self.whole[at]
        over = both - share * union
        return over >= -np.where(whole, 1, SIGMAS * np.sqrt(share * (1 - share) * union) + 1), whole & (over >= 1)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            sets = [shingles(t, size) for t in texts]
            yield emit(
                schema,
                ids,
                [len(h) for h in sets],
                [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets],
                [signature(h).tobytes() if len(h) else None for h in sets],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_id binary, sig binary")


def _entries(classes: DataFrame) -> DataFrame:
    schema = pa.schema([("uid", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [entries(np.frombuffer(s, np.uint16)) for s in b.column(1).to_pylist()]
            if keys:
                uid = np.repeat(b.column(0).to_numpy(), COMPONENTS)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.concatenate(keys))], schema=schema)

    return map_arrow(classes.select("uid", "sig"), run, "uid long, key long")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for a, b, ta, tb in rows_of(batches, 256):
            links: list[tuple[int, int]] = []
            for x, y, s, t in zip(a, b, ta, tb):
                if last != y:
                    last, held = y, shingles(t, size)
                h = shingles(s, size)
                both = len(np.intersect1d(h, held, assume_unique=True))
                if 100 * both >= percent * (len(h) + len(held) - both):
                    links.append((x, y))
            yield emit(schema, [x for x, _ in links], [y for _, y in links])

    first = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
    whole = first.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
    return map_arrow(whole.select("a", "b", "ta", "tb"), run, "a long, b long")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are within ``DISTANCE``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x, y = (np.frombuffer(b"".join(r.column(i).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for i in (2, 3))
            yield r.select([0, 1]).filter(pa.array((x != y).sum(1) <= DISTANCE)).cast(schema)

    a, b = classes.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("uid").alias("b"), F.col("sig").alias("sb"))
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("uid", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, text in rows_of(batches, 256):
            yield emit(schema, uid, [sketch(shingles(t, size)) for t in text])

    return map_arrow(texts.select("uid", "text"), run, "uid long, sketch binary")


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one entry that lie in different components
    and may have the similarity; of pairs known for certain, one between any
    two components and blocks.  An entry is cut into blocks of about ``BLOCK``
    members by a hash of the member; each pair of blocks is one unit of work."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unit(entry: int, rows: dict[str, list]) -> pa.RecordBatch:
        uid, comp, home = (np.array(rows[c], np.int64) for c in ("uid", "comp", "home"))
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, COMPONENTS)
        marks = Sketches(rows["sketch"])
        left, right = np.flatnonzero(home == home.min()), np.flatnonzero(home == home.max())
        joined: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        for at in left:
            to = right[(comp[right] != comp[at]) & ((home[right] != home[at]) | (right > at))]
            same = sig[to] == sig[at]
            to = to[(same.sum(1) >= COMPONENTS - DISTANCE) & (first_entry(same) == entry)]
            if len(to):
                maybe, sure = marks.alike(at, to, percent)
                for k, certain in zip(to[maybe], sure[maybe]):
                    both = (min(comp[at], comp[k]), max(comp[at], comp[k]))
                    if both in joined:
                        continue
                    if certain:
                        joined.add(both)
                    out.append((min(uid[at], uid[k]), max(uid[at], uid[k])))
        return emit(schema, [int(x) for x, _ in out], [int(y) for _, y in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, rows = ["uid", "comp", "home", "sig", "sketch"], None, {}
        for *name, uid, comp, home, sig, mark in rows_of(batches, 4096):
            for row in zip(zip(*name), uid, comp, home, sig, mark):
                if row[0] != now:
                    if now is not None:
                        yield unit(now[0] & 255, rows)
                    now, rows = row[0], {c: [] for c in names}
                for c, v in zip(names, row[1:]):
                    rows[c].append(v)
        if now is not None:
            yield unit(now[0] & 255, rows)

    blocks = F.ceil(F.col("n") / BLOCK)
    about = classes.select("uid", "sig").join(members.select("uid").distinct(), "uid", "left_semi").join(
        _sketches(texts.join(members.select("uid").distinct(), "uid", "left_semi"), size).dropDuplicates(["uid"]), "uid"
    )
    units = (
        members.withColumn("home", F.pmod(F.xxhash64("uid"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "uid", "comp", "home")
        .join(about, "uid")
        .select("key", "i", "j", "uid", "comp", "home", "sig", "sketch")
    )
    return map_arrow(units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are linked if 100 * common >= ``percent`` * united shingles.
    component_id is the smallest doc_id that links reach.  NULL texts and texts
    without words have no shingles, are linked with nothing and are kept.
    Repeated rows (and equal texts) are in one component.  Several rows with one
    doc_id are each judged by their own text.  A NULL doc_id is never the
    smallest while its component has another.  Other columns are not read.
    """
    sigs = materialize(_signatures(docs, size))
    sets = sigs.where("set_id IS NOT NULL")
    classes = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()))

    placed = _entries(classes)
    members = materialize(placed.join(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))

    met = classes.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "doc_id", "set_id")
    texts = materialize(_texts(docs, met, size))

    degree = members.groupBy("uid").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "uid").groupBy("key").agg(F.max(F.struct("degree", "uid")).alias("hub")).select("key", F.col("hub.uid").alias("hub"))
    votes = members.join(hubs, "key").where("uid <> hub").groupBy("uid", "hub").agg(F.count("*").alias("votes"))
    first = votes.groupBy("uid").agg(F.max_by("hub", F.struct("votes", "hub")).alias("b")).select(F.col("uid").alias("a"), "b")
    links = materialize(_confirm(_close(first, classes), texts, size, percent))
    labels = materialize(components(links))

    marked = members.join(labels.select(F.col("node").alias("uid"), "component"), "uid", "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("comp"))
    marked = materialize(marked)
    mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    more = _across(marked.join(mixed, "key"), classes, texts, size, percent)
    links = links.unionByName(materialize(_confirm(more, texts, size, percent)))
    labels = components(links)

    named = classes.join(labels.select(F.col("node").alias("uid"), "component"), "uid", "left").select("set_id", "doc_id", F.coalesce("component", "uid").alias("comp"))
    named = materialize(named)
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    owner = named.join(smallest, "comp").select("set_id", "component_id")
    found = sets.join(owner, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts(docs: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """(uid, text) of one row of each class in ``met`` (uid, doc_id, set_id).
    Rows that share the doc_id but not the shingle set are passed over."""
    schema = pa.schema([("uid", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, text, set_id in rows_of(batches, 256):
            good = [i for i, t in enumerate(text) if xxhash.xxh3_128_digest(shingles(t, size).tobytes()) == set_id[i]]
            yield emit(schema, [uid[i] for i in good], [text[i] for i in good])

    d, m = docs.select("doc_id", "text").alias("d"), met.alias("m")
    rows = d.join(m, F.expr("d.doc_id <=> m.doc_id")).select("m.uid", "d.text", "m.set_id")
    return map_arrow(rows, run, "uid long, text string")  # a repeated row comes twice, and so does its link


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id its component keeps."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)
