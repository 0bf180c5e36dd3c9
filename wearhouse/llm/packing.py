"""Best-fit packing by a linear grouping scheme (operator 7).

1. Every document is tokenised once where it lies; only its pieces (id, start,
   length, crc) go on, never its ids.  A document of at most ``cap`` tokens is
   one piece; a longer one is cut into ``cap``-token pieces, the first piece
   takes the remainder.
2. The histogram of the piece lengths below ``cap`` (at most ``cap`` - 1
   numbers, whatever the input) goes to the driver, and :func:`plan` packs it:
   large lengths are rounded up within groups of equal cardinality,
   configurations of the few rounded sizes are chosen by subset sums, the
   actual lengths take the places, and small lengths are best-fit into what is
   left.  The plan says, for ranges of ranks of each length, in which sequences
   and at which offset the pieces lie; its size depends on ``cap`` alone.
3. Each piece gets its rank within its length from the rank inside its input
   partition (counted while tokenising) plus the counts of earlier partitions,
   so no task ever holds one length's pieces, and looks up its place.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, emit, map_arrow, materialize, rows_of

CAP = 1024
END = 2
#: Rounded sizes at most, and the share of ``cap`` up to which a length is small.
GROUPS = 1024
SMALL = 1 / 3


class IdEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` vocabulary file; the byte-pair
    ranks of the same vocabulary give the same ids several times faster, so
    only texts that hold a special string go through ``tokenizers`` itself.
    """

    def __init__(self, vocab: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocab)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_encoders: dict[tuple, IdEncoder] = {}


def _encoder(vocab: str, ranks: str) -> IdEncoder:
    if (vocab, ranks) not in _encoders:
        _encoders[vocab, ranks] = IdEncoder(vocab, ranks)
    return _encoders[vocab, ranks]


def cut(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    if n <= cap:
        return [(0, n)]
    first = n % cap
    starts = ([0] if first else []) + list(range(first, n, cap))
    return [(s, (first if first and not i else cap)) for i, s in enumerate(starts)]


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
)


def pieces(docs: DataFrame, vocab: str, ranks: str, cap: int = CAP, end: int = END) -> DataFrame:
    """One row per piece; ``part`` and ``nth``: the input partition and the
    piece's number among that partition's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = _encoder(vocab, ranks), TaskContext.get().partitionId(), Counter()
        tail = np.array([end], "<u4").tobytes()
        for ids, texts in rows_of(batches):
            out: list[list] = [[] for _ in PIECES]
            for doc, text in zip(ids, texts):
                data = enc.ids(text or "") + tail
                for k, (start, length) in enumerate(cut(len(data) // 4, cap)):
                    row = (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, seen[length])
                    seen[length] += 1
                    for c, v in zip(out, row):
                        c.append(v)
            yield emit(PIECES, *out)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long")


def _groups(hist: dict[int, int], k: int) -> dict[int, list[list[int]]]:
    """Rounded size -> runs [length, count], of groups of equal cardinality
    over the lengths in falling order; the size is the group's largest length."""
    total, out, filled = sum(hist.values()), defaultdict(list), 0
    each = max(1, -(-total // k))
    size = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if filled % each == 0:
                size = length
            take = min(left, each - filled % each)
            runs = out[size]
            if runs and runs[-1][0] == length:
                runs[-1][1] += take
            else:
                runs.append([length, take])
            filled += take
            left -= take
    return dict(out)


def _fill(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """Sizes (with repeats, within ``counts``) whose sum is the largest
    that is at most ``room``; the largest sizes first among equals."""
    layers, reach, mask = [], 1, (1 << (room + 1)) - 1
    for s in reversed(sizes):  # small to large
        for _ in range(min(counts[s], room // s) if s <= room else 0):
            layers.append((s, reach))
            new = reach | (reach << s) & mask
            if new == reach:
                layers.pop()
                break
            reach = new
    at, out = reach.bit_length() - 1, []
    for s, before in reversed(layers):
        if at >= s and before >> (at - s) & 1:
            out.append(s)
            at -= s
    return out


def plan(hist: dict[int, int], cap: int = CAP, groups: int = GROUPS, small: float = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, rank from, rank before, sequence of the first, offset)
    and the number of sequences, for ``hist``: length (1 to cap) -> count."""
    big = {x: n for x, n in hist.items() if x > cap * small and n}
    runs = _groups(big, groups)
    counts = {s: sum(n for _, n in r) for s, r in runs.items()}
    bins: list[tuple[int, list[int]]] = []  # (how many sequences, their lengths)
    while counts:
        sizes = sorted(counts, reverse=True)
        top = sizes[0]
        counts[top] -= 1
        config = Counter([top, *_fill(cap - top, sizes, counts)])
        counts[top] += 1
        times = min(counts[s] // m for s, m in config.items())
        for s, m in config.items():
            counts[s] -= m * times
            if not counts[s]:
                del counts[s]
        # actual lengths take the places, run by run
        while times:
            slots = []
            step = times
            for s, m in config.items():
                run = runs[s][0]
                if run[1] >= m:
                    step = min(step, run[1] // m)
                    slots.append((s, [(run[0], m)]))
                else:  # the last few of a run and the first of the next ones
                    step, need, mixed = 1, m, []
                    for length, n in runs[s]:
                        mixed.append((length, min(n, need)))
                        need -= mixed[-1][1]
                        if not need:
                            break
                    slots.append((s, mixed))
            lengths = []
            for s, taken in slots:
                for length, m in taken:
                    lengths += [length] * m
                    runs[s][0][1] -= m * step
                    if not runs[s][0][1]:
                        runs[s].pop(0)
            bins.append((step, sorted(lengths, reverse=True)))
            times -= step

    places: list[tuple[int, int, int, int, int]] = []
    rank: Counter = Counter()
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    total = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        places.append((length, rank[length], rank[length] + n, sequence, offset))
        rank[length] += n

    for n, lengths in bins:
        offset = 0
        for length in lengths:
            put(length, n, total, offset)
            offset += length
        room[cap - offset].append((total, n))
        total += n
    for length in sorted((x for x in hist if x not in big and hist[x]), reverse=True):
        left = hist[length]
        while left:
            free = min((r for r in room if r >= length and room[r]), default=0)
            if not free:
                per = cap // length
                room[cap].append((total, -(-left // per)))
                total += -(-left // per)
                continue
            first, n = room[free].pop()
            if n > left:
                room[free].append((first + left, n - left))
                n = left
            put(length, n, first, cap - free)
            room[free - length].append((first, n))
            left -= n
    return places, total


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str, ranks: str, cap: int = CAP, end: int = END, groups: int = GROUPS) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and place in it.

    NULL and empty texts are the end id alone.  Repeated rows are packed each.
    Rows with a NULL id are packed too.  Other columns are not read.  An empty
    table gives no rows.  Pieces of ``cap`` tokens are sequences of their own
    with negative numbers.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, vocab, ranks, cap, end))
    parts = rows.where(F.col("length") < cap).groupBy("length", "part").agg(F.count("*").alias("n"))
    parts = materialize(parts)
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below cap rows
    places, _ = plan(hist, cap, groups)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    full = rows.where(F.col("length") == cap).select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32",
        (-(F.shiftleft(F.col("part").cast("long"), 40) + F.col("nth")) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    ranked = rows.where(F.col("length") < cap).join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    by_length = {x: np.array(sorted(p[1:] for p in places if p[0] == x), np.int64) for x in hist}
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows_ in np.split(order, cuts) if len(order) else []:
                p = by_length[int(length[rows_[0]])]
                at = np.searchsorted(p[:, 0], rank[rows_], side="right") - 1
                sequence[rows_] = p[at, 2] + rank[rows_] - p[at, 0]
                offset[rows_] = p[at, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(sequence), pa.array(offset)], schema=schema)

    return full.unionByName(map_arrow(ranked, look_up, PACKED))


def public_pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_pack(documents(spark, sf_dir))
