"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 11).

Texts are one flat numpy array of symbols.  Between two characters that no
vocabulary string holds side by side nothing can ever merge, so the array falls
into words there; every distinct word of a batch is merged once.  In a round,
each word's smallest pair rank is found by a segmented minimum, its leftmost
pairs of that rank are merged in all words at once, and the arrays are
compacted; words without a pair that the vocabulary knows leave.

The library merges one pair at a time: best score first, then leftmost.  Merging
all pairs of one rank at once is the same only if no merged symbol can form an
equally good or better pair at once (``safe``, found from the vocabulary); of
other ranks a round merges only each word's leftmost pair.  Words that are not
done after ``ROUNDS`` rounds (long runs of blanks, say) are finished one by one
with a heap, under the same rule.

Characters that the vocabulary lacks become byte pieces.  Decoding gathers each
id's bytes in one go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, map_arrow, rows_of
from wearhouse.llm.fingerprint import mix

MARK = "▁"
#: Characters that are merged in one go; longer texts are cut between words.
CHARS = 400_000
ROUNDS = 96
#: What the library writes for the unknown piece.
UNKNOWN = " ⁇ "

_BITS = 21  # of a symbol: an id, or the vocabulary's size plus a code point
_SYMBOL = (1 << _BITS) - 1
_NONE = np.iinfo(np.int64).max
_NO_RANK = _NONE >> _BITS


class _Table:
    """Fixed map from non-negative int64 keys to int64 values, many at a time."""

    def __init__(self, entries: dict[int, int]):
        self.shift = np.uint64(64 - max(4, (4 * len(entries)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        keys = np.fromiter(entries.keys(), np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int64, len(entries))
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; ``_NONE`` for absent keys."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ragged pieces: each start and its ``size`` - 1 followers."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Codec:
    """Encoder and decoder of one SentencePiece BPE model.

    Takes models that leave characters as they are, write blanks as ``MARK``
    with one in front, and fall back to bytes; others raise ValueError.
    """

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        kinds = {p.type for p in proto.pieces}
        if train.model_type != 2 or not train.byte_fallback or not plain or train.treat_whitespace_as_suffix or kinds - {1, 2, 3, 6}:
            raise ValueError("only byte-fallback BPE models without normalisation, user-defined or unused pieces")
        self.size, self.end = len(proto.pieces), sp.eos_id()
        self._pieces(proto.pieces)
        self._merges({p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1})

    def _pieces(self, pieces) -> None:
        raw, marked = [], []
        self.is_byte = np.zeros(self.size, bool)
        self.byte_id = np.zeros(256, np.int64)
        self.shown = np.ones(self.size, bool)  # control pieces are not
        for i, p in enumerate(pieces):
            marked.append(p.type == 1 and p.piece.startswith(MARK))
            if p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.is_byte[i], self.byte_id[value] = True, i
                raw.append(bytes([value]))
            elif p.type == 3:
                self.shown[i] = False
                raw.append(b"")
            else:
                raw.append((UNKNOWN if p.type == 2 else p.piece.replace(MARK, " ")).encode())
        self.marked = np.array(marked)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _merges(self, known: dict[str, tuple[int, float]]) -> None:
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, (i, _) in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        longer = {p: x for p, x in known.items() if len(p) > 1}
        scores, order = np.unique([-s for _, s in longer.values()], return_inverse=True)
        rank = dict(zip(longer, order.tolist()))
        self.safe = np.bincount(order, minlength=len(scores)) == 1
        pairs, beside = {}, {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                beside[ord(p[k - 1]) << _BITS | ord(p[k])] = 1
                halves = p[:k], p[k:]
                for half in halves:
                    if half in rank and rank[half] >= r:
                        self.safe[rank[half]] = False
                a, b = (known[h][0] if h in known else int(self.symbol[ord(h)]) if len(h) == 1 else -1 for h in halves)
                if a >= 0 and b >= 0:
                    pairs[a << _BITS | b] = r << _BITS | known[p][0]
        self.pairs, self.beside = _Table(pairs), _Table(beside)

    # -- encoding

    def cuts(self, chars: np.ndarray) -> np.ndarray:
        """Does a word start at this character?  The first one's always does."""
        out = np.ones(len(chars), bool)
        out[1:] = self.beside.get(chars[:-1].astype(np.int64) << _BITS | chars[1:]) == _NONE
        return out

    def slices(self, text: str) -> Iterator[str]:
        """The marked text in pieces of about ``CHARS`` characters, cut only between words."""
        if not text:
            return
        text = MARK + text.replace(" ", MARK)
        at, size = 0, CHARS
        while len(text) - at > size:
            cut = np.flatnonzero(self.cuts(np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32)))
            if len(cut) > 1:
                yield text[at : at + cut[-1]]
                at, size = at + int(cut[-1]), CHARS
            else:
                size *= 2
        yield text[at:]

    def encode(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the marked texts, or slices, one after another."""
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(marked), np.int64)
        cut = self.cuts(chars)
        begins = np.cumsum(sizes) - sizes
        cut[begins[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        length = np.diff(np.append(starts, len(chars)))
        symbols = self.symbol[chars]
        word = self._classes(symbols, starts, length)
        first = np.unique(word, return_index=True)[1]
        got, n = self._merged(symbols[gather(starts[first], length[first])], length[first])
        ids, n = self._bytes(got, n)
        own = n[word]
        ids = ids[gather((np.cumsum(n) - n)[word], own)]
        total = np.concatenate([[0], np.cumsum(own)])
        at = np.searchsorted(starts, np.append(begins, len(chars)))
        return ids, np.diff(total[at])

    def _classes(self, symbols: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Equal numbers, from 0, for equal words; the hash only finds the words to compare."""
        place = np.arange(len(symbols)) - np.repeat(starts, length)
        h = np.add.reduceat(mix((symbols << 32 | place).view(np.uint64)), starts)
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        rep = first[word]
        same = length == length[rep]
        at = gather(starts[rep][same], length[same])
        own = np.repeat(same, length)
        differs = np.zeros(len(symbols), bool)
        differs[own] = symbols[at] != symbols[own]
        odd = np.flatnonzero(~same | np.logical_or.reduceat(differs, starts))
        word[odd] = len(first) + np.arange(len(odd))
        return word

    def _merged(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of symbols of each word) after all merges."""
        count = len(length)
        word = np.repeat(np.arange(count), length)
        pair = np.full(len(sym), _NONE)
        self._look(sym, word, pair, np.arange(len(sym)))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            if not len(sym):
                break
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = pair >> _BITS
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(sym))))
            going = low != _NO_RANK
            if not going.all():
                parts.append((word[~going], sym[~going]))
                sym, word, pair, rank, low = (x[going] for x in (sym, word, pair, rank, low))
                if not len(sym):
                    break
            best = np.flatnonzero(rank == low)
            leads = np.concatenate([[True], word[best[1:]] != word[best[:-1]]])
            number = np.arange(len(best))
            run = np.concatenate([[True], best[1:] != best[:-1] + 1]) | leads
            odd = (number - np.maximum.accumulate(np.where(run, number, 0))) & 1  # of neighbours in a run every other one
            at = best[(odd == 0) & (self.safe[low[best]] | leads)]
            sym[at] = pair[at] & _SYMBOL
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, pair = sym[keep], word[keep], pair[keep]
            at -= np.arange(len(at))
            self._look(sym, word, pair, np.unique(np.concatenate([at, at[at > 0] - 1])))
        if len(sym):
            cut = np.flatnonzero(word[1:] != word[:-1]) + 1
            for w, s in zip(word[np.concatenate([[0], cut])], np.split(sym, cut)):
                left = np.array(self._one(s.tolist()), np.int64)
                parts.append((np.full(len(left), w), left))
        word, sym = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=count)

    def _look(self, sym: np.ndarray, word: np.ndarray, pair: np.ndarray, at: np.ndarray) -> None:
        """Sets ``pair`` (rank and merged symbol) of the symbols ``at`` with their right neighbours."""
        pair[at] = _NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        pair[at] = self.pairs.get(sym[at] << _BITS | sym[at + 1])

    def _one(self, sym: list[int]) -> list[int]:
        """One word's symbols after all merges: best rank first, then leftmost."""
        after = list(range(1, len(sym))) + [-1]
        before = list(range(-1, len(sym) - 1))
        found = self.pairs.get(np.array(sym[:-1], np.int64) << _BITS | np.array(sym[1:], np.int64)).tolist()
        heap = [(v >> _BITS, i, v & _SYMBOL, sym[i], sym[i + 1]) for i, v in enumerate(found) if v != _NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                v = int(self.pairs.get(np.array([sym[i] << _BITS | sym[after[i]]]))[0])
                if v != _NONE:
                    heapq.heappush(heap, (v >> _BITS, i, v & _SYMBOL, sym[i], sym[after[i]]))

        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            if sym[i] != a or after[i] < 0 or sym[after[i]] != b:
                continue  # one of the two was merged since
            gone = after[i]
            sym[i], sym[gone], after[i] = new, -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [s for s in sym if s >= 0]

    def _bytes(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: unknown characters become their UTF-8 bytes' pieces."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, n
        wide = np.ones(len(sym), np.int64)
        code = sym[odd] - self.size
        wide[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.repeat(sym, wide)
        raw = np.frombuffer(code.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        out[gather((np.cumsum(wide) - wide)[odd], wide[odd])] = self.byte_id[raw]
        total = np.concatenate([[0], np.cumsum(wide)])
        ends = np.cumsum(n)
        return out, total[ends] - total[ends - n]

    # -- decoding

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The text of each run of ``n`` ids.  Ids outside the vocabulary raise ValueError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("piece id is out of range")
        raw = self.raw[gather(self.starts[ids], self.sizes[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        ends = np.cumsum(n)
        parted = np.flatnonzero(self.is_byte[ids[:-1]] & ~self.shown[ids[1:]])  # bytes do not join over a control piece
        parted = set(np.searchsorted(ends, parted[~np.isin(parted + 2, ends)], side="right").tolist())
        out = []
        for k, (begin, end) in enumerate(zip((ends - n).tolist(), ends.tolist())):
            own = raw[at[begin] : at[end]]
            lead = begin
            while lead < end and not self.shown[ids[lead]]:
                lead += 1
            if lead < end and self.marked[ids[lead]]:
                own = own[1:]  # the mark in front of every text
            hidden = [i for i in range(lead, end) if not self.shown[ids[i]]] if k in parted else []
            cut = at[begin] + int(at[end] - at[begin]) - len(own)  # where ``own`` starts
            bounds = [0, *(int(at[i] - cut) for i in hidden), len(own)]
            out.append("".join(_text(own[x:y]) for x, y in zip(bounds, bounds[1:])))
        return out


def _text(raw: bytes) -> str:
    """Bytes as text, every byte that is in no whole character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_codecs: dict[str, Codec] = {}


def _codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def _groups(codec: Codec, texts: list[str | None]) -> Iterator[tuple[int, list[str], list[int]]]:
    """(texts that end here, slices, text number of each slice), ``CHARS`` or so at a time."""
    slices, owner, size = [], [], 0
    for k, text in enumerate(texts):
        for part in codec.slices(text or ""):
            if size + len(part) > CHARS and slices:
                yield k, slices, owner
                slices, owner, size = [], [], 0
            slices.append(part)
            owner.append(k)
            size += len(part)
    yield len(texts), slices, owner


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``: the ids of its whole text as the
    library gives them, and the end id.

    NULL and empty texts have the end id alone.  Repeated rows come out each;
    other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        last = np.array([codec.end], np.int32)
        for doc_ids, texts in rows_of(batches):
            done, open_parts = 0, []  # parts of text number ``done`` that came so far
            for upto, slices, owner in _groups(codec, texts):
                ids, n = codec.encode(slices)
                ids = ids.astype(np.int32)
                own = np.bincount(np.array(owner, np.int64) - done, n, minlength=upto - done + 1).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(own)])
                values, sizes = [], []
                for k in range(upto - done):
                    row = open_parts + [ids[bounds[k] : bounds[k + 1]], last]
                    open_parts = []
                    values += row
                    sizes.append(sum(map(len, row)))
                if bounds[-1] > bounds[upto - done]:
                    open_parts.append(ids[bounds[upto - done] :])
                if sizes:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[done:upto], pa.int64()), rows], schema=ENCODED)
                done = upto

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) of every row (doc_id, ids): the text of its ids as the
    library gives it.  NULL ids give a NULL text, no ids the empty one; a NULL or
    unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(1)
                n = col.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                texts = codec.decode(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
                texts = [t if ok else None for t, ok in zip(texts, col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), col.cast(DECODED.field(1).type), pa.array(texts, pa.string())], schema=DECODED)

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_ids(encode_texts(documents(spark, sf_dir), model), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
