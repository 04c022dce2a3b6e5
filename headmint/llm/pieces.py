"""SentencePiece encoding and decoding by suffix-array matching.

A slice of texts is cut into units that no piece crosses (a run of blanks and what follows
it; characters that no longer piece has stand alone). The distinct units, joined, are the
text that is indexed:

1. a suffix array of the joined units, sorted as deep as the longest piece by doubling;
2. every piece's range of occurrences, by binary search for all pieces at once;
3. each occurrence is an edge (start, length, piece); only these are kept, sorted by position.
   Where no edge crosses a place, no token does, so units are cut there into segments;
4. relaxation over the sorted edges: segments start as single characters; in each round every
   segment joins the pair whose edge has the best score, the leftmost of equals, until no pair
   is an edge. This is the merge order of the public BPE models, whose result shortest paths
   wouldn't give. Long segments do the same with a heap.

A unit of more than CHUNK_CHARS is cut at places that no edge crosses before it is indexed, so
memory is bounded by the chunk, unless a text has an unbroken chain of pieces that long. What
has no piece falls back to bytes. Models with byte-pair merges and no normalisation are
supported; the vocabulary is read on the driver and sent with the task (its size is the
model's, not the data's).
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import hash_ranges, text_slices

BLANK = "▁"
SLICE = 3 << 20
CHUNK_CHARS = 1 << 19  # of distinct units indexed at once
LONG_SEGMENT = 192  # characters from which a segment is merged with a heap: the same merges, one at a time
BPE = 2  # fixed value of the model format
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # fixed values of the model format


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, i

    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    prefix: bool = True  # a blank is put before a text
    made: dict = field(default_factory=dict, repr=False)  # derived tables, built where they are used

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kinds, scores, prefix, model, rules, squeeze = [], [], [], True, 1, b"", True
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                p = dict(_fields(value))
                rules, prefix, squeeze = p.get(2, b""), bool(p.get(3, 1)), bool(p.get(4, 1))
        if model != BPE or rules or squeeze or USER in kinds:
            raise ValueError("only byte-pair models without normalisation or user symbols are supported")
        return cls(pieces, kinds, scores, prefix)

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def tables(self) -> dict:
        if not self.made:
            ids = [i for i, k in enumerate(self.kinds) if k == NORMAL]
            alphabet = sorted({c for i in ids for c in self.pieces[i]})
            code = np.zeros(0x110000, np.uint32)
            code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
            code[32] = code[ord(BLANK)]
            longest = max((len(self.pieces[i]) for i in ids), default=1)
            chars = np.zeros((len(ids), longest), np.uint32)
            for k, i in enumerate(ids):
                chars[k, : len(self.pieces[i])] = code[[ord(c) for c in self.pieces[i]]]
            order = sorted({self.scores[i] for i in ids}, reverse=True)
            place = {s: k for k, s in enumerate(order)}
            rank = np.full(len(self.pieces) + 1, np.iinfo(np.int32).max, np.int32)
            for i in ids:
                rank[i] = place[self.scores[i]]
            shared = {c for i in ids if len(self.pieces[i]) > 1 for c in self.pieces[i]}
            # a blank after another character inside a piece would let it cross units
            if any(BLANK in self.pieces[i].lstrip(BLANK) for i in ids):
                raise ValueError("pieces that hold a blank inside aren't supported")
            kind = np.zeros(256, np.uint8)
            kind[32] = 1
            for b in range(128):
                if b != 32 and chr(b) not in shared:
                    kind[b] = 2
            fallback = np.full(256, -1, np.int32)
            for i, k in enumerate(self.kinds):
                if k == BYTE:
                    fallback[int(self.pieces[i][1:-1], 16)] = i
            unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), -1)
            plain = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
            self.made.update(ids=np.array(ids, np.int32), code=code, chars=chars, sizes=np.array([len(self.pieces[i]) for i in ids]), rank=rank, longest=longest, kind=kind, fallback=fallback, unknown=unknown, plain=np.frombuffer(b"".join(plain), np.uint8), plain_end=np.cumsum([0] + [len(p) for p in plain]))
        return self.made


# ------------------------------------------------------------------ suffix array


class SuffixArray:
    """Suffixes of `text` (small numbers; 0 ends a unit) in order of their first `depth` numbers."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.seen, dense = np.unique(text, return_inverse=True)
        if not len(self.seen) or self.seen[0] != 0:
            self.seen, dense = np.concatenate([[0], self.seen]), dense + 1
        self.bits = max(1, int(len(self.seen)).bit_length())
        self.per = max(1, 63 // self.bits)
        key = np.zeros(n, np.uint64)
        padded = np.concatenate([dense, np.zeros(self.per, dense.dtype)]).astype(np.uint64)
        for j in range(self.per):
            key = (key << np.uint64(self.bits)) | padded[j : j + n]
        self.levels: list[np.ndarray] = []
        self.depths = [self.per]
        while True:
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.ones(n, bool)
            new[1:] = s[1:] != s[:-1]
            self.levels.append(s[new])
            if self.depths[-1] >= depth:
                break
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(new).astype(np.uint64)  # from 1; 0 is past the end
            far = np.zeros(n, np.uint64)
            d = self.depths[-1]
            if d < n:
                far[:-d] = rank[d:]
            key = (rank << np.uint64(32)) | far
            self.depths.append(2 * d)
        self.order = order
        self.first = np.append(np.flatnonzero(new), n)  # where each distinct suffix begins

    def _bound(self, level: int, chars: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """Number of distinct suffixes at this level that lie before (or, upper, before or among) those that begin with chars."""
        if level == 0:
            key = np.zeros(len(chars), np.uint64)
            for j in range(self.per):
                c = chars[:, j] if j < chars.shape[1] else np.zeros(len(chars), np.uint64)
                c = np.where(j < size, c, np.uint64((1 << self.bits) - 1 if upper else 0))
                key = (key << np.uint64(self.bits)) | c
            return np.searchsorted(self.levels[0], key, side="right" if upper else "left")
        half = self.depths[level - 1]
        out = np.empty(len(chars), np.int64)
        short = size <= half
        if short.any():
            r = self._bound(level - 1, chars[short], size[short], upper).astype(np.uint64) + np.uint64(1)
            out[short] = np.searchsorted(self.levels[level], r << np.uint64(32))
        if not short.all():
            c, s = chars[~short], size[~short]
            full = np.full(len(c), half)
            low = self._bound(level - 1, c[:, :half], full, False)
            here = self._bound(level - 1, c[:, :half], full, True) > low
            rest = self._bound(level - 1, c[:, half:], s - half, upper).astype(np.uint64) + np.uint64(1)
            at = np.searchsorted(self.levels[level], ((low.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | rest)
            out[~short] = np.where(here, at, 0)
        return out

    def ranges(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range in `order` of the suffixes that begin with each row of chars (of its size)."""
        dense = np.searchsorted(self.seen, chars)
        dense[dense == len(self.seen)] = 0
        known = ((self.seen[dense] == chars) | (np.arange(chars.shape[1]) >= size[:, None])).all(axis=1)
        low, high = np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
        top = len(self.levels) - 1
        c = dense[known].astype(np.uint64)
        low[known] = self.first[self._bound(top, c, size[known], False)]
        high[known] = self.first[self._bound(top, c, size[known], True)]
        return low, np.maximum(low, high)


# ------------------------------------------------------------------ encoding


@dataclass
class Edges:
    """Occurrences of pieces in a text, sorted by start and length."""

    key: np.ndarray  # start * longest + length - 1
    piece: np.ndarray
    longest: int

    def find(self, start: np.ndarray, size: np.ndarray, none: int) -> np.ndarray:
        """The piece of each stretch, or none."""
        if not len(self.key):
            return np.full(len(start), none)
        want = start * self.longest + (size - 1)
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.piece[at], none)

    def crossed(self, n: int) -> np.ndarray:
        """Whether some edge goes across the place before each character, and at the end."""
        start, size = self.key // self.longest, self.key % self.longest + 1
        change = np.bincount(start + 1, minlength=n + 2)[: n + 2] - np.bincount(start + size, minlength=n + 2)[: n + 2]
        return np.cumsum(change)[: n + 1] > 0


def edges(text: np.ndarray, t: dict) -> Edges:
    """All edges by position."""
    index = SuffixArray(text, t["longest"])
    low, high = index.ranges(t["chars"], t["sizes"])
    n = high - low
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
    key = index.order[at] * t["longest"] + np.repeat(t["sizes"] - 1, n)
    order = np.argsort(key)
    return Edges(key[order], np.repeat(t["ids"], n)[order], t["longest"])


def relax(e: Edges, start: np.ndarray, unit: np.ndarray, rank: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, length) of the symbols that are left, in order, from single characters."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.ones(len(start), np.int64)
    worst = np.iinfo(np.int32).max

    def ranks(k: np.ndarray) -> np.ndarray:
        """Of symbols k joined with the next, worst where they can't be."""
        out = np.full(len(k), worst, np.int32)
        n = size[k] + size[np.minimum(k + 1, len(size) - 1)]
        can = (k + 1 < len(size)) & (unit[np.minimum(k + 1, len(size) - 1)] == unit[k]) & (n <= e.longest)
        out[can] = rank[e.find(start[k[can]], n[can], none)]
        return out

    r = ranks(np.arange(len(start)))
    while len(start):
        begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(r, begin)
        count = np.diff(np.append(begin, len(start)))
        over = np.repeat(best == worst, count)
        if over.any():
            done.append((unit[over], start[over], size[over]))
        hit = np.flatnonzero((r == np.repeat(best, count)) & ~over)
        first = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])] if len(hit) else hit
        size[first] += size[first + 1]
        stale = np.zeros(len(start), bool)
        stale[first] = True
        stale[np.maximum(first - 1, 0)] = True
        keep = ~over
        keep[first + 1] = False
        start, unit, size, r, stale = start[keep], unit[keep], size[keep], r[keep], stale[keep]
        k = np.flatnonzero(stale)
        r[k] = ranks(k)
    if not done:
        return unit, start, size
    unit, start, size = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start, kind="stable")
    return unit[order], start[order], size[order]


def merge_long(e: Edges, begin: int, end: int, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """The same for one long segment, with a heap of pairs."""
    a, b = np.searchsorted(e.key, [begin * e.longest, end * e.longest])
    known = dict(zip((e.key[a:b] - begin * e.longest).tolist(), rank[e.piece[a:b]].tolist(), strict=True))
    size = [1] * (end - begin)
    after = [*range(1, end - begin), -1]
    before = [-1, *range(end - begin - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b >= 0 and (n := size[a] + size[b]) <= e.longest and (r := known.get(a * e.longest + n - 1)) is not None:
            heapq.heappush(heap, (r, a, size[a], size[b]))

    for a in range(end - begin):
        offer(a)
    while heap:
        _, a, x, y = heapq.heappop(heap)
        b = after[a]
        if size[a] != x or b < 0 or size[b] != y:
            continue
        size[a], size[b] = x + y, 0
        after[a] = after[b]
        if after[a] >= 0:
            before[after[a]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    left = [a for a in range(end - begin) if size[a]]
    return [begin + a for a in left], [size[a] for a in left]


def cut_long(unit: bytes, t: dict) -> list[int]:
    """Places in bytes where a long unit can be cut, as no edge crosses them; about CHUNK_CHARS apart."""
    codes = t["code"][np.frombuffer(unit.decode().encode("utf-32-le"), np.uint32)]
    out, at, width = [], 0, CHUNK_CHARS
    while len(codes) - at > width:
        crossed = edges(codes[at : at + width + t["longest"]], t).crossed(width)
        free = np.flatnonzero(~crossed[1:]) + 1
        if len(free):
            at += int(free[-1])
            out.append(at)
            width = CHUNK_CHARS
        else:
            width *= 2
    lead = np.flatnonzero((np.frombuffer(unit, np.uint8) & 0xC0) != 0x80)
    return lead[out].tolist()


def encode_units(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, end of each unit's ids) for distinct units."""
    t = v.tables()
    none = len(t["rank"]) - 1
    codes = np.frombuffer(b"\n".join(units).decode().encode("utf-32-le"), np.uint32)
    sizes = np.array([len(u) - sum(0x80 <= b < 0xC0 for b in u) if not u.isascii() else len(u) for u in units], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = t["code"][codes].copy()
    text[(begin + sizes)[:-1]] = 0
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
    e = edges(text, t)
    # segments: no edge crosses their borders, and none crosses a unit's
    segment = np.cumsum(~e.crossed(len(text))[:-1])[at]
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))[: len(segment)]
    length = np.diff(np.append(first, len(segment)))
    short = np.repeat(length <= LONG_SEGMENT, length)
    _, s, n = relax(e, at[short], segment[short], t["rank"], none)
    if not short.all():
        more = [merge_long(e, int(at[f]), int(at[f] + k), t["rank"]) for f, k in zip(first[length > LONG_SEGMENT].tolist(), length[length > LONG_SEGMENT].tolist(), strict=True)]
        s = np.concatenate([s, *(np.array(a, np.int64) for a, _ in more)])
        n = np.concatenate([n, *(np.array(b, np.int64) for _, b in more)])
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
    u = np.searchsorted(begin, s, side="right") - 1
    ids = e.find(s, n, none).astype(np.int32)
    lost = ids == none  # a character that is no piece: its bytes, or the unknown piece
    if lost.any():
        c = codes[s[lost]].astype(np.int64)
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        can = bool((t["fallback"] >= 0).all())
        times = np.ones(len(ids), np.int64)
        times[lost] = width if can else 1
        out, u = np.repeat(ids, times), np.repeat(u, times)
        if can:
            raw = np.frombuffer(c.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
            out[out == none] = t["fallback"][raw]
        else:
            out[out == none] = t["unknown"]
        ids = out
    return ids, np.cumsum(np.bincount(u, minlength=len(units)))


def encode_slice(buf: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of each text's ids)."""
    t = v.tables()
    if (buf == 0x81).any() and BLANK.encode() in (whole := buf.tobytes()):  # a blank mark in a text is a blank
        texts = [whole[a:b].replace(BLANK.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
    size = np.diff(off)
    some = size > 0
    if v.prefix:
        grown = np.cumsum(np.concatenate([[0], size + some]))
        x = np.full(int(grown[-1]), 32, np.uint8)
        body = np.ones(len(x), bool)
        body[grown[:-1][some]] = False
        x[body] = buf
        buf, off = x, grown
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    kind = t["kind"][buf]
    start = kind == 2
    start[1:] |= (kind[:-1] == 2) | ((kind[1:] == 1) & (kind[:-1] != 1))
    start[off[:-1][some]] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(buf))
    raw = buf.tobytes()
    if cuts := [s[k] + np.array(cut_long(raw[s[k] : e[k]], t), np.int64) for k in np.flatnonzero(e - s > CHUNK_CHARS).tolist()]:
        s = np.sort(np.concatenate([s, *cuts]))
        e = np.append(s[1:], len(buf))
    _, pick, inv = np.unique(hash_ranges(buf, s, e), return_index=True, return_inverse=True)
    units = [raw[a:b] for a, b in zip(s[pick].tolist(), e[pick].tolist(), strict=True)]
    ids, ends, a, base = [], [], 0, 0
    total = np.cumsum([len(u) + 1 for u in units])
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK_CHARS, side="right")))
        i, end = encode_units(units[a:b], v)
        ids.append(i)
        ends.append(end + base)
        base += len(i)
        a = b
    ids, ends = np.concatenate(ids), np.concatenate(ends)
    begins = np.concatenate([[0], ends[:-1]])
    n = (ends - begins)[inv]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begins[inv], n)
    row = np.searchsorted(off, s, side="right") - 1
    return ids[at], np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=len(off) - 1).astype(np.int64))])


def decode_slice(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of lists of ids; bytes that aren't UTF-8 are replaced."""
    t = v.tables()
    begin, size = t["plain_end"][ids], np.diff(t["plain_end"])[ids]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
    data = t["plain"][at].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[off]
    texts = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [x[1:] if v.prefix and x[:1] == " " else x for x in texts]


def _encode(v: Vocabulary, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(column), SLICE):
                ids, ends = encode_slice(buf, off, v)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=[*b.schema.names, "ids"])

    return run


def _decode(v: Vocabulary, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(v.pieces)
        for b in batches:
            lists = b.column(column)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            ids = np.asarray(lists.flatten().fill_null(0))
            if len(ids) and (ids.min() < 0 or ids.max() >= known):
                raise ValueError("an id is outside the vocabulary")
            texts = decode_slice(ids, np.concatenate([[0], np.cumsum(n)]), v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return run


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} {kind}"


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>: the pieces of each whole text, equal to the public library's.

    Null and empty texts have no ids. A blank mark (U+2581) in a text counts as a blank.
    A column of docs that is named ids is replaced. Rows are independent of each other.
    """
    docs = docs.drop("ids")
    return docs.mapInArrow(_encode(Vocabulary.load(model), docs.columns.index(text_col)), _with(docs, "ids", "array<int>"))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded string: the text of each list of ids; '' for null and empty lists.

    Ids outside the vocabulary fail; a null id is the unknown piece. A column that is named
    decoded is replaced."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(Vocabulary.load(model), encoded.columns.index(ids_col)), _with(encoded, "decoded", "string"))


def _round_trip(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1), SLICE):
                ids, ends = encode_slice(buf, off, v)
                texts = buf.tobytes()
                exact = [x.encode() == texts[i:j] for x, i, j in zip(decode_slice(ids, ends, v), off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.record_batch({"id": b.column(0).slice(lo, hi - lo), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), "exact": pa.array(exact, pa.bool_())})

    return run


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids, exact (decoding gives the text back, null as empty;
    false only for texts with a blank mark). Encoded and decoded slice by slice in one task."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(_round_trip(Vocabulary.load(model)), f"id {d.schema['id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, exact boolean")
    return out.withColumnRenamed("id", id_col)
