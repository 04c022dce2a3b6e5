"""Substring dedup: remove words covered by a window that starts in a document of smaller id too.

A count-min sketch decides which windows need exact grouping:

1. Each input partition sketches its windows: per hash row, the sorted cells it touches,
   written as gaps of about a byte a window. The partition sketches are cut by cell range
   and merged there into saturating counts; of those, one bit a cell remains: count >= 2.
2. The bits are broadcast. Their size is a function of max_cells alone (DEPTH * max_cells / 8
   bytes at most, 64 MB for 0.9 GB of text); a larger corpus has a fuller sketch, so more
   windows go on, and no repeated one is ever lost, as counts are only overestimated.
3. Documents are dealt once into groups of about PART_BYTES, each in order of id; that
   exchange serves both this step and the last. A group sends its windows estimated repeated
   to hash ranges, where they are grouped by 126 bits: a 64-bit polynomial hash modulo 2 ** 64
   and 62 bits of two polynomials over a prime field. What a window costs on the way (16 bytes
   of hashes, its place in the group and the gap to the last id) doesn't depend on how many
   ranges there are. A group sends a window for its smallest document only, so a passage that
   a third of all documents share doesn't gather their number in one range.
4. Places to remove go back to the group, which keeps the words that no window covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import ascending, dealt_ascending, pack_gaps, parts, second_hash, split_words, text_bytes, text_slices, unpack_gaps, windows

DEPTH = 2
MAX_CELLS = 1 << 30  # a hash row; two rows of bits are 256 MB
SEGMENT_CELLS = 1 << 22  # counts that one reducer of the sketch holds
FLUSH_WINDOWS = 3_000_000  # whose cells a task holds
SLICE = 4 << 20  # text handled at once
RANGE_BYTES = 16 << 20  # text whose repeated windows one reducer gets
PART_BYTES = 8 << 20  # text of a group
NO_ID = np.iinfo(np.int64).max


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.uint32)


def _twice(c: np.ndarray) -> np.ndarray:
    """Sorted cells, each at most twice: more makes no difference to 'at least two'."""
    c = np.sort(c)
    keep = np.ones(len(c), bool)
    keep[2:] = c[2:] != c[:-2]
    return c[keep]


def _sketch(size: int, width: int):
    segments = max(1, width // SEGMENT_CELLS)

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        seg, data = [], []
        for row in range(DEPTH):
            c = _twice(cells(h, row, width))
            cut = np.searchsorted(c, np.arange(segments + 1, dtype=np.int64) * (width // segments))
            for s in range(segments):
                if cut[s + 1] > cut[s]:
                    seg.append(row * segments + s)
                    data.append(pack_gaps(c[cut[s] : cut[s + 1]].astype(np.int64) - s * (width // segments)))
        return pa.record_batch({"segment": pa.array(seg, pa.int32()), "gaps": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(0), SLICE):
                held.append(windows(split_words(buf, off), hi - lo, size)[1])
                if sum(map(len, held)) >= FLUSH_WINDOWS:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    return run


def _merge(width: int):
    n = width // max(1, width // SEGMENT_CELLS)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        count = np.zeros(n, np.uint8)
        for x in t.column("gaps").to_pylist():
            c = unpack_gaps(x)
            again = np.flatnonzero(c[1:] == c[:-1])
            count[c] += 1
            count[c[again]] += 1
            np.minimum(count, 2, out=count)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary())})

    return run


def merged_sketch(text: DataFrame, size: int, width: int) -> list[np.ndarray]:
    """The bits 'at least two' of each hash row."""
    segments = max(1, width // SEGMENT_CELLS)
    rows = text.mapInArrow(_sketch(size, width), "segment int, gaps binary").groupBy("segment").applyInArrow(_merge(width), "segment int, bits binary")
    bits = np.zeros((DEPTH * segments, -(-width // segments // 8)), np.uint8)
    for r in rows.toLocalIterator():
        bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return [bits[k * segments : (k + 1) * segments].reshape(-1) for k in range(DEPTH)]


def estimated_repeated(h: np.ndarray, bits: list[np.ndarray], width: int) -> np.ndarray:
    """Numbers of the windows that every hash row counts twice or more."""
    at = np.arange(len(h))
    for row in range(DEPTH):
        c = cells(h[at], row, width)
        at = at[(bits[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1]
    return at


def _same(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end number of each run of windows that agree in both hashes."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(h))[: len(start)]


def _in_order(t: pa.Table) -> pa.Table:
    """A group by id, nulls last: the same order whenever it is read. Only rows that are the same in all can change places."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _occurrences(size: int, width: int, ranges: int, shared):
    """Windows estimated repeated of a group of documents, dealt out by hash range."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bits, part = shared.value, key[0].as_py()
        t = _in_order(t)
        ids = t.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
        first, h, check, owner, n = [], [], [], [], 0
        for lo, hi, buf, off in text_slices(t.column("text"), SLICE):
            w = split_words(buf, off)
            at, one = windows(w, hi - lo, size)
            m = estimated_repeated(one, bits, width)
            if len(m):
                first.append(n + at[m])
                h.append(one[m])
                check.append(second_hash(buf, w, at[m], size))
                owner.append(ids[lo + w.row[at[m]]])
            n += len(w.row)
        if not first:
            return pa.table({c: pa.array([], k) for c, k in FOUND})
        first, h, check, owner = map(np.concatenate, (first, h, check, owner))
        # of a window, only the group's smallest document has to be compared with other groups;
        # its other occurrences are later ones whatever is found there
        order = np.lexsort((check, h))
        start, end = _same(h[order], check[order])
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(owner[order[start]], end - start)  # in a run, places ascend, so do ids
        late = owner > low
        slots, first, h, check, owner = first[late], first[~late], h[~late], check[~late], owner[~late]
        to = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        first, h, check, owner = first[order], h[order], check[order], owner[order]
        cut = np.searchsorted(to[order], np.arange(ranges + 1))
        base = int(owner.min())
        known = [b""] * ranges
        known[part % ranges] = dealt_ascending(slots, np.array([0, len(slots)]))[0]
        places, owners = dealt_ascending(first, cut), dealt_ascending(owner.view(np.uint64) - np.uint64(base & (1 << 64) - 1), cut)
        has = [r for r in range(ranges) if cut[r + 1] > cut[r] or known[r]]
        piece = lambda a: [a[cut[r] : cut[r + 1]].tobytes() for r in has]
        columns = (has, [part] * len(has), [base] * len(has), piece(h), piece(check), [owners[r] for r in has], [places[r] for r in has], [known[r] for r in has])
        return pa.table({c: pa.array(x, k) for (c, k), x in zip(FOUND, columns, strict=True)})

    return run


FOUND = [("range", pa.int32()), ("part", pa.int32()), ("base", pa.int64()), ("hash", pa.binary()), ("check", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("known", pa.binary())]
FOUND_SCHEMA = "range int, part int, base bigint, hash binary, check binary, ids binary, places binary, known binary"
MARK_SCHEMA = "part int, places binary"


def _later(t: pa.Table) -> pa.Table:
    """Reducer of a hash range: places of occurrences in documents above the window's smallest, and
    of those that their group knew to be, for each group."""
    parts, ids, places, h, check = [], [], [], [], []
    out: dict[int, list[np.ndarray]] = {}
    for part, base, one, other, owners, at, known in zip(*(t.column(c).to_pylist() for c in ("part", "base", "hash", "check", "ids", "places", "known")), strict=True):
        h.append(np.frombuffer(one, np.uint64))
        check.append(np.frombuffer(other, np.uint64))
        ids.append(ascending(owners, base))
        places.append(ascending(at))
        parts.append(np.full(len(h[-1]), part, np.int32))
        out.setdefault(part, []).append(ascending(known))
    h, check, ids, places, parts = map(np.concatenate, (h, check, ids, places, parts))
    order = np.lexsort((check, h))
    start, end = _same(h[order], check[order])
    low = np.minimum.reduceat(ids[order], start) if len(start) else ids
    later = order[ids[order] > np.repeat(low, end - start)]
    for part in np.unique(parts[later]).tolist():
        out[part].append(places[later[parts[later] == part]])
    ready = {p: np.sort(np.concatenate(x)) for p, x in out.items()}
    ready = {p: x for p, x in ready.items() if len(x)}
    return pa.table({"part": pa.array(list(ready), pa.int32()), "places": pa.array([dealt_ascending(x, np.array([0, len(x)]))[0] for x in ready.values()], pa.binary())})


def keep_words(buf: np.ndarray, off: np.ndarray, marks: np.ndarray, before: int, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each row of a slice: words, words removed, kept text. marks: places of windows, ascending;
    before: words of the group before the slice."""
    n = len(off) - 1
    w = split_words(buf, off)
    count = np.bincount(w.row, minlength=n)
    at = marks[slice(*np.searchsorted(marks, [before, before + len(w.row)]))] - before
    edge = np.zeros(len(w.row) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.bincount(w.row[keep], minlength=n)
    s, e, row = w.start[keep], w.end[keep], w.row[keep]
    cover = np.zeros(len(buf) + 1, np.int8)
    cover[s] += 1
    cover[e] -= 1
    mask = np.cumsum(cover[:-1], dtype=np.int8).view(bool)
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    out = buf.copy()
    out[e[~last]] = 32
    mask[e[~last]] = True
    size_of = np.bincount(row, weights=e - s, minlength=n).astype(np.int64) + np.maximum(kept - 1, 0)
    ends = np.concatenate([[0], np.cumsum(size_of)])
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[mask].tobytes()))
    return count, count - kept, text


def _kept(size: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        places = np.sort(np.concatenate([np.zeros(0, np.int64), *(ascending(x) for x in marks.column("places").to_pylist())]))
        n_words, n_removed, texts, before = [], [], [], 0
        for _, _, buf, off in text_slices(docs.column("text"), SLICE):
            n, gone, text = keep_words(buf, off, places, before, size)
            before += int(n.sum())
            n_words.append(n)
            n_removed.append(gone)
            texts.append(text)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(np.concatenate(n_words or [[]]), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed or [[]]), pa.int64()), "kept": pa.chunked_array(texts, pa.large_string()).cast(pa.string())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (its remaining words, one space between).

    Words are runs of bytes other than space and \\t to \\r, unchanged. A window is `size`
    consecutive words; each word covered by a window that also starts in a document of
    smaller id goes. All is judged on the input. Null texts have no words and keep ''.
    Shorter texts keep all. Rows of equal id never remove from each other; a null id counts
    as larger than any other. Repeated rows stay repeated. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = text_bytes(text)
    width = 1 << min(max(16, int(n / 6).bit_length()), int(max_cells).bit_length() - 1)
    ranges, dealt = parts(spark, n, RANGE_BYTES), parts(spark, n, PART_BYTES)
    bits = spark.sparkContext.broadcast(merged_sketch(text.select("text"), size, width))
    rows = text.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(dealt)).cast("int"))
    found = rows.groupBy("part").applyInArrow(_occurrences(size, width, ranges, bits), FOUND_SCHEMA)
    marks = found.groupBy("range").applyInArrow(_later, MARK_SCHEMA)
    out = rows.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_kept(size), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("doc_id", id_col)
