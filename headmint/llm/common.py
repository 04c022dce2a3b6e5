"""What the operators of this subpackage share: the shared folder, text slices and word hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headmint.sources.scratch import fresh_folder as shared_dir
from headmint.sources.scratch import stored
from headmint.sources.tables import table

__all__ = ["Words", "ascending", "dealt_ascending", "hash_ranges", "lower_ascii", "mix", "pack_gaps", "pack_varints", "parts", "runs", "second_hash", "shared_dir", "split_words", "stored", "table", "text_bytes", "text_slices", "unpack_gaps", "unpack_varints", "windows"]

SLICE_BYTES = 8 << 20  # text handled at once; a longer text makes a slice of its own
HASH_BYTES = 1 << 20  # bytes whose running hash is held at once; a longer word is hashed alone

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_2 = np.uint64(0x9FB21C651E98DF25)  # of the second hash


def parts(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Pieces of about `each` bytes, at least two for every core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(n_bytes) // each))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


# ---------------------------------------------------------------- text in numpy


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end number of each run of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.append(start[1:], len(keys))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1
        b = min(max(b, a + 1), a + max_rows, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)


@dataclass
class Words:
    """Words of a slice in order: byte range, row within the slice, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[base]


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hash of each byte range; the ranges are in order and apart."""
    out = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, side="right")))
        lo, hi = int(start[a]), int(end[b - 1])
        up, down = _power_tables(max(HASH_BYTES, hi - lo) + 1, base)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def split_words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text of a slice."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off, s, side="right") - 1
    return Words(s, e, row, hash_ranges(buf, s, e))


def windows(words: Words, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `size` words within one text, in order."""
    m = len(words.hash) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(size):
        h = h * _STEP + words.hash[j : j + m]
    first = np.flatnonzero(words.row[size - 1 :] == words.row[:m])
    return first, mix(h[first])


PRIME = (1 << 31) - 1
_FIELD_BASES = (1_103_515_245, 1_357_246_801)


def _field_powers(n: int, base: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo PRIME."""
    known = _fields.get(base)
    if known is None or len(known) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
        _fields[base] = known = out
    return known


_fields: dict[int, np.ndarray] = {}


def field_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hash of each byte range: two polynomials over a prime field, unlike those of hash_ranges."""
    out = np.zeros(len(start), np.uint64)
    prime, shift = np.uint64(PRIME), np.uint64(31)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, side="right")))
        lo, hi = int(start[a]), int(end[b - 1])
        s, e, x = start[a:b] - lo, end[a:b] - lo, buf[lo:hi].astype(np.uint64) + np.uint64(1)
        for base in _FIELD_BASES:
            n = max(HASH_BYTES, hi - lo) + 1
            up, down = _field_powers(n, base), _field_powers(n, pow(base, -1, PRIME))
            run = np.zeros(hi - lo + 1, np.uint64)  # of numbers below 2 ** 31: exact up to 2 ** 33 bytes
            np.cumsum(x * up[: hi - lo] % prime, out=run[1:])
            h = (run[e] - run[s]) % prime * down[s] % prime
            out[a:b] = (out[a:b] << shift) | ((h + (e - s).astype(np.uint64)) % prime)
        a = b
    return out


def second_hash(buf: np.ndarray, words: Words, first: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the windows that start at these words, from other word hashes than `windows` takes."""
    other = field_hashes(buf, words.start, words.end)
    h = np.zeros(len(first), np.uint64)
    for j in range(size):
        h = h * _STEP_2 + other[first + j]
    return mix(h)


def pack_varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in groups of seven bits, the eighth meaning "more"; and where each ends."""
    v = v.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        m = n > k
        out[ends[m] - n[m] + k] = (v[m] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | ((n[m] > k + 1).astype(np.uint8) << 7)
    return out, ends


def unpack_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(start, last + 1 - start)) * 7
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << shift.astype(np.uint64), start)


def dealt_ascending(values: np.ndarray, cut: np.ndarray, base: int = 0) -> list[bytes]:
    """Each piece cut[r]:cut[r + 1] of the values, ascending from base on within a piece, as gaps."""
    gap = np.diff(values, prepend=values[:1])
    starts = cut[:-1][cut[:-1] < cut[1:]]
    gap[starts] = values[starts] - base
    data, ends = pack_varints(gap.view(np.uint64) if gap.dtype == np.int64 else gap)
    at = np.concatenate([[0], ends])[cut]
    return [data[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def ascending(data: bytes, base: int = 0) -> np.ndarray:
    """What dealt_ascending wrote, as signed numbers."""
    return (np.cumsum(unpack_varints(data), dtype=np.uint64) + np.uint64(base & (1 << 64) - 1)).view(np.int64)


def pack_gaps(ascending: np.ndarray, kind: type = np.uint8) -> bytes:
    """Gaps of ascending numbers: a byte (or kind) each, its highest value meaning "add it and read on"."""
    top = np.iinfo(kind).max
    gap = np.diff(ascending.astype(np.int64), prepend=0)
    more = gap // top
    out = np.full(len(gap) + int(more.sum()), top, kind)
    out[np.cumsum(more + 1) - 1] = gap % top
    return out.tobytes()


def unpack_gaps(data: bytes, kind: type = np.uint8) -> np.ndarray:
    b = np.frombuffer(data, kind)
    return np.cumsum(b, dtype=np.int64)[b != np.iinfo(kind).max]
