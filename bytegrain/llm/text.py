"""Vectorised byte-level text work on Arrow string columns: spans, lines and hashes without a Python object per word.

All functions take the concatenated UTF-8 bytes of a slice of documents and the offsets of each document in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
U64 = np.uint64


def byte_set(members: bytes) -> np.ndarray:
    """A truth table over the 256 byte values."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: [\x20\x09-\x0D]
SPACE = byte_set(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that column `name` has at most `limit` bytes in each piece, or the piece is one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64))
    low, base = 0, 0
    while low < batch.num_rows:
        high = max(int(np.searchsorted(ends, base + limit, "right")), low + 1)
        yield batch.slice(low, high - low)
        low, base = high, int(ends[high - 1])


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside `separator`, never across documents, and each document's first span."""
    n = len(data)
    inside = ~separator[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-split lines, and each document's first line. Every document has a line at least."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    # a document's own start comes before the starts of its other lines, and those of earlier documents that end there
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    first = np.searchsorted(owner[order], np.arange(len(offsets)))
    starts = starts[order]
    stop = np.append(starts[1:] - 1, 0)
    last = first[1:] - 1
    stop[last] = offsets[1:]
    return starts, stop, first


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Two independent polynomials; the base and the values of bytes follow from their number.
_BASES = [int(mixed(np.array([k + 11], U64))[0]) | 1 for k in range(2)]
_VALUES = [mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(k << 32)) for k in range(2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        size = max(n + 1, 1 << 16)
        pair = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            out = np.full(size, base, U64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        _POWERS[which] = tuple(pair)
    return _POWERS[which]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the bytes lie."""
    up, down = _powers(which, len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[which][data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive words, by their hashes; the last size-1 words start none."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    up, down = _powers(which, n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mixed(words + U64(which)) * up[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each span, from each document's first span."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, which may be empty."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [start, start + size)."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    edge -= np.bincount(np.minimum(starts + size, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
