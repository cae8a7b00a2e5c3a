"""SimHash near-duplicates, compared by bit planes.

A fingerprint has one or more words of 64 bits. Fingerprints that differ in few bits agree on some of the bit sets that serve as keys
(`choices`: every pair within the radius agrees on one; `tables`: for a wide radius, a stated share of pairs does), so each fingerprint is
sent under each key. Under one value of a key, fingerprints are stored as bit planes of packed words; a query's distances to 64 fingerprints
(in small groups: those of 64 pairs) are counted at once by carry-save adders, and a block is abandoned once all its distances exceed the
radius. Only links of a spanning forest leave a task, so no group emits its pairs; those linked to a large group's first fingerprint are
not compared among each other.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import PACKED_SCHEMA, Sieve, dealt, mapped, packed, packed_rows, runs, sieve, sifted, stored, unpacked, unused, width
from .text import LOWER, SPACE, buffer, mixed, slices, spans

U64 = np.uint64
SEED = 42
LANES = U64(0x0101010101010101)
STRIDE = 0x9E3779B97F4A7C15
#: Groups of so many rows at most are compared pair by pair, 64 pairs to a word; in larger ones a row meets 64 others at a time.
SMALL_GROUP = 48

#: Of 256 bits: texts of similarity 0.8 (a cosine of 2 s / (1 + s)) differ in 39 bits on average, with a deviation of 6.
WIDE_RADIUS = 45
#: Of 256 bits, for candidates that are verified: 3.7 deviations above the mean at 0.8 of sets of five hashes (where chance is at its worst: 48
#: bits), 5.7 above that of large ones (39), so that the radius itself loses no pair to speak of.
CANDIDATE_RADIUS = 72
#: Words of the fingerprints by which candidates are ruled out before they are verified, and deviations above the mean that they may reach.
WIDE_WORDS, DEVIATIONS = 16, 3.7
#: The share of pairs at a similarity of 0.8 that may agree under none of the masks, and how many strangers a fingerprint may meet under one.
CANDIDATE_MISS, STRANGERS = 0.001, 64


def strides(w: int) -> np.uint64:
    """w steps of an odd constant, modulo 2^64."""
    return U64(w * STRIDE & 0xFFFFFFFFFFFFFFFF)


def shingled(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and where each document's begin."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SPACE)
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])  # of words in the text joined by single spaces
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    flags = np.cumsum(edge[:-1]) > 0
    joined = np.full(at[-1], 32, np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    joined[keep] = data[flags]
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    low = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    high = low + np.repeat(np.minimum(n, shingle), count)
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    step, a, b, out = 1 << 16, at[low], at[high] - 1, np.empty(len(low), U64)
    for k in range(0, len(low), step):
        out[k : k + step] = [digest(raw[x:y], SEED) for x, y in zip(a[k : k + step].tolist(), b[k : k + step].tolist())]
    return out, begin


def voted(hashes: np.ndarray, begin: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of documents whose hashes begin at `begin`."""
    count = np.diff(begin)
    ones = np.zeros((len(count), words, 64), np.int64)
    step = 1 << 16
    for k in range(0, len(hashes), step):
        h = hashes[k : k + step]
        which = np.searchsorted(begin, np.arange(k, k + len(h)), "right") - 1
        cut = np.union1d(runs(which), np.arange(0, len(h), 255))  # a byte counts 255 at most
        many = runs(which[cut])
        for w in range(words):
            g = mixed(h + strides(w)) if w else h
            for shift in range(8):
                lanes = np.add.reduceat((g >> U64(shift)) & LANES, cut)
                ones[which[cut[many]], w, shift::8] += np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), many, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None, None], axis=2, bitorder="little").view(U64).reshape(-1, words)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, words: int = 1) -> np.ndarray:
    """A fingerprint of each document, in a row of `words` words: a bit is 1 if it is set in over half the hashes of its shingles, which
    are their XXH64 in the first word and what `mixed` makes of these in the others."""
    return voted(*shingled(data, offsets, shingle), words)


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in order, and where they begin."""
    which = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    hashes = hashes[np.lexsort((hashes, which))]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (which[1:] != which[:-1])
    return hashes[first], np.searchsorted(which[first], np.arange(len(begin)))


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits of each set of hashes."""
    out = np.empty((len(begin) - 1, 2), U64)
    for k in range(2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(values + strides(k + 1)), dtype=U64)])
        out[:, k] = sums[begin[1:]] - sums[begin[:-1]]
    return out


#: Half the side of the squares that a transposition swaps, and the bits of a word that stay.
_SWAPS = [(j, U64(sum(((1 << j) - 1) << k for k in range(0, 64, 2 * j)))) for j in (32, 16, 8, 4, 2, 1)]


def planes(values: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Bit planes of rows of words: bit j of word w of plane b is bit b of row 64 w + j. Squares of 64 rows and bits are transposed by halves."""
    words = values.shape[1]
    out = np.empty((64 * words, len(values) // 64), U64)
    for k in range(0, len(values), step):
        x = np.ascontiguousarray(values[k : k + step].T).reshape(-1, 64)
        for j, stay in _SWAPS:
            y = x.reshape(-1, 32 // j, 2, j)
            a, b = y[:, :, 0], y[:, :, 1]
            t = ((a >> U64(j)) ^ b) & stay
            b ^= t
            a ^= t << U64(j)
        n = len(x) // words
        out[:, k // 64 : k // 64 + n] = x.reshape(words, n, 64).transpose(0, 2, 1).reshape(64 * words, n)
    return out


def _saved(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bits in each place: the sums and the carries."""
    one = a ^ b
    return one ^ c, (a & b) | (one & c)


def _counted(counters: list[np.ndarray], over: np.ndarray, p: list[np.ndarray]) -> None:
    """Adds eight planes to bit-sliced counters, in place; `over` gets what no longer fits."""
    ones, twos, fours = counters[:3]
    ones, x = _saved(ones, p[0], p[1])
    ones, y = _saved(ones, p[2], p[3])
    twos, u = _saved(twos, x, y)
    ones, x = _saved(ones, p[4], p[5])
    ones, y = _saved(ones, p[6], p[7])
    twos, v = _saved(twos, x, y)
    fours, carry = _saved(fours, u, v)
    counters[:3] = ones, twos, fours
    for c in range(3, len(counters)):
        counters[c], carry = counters[c] ^ carry, counters[c] & carry
    over |= carry


def _levels(radius: int) -> int:
    """Counters of so many bits hold any number up to the radius, and tell what is beyond it."""
    return max(3, int(radius + 1).bit_length())


def near(queries: np.ndarray, rows: np.ndarray, cols: np.ndarray, stored_planes: np.ndarray, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, value) within the radius, for the pairs of a query and a word of 64 values in rows and cols. live: the values of
    a word that count. Distances are counted 64 at a time by carry-save addition; a word is left once all its values are too far."""
    full, total = ~U64(0), 64 * queries.shape[1]
    counters = [np.zeros(len(rows), U64) for _ in range(_levels(radius))]
    over = ~live[cols]
    for b in range(0, total, 8):
        bits = queries[:, b // 64] >> U64(b % 64)
        _counted(counters, over, [stored_planes[b + k][cols] ^ (U64(0) - ((bits >> U64(k)) & U64(1)))[rows] for k in range(8)])
        if total == 64 or b % 32 == 24:
            keep = (over | _exceeds(counters, radius)) != full
            if not keep.all():
                rows, cols, over, counters = rows[keep], cols[keep], over[keep], [c[keep] for c in counters]
            if not len(rows):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = ~(over | _exceeds(counters, radius))
    bits = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, j = np.nonzero(bits)
    return rows[w], cols[w] * 64 + j


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the number in bit-sliced counters is over the radius."""
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~U64(0))
    for c in reversed(range(len(counters))):
        if (radius >> c) & 1:
            equal = equal & counters[c]
        else:
            greater |= equal & counters[c]
            equal = equal & ~counters[c]
    return greater


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows a[i] and b[i] are within the radius: the planes of their differences, 64 pairs to a word, added up as in `near`."""
    apart = np.zeros((-(-len(a) // 64) * 64, a.shape[1]), U64)
    apart[: len(a)] = a ^ b
    table = planes(apart)
    left, out = np.arange(table.shape[1]), np.zeros(table.shape[1], U64)
    counters, over = [np.zeros(len(left), U64) for _ in range(_levels(radius))], np.zeros(len(left), U64)
    for k in range(0, len(table), 8):
        _counted(counters, over, [p[left] if len(left) < len(p) else p for p in table[k : k + 8]])
        if k % 64 == 56 and k + 8 < len(table):
            keep = (over | _exceeds(counters, radius)) != ~U64(0)
            if not keep.all():
                left, over, counters = left[keep], over[keep], [c[keep] for c in counters]
    out[left] = ~(over | _exceeds(counters, radius))
    return np.unpackbits(out.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def small_forest(values: np.ndarray, cut: np.ndarray, radius: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the rows within the radius, in groups of SMALL_GROUP rows at most: the groups of one size at a time."""
    sizes = np.diff(cut)
    for n in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        begin = cut[:-1][sizes == n]
        for k in range(0, len(begin), max(1, step // len(i))):
            some = begin[k : k + max(1, step // len(i)), None]
            hits = near_pairs(values[(some + i).ravel()], values[(some + j).ravel()], radius).reshape(len(some), len(i))
            hit = hits.any(1)
            some, hits = some[hit, 0], hits[hit]
            label = np.tile(np.arange(n), (len(some), 1))
            for p in np.flatnonzero(hits.any(0)).tolist() if len(some) else ():
                x, y = label[:, i[p]].copy(), label[:, j[p]].copy()
                new = np.flatnonzero(hits[:, p] & (x != y))
                if len(new):
                    own = label[new]
                    label[new] = np.where(own == y[new, None], x[new, None], own)
                    yield some[new] + i[p], some[new] + j[p]


def forest(values: np.ndarray, cut: np.ndarray, radius: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the rows within the radius, in each group [cut[i], cut[i + 1]) on its own.

    A group's rows fill words of their own. Where they fill several, all are compared with the group's first row, and those that it
    links come first: they are connected, so only the others are queries. A query is compared with the words up to its own, `step`
    such pairs of a row and a word at a time.
    """
    sizes = np.diff(cut)
    words = -(-sizes // 64)
    word_of = np.concatenate([[0], np.cumsum(words)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(values)) - cut[:-1][group]
    place = word_of[group] * 64 + rank
    flags = np.zeros(word_of[-1] * 64, np.uint8)
    flags[place] = 1
    live = np.packbits(flags, bitorder="little").view(U64)

    def laid(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded, index = np.zeros((len(flags), values.shape[1]), U64), np.zeros(len(flags), np.int64)
        padded[place], index[place] = values[order], order
        return planes(padded), index

    order = np.arange(len(values))
    table, index = laid(order)
    parent = np.arange(len(values))
    asks = np.ones(len(values), bool)
    wide = words > 1
    if wide.any():
        rows, cols = np.repeat(cut[:-1], words * wide), np.flatnonzero(np.repeat(wide, words))
        for k in range(0, len(rows), step):
            q, v = near(values, rows[k : k + step], cols[k : k + step], table, live, radius)
            parent[index[v]] = q
        asks = (parent == order) & ~(wide[group] & (rank == 0))
        order = np.lexsort((asks, group))
        table, index = laid(order)
    linked = np.flatnonzero(parent != np.arange(len(values)))
    left, right = linked.tolist(), parent[linked].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    queries = np.flatnonzero(asks[order])  # by place in the order
    asked = rank[queries] // 64 + 1
    ends = np.cumsum(asked)
    low = 0
    while low < len(queries):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, "right")))
        n, who = asked[low:high], queries[low:high]
        rows = np.repeat(order[who], n)
        cols = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(word_of[group[who]], n)
        q, v = near(values, rows, cols, table, live, radius)
        v = index[v]
        if len(q):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            pairs = np.unique(np.stack([np.maximum(parent[q], parent[v]), np.minimum(parent[q], parent[v])], 1), axis=0)
            for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    left.append(x)
                    right.append(y)
        low = high
    return np.array(left, np.int64), np.array(right, np.int64)


def choices(radius: int, keys: int) -> list[np.ndarray]:
    """Masks of every choice of `keys` of radius + keys blocks that the 64 bits are cut in."""
    blocks = radius + keys
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [np.array([sum(block[i] for i in some)], U64) for some in combinations(range(blocks), keys)]


def growing_tables(rows: int, words: int = 4, similarity: float = 0.8, miss: float = CANDIDATE_MISS) -> list[np.ndarray]:
    """Masks for so many distinct fingerprints: the more there are, the more bits a mask has, so that a fingerprint meets STRANGERS others
    by chance at most, and the more masks, so that a pair of the similarity is missed by all with the same small probability. Comparisons
    therefore grow with rows ** 1.24 at 0.8, not with their square."""
    bits, size, p = max(12, math.ceil(math.log2(max(1, rows) / STRANGERS))), 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    apart = np.array([math.comb(size, d) * p**d * (1 - p) ** (size - d) for d in range(size + 1)])  # the chance of each distance
    agree = np.array([math.comb(size - d, bits) / math.comb(size, bits) for d in range(size + 1)])  # and of agreeing under one mask then
    count = 1
    while (apart * (1 - agree) ** count).sum() > miss:
        count += max(1, count // 50)
    return tables(words, count, bits)


def tables(words: int, count: int, bits: int) -> list[np.ndarray]:
    """`count` masks of `bits` bits of `words` words, drawn from a fixed seed. Of pairs that differ in a share p of their bits, a share
    1 - (1 - (1 - p) ** bits) ** count agrees on one of them."""
    draw = np.random.default_rng(SEED)
    out = []
    for _ in range(count):
        flags = np.zeros(64 * words, np.uint8)
        flags[draw.choice(64 * words, bits, replace=False)] = 1
        out.append(np.packbits(flags, bitorder="little").view(U64))
    return out


def _column(values: np.ndarray) -> pa.Array:
    """Rows of words as a column: a signed long of one word, else their bytes."""
    return pa.array(values[:, 0].view(np.int64)) if values.shape[1] == 1 else _bytes(values)


def _bytes(values: np.ndarray) -> pa.Array:
    flat = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * values.shape[1]), len(values), [None, flat]).cast(pa.binary())


def _words(column: pa.Array, words: int) -> np.ndarray:
    if words == 1:
        return np.asarray(column, dtype=np.int64).view(U64).reshape(-1, 1)
    return buffer(column)[0].view(U64).reshape(-1, words)


def _kind(words: int) -> str:
    return "bigint" if words == 1 else "binary"


def _folded(values: np.ndarray) -> np.ndarray:
    """A hash of each row of words."""
    out = np.zeros(len(values), U64)
    for w in range(values.shape[1]):
        out = mixed(out * U64(STRIDE) + values[:, w] + U64(1))
    return out


def _portions(cut: np.ndarray, most: int = 1 << 12) -> Iterator[np.ndarray]:
    """The groups' edges, a portion at a time that fills `most` words of 64 rows, or has one group."""
    ends, low = np.cumsum(-(-np.diff(cut) // 64)), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield cut[low : high + 1]
        low = high


def _sent(prints: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """Packed fingerprints to the partitions of their values under each mask."""
    n, words = width(prints.sparkSession), len(masks[0])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _words(batch.column(0), words)
            whole: list[list[np.ndarray]] = [[] for _ in range(n)]
            for k, mask in enumerate(masks):
                where = (mixed(_folded(fp & mask) + U64(k)) >> U64(40)) % U64(n)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(n + 1))
                for i in range(n):
                    whole[i].append(order[edges[i] : edges[i + 1]].astype(np.uint32))
            for i in range(n):  # each goes to a partition once, with the numbers of those under each mask
                own = np.unique(np.concatenate(whole[i]))
                if len(own):
                    yield packed_rows([i], [packed([fp[own].ravel(), *(_narrow(np.searchsorted(own, x)) for x in whole[i])])])

    return dealt(prints.select("fp").transform(mapped, send, PACKED_SCHEMA), n)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _forests(batches: Iterator[pa.RecordBatch], radius: int, masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints: links of a spanning forest of those that are within the radius, under each value of each mask."""
    words, parts, under, base = len(masks[0]), [], [[] for _ in masks], 0
    for batch in batches:
        for blob in batch.column("blob"):
            fp, *mine = unpacked(blob.as_py())
            parts.append(fp.reshape(-1, words))
            for k, x in enumerate(mine):
                under[k].append(x.astype(np.int64) + base)
            base += len(parts[-1])
    whole = np.concatenate(parts) if parts else np.zeros((0, words), U64)
    for mask, at in zip(masks, under):
        if not at:
            continue
        at = np.concatenate(at)
        key = _folded(whole[at] & mask)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sizes = np.diff(np.append(runs(key), len(at)))
        few = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
        small = whole[at[few]]
        for x, y in small_forest(small, np.append(runs(key[few]), len(small)), radius):
            yield small[x], small[y]
        many = np.repeat(sizes > SMALL_GROUP, sizes)
        at, key = at[many], key[many]
        for edges in _portions(np.append(runs(key), len(at))):
            own = whole[at[edges[0] : edges[-1]]]
            a, b = forest(own, edges - edges[0], radius)
            yield own[a], own[b]


def links(prints: DataFrame, radius: int, masks: list[np.ndarray]) -> DataFrame:
    """Links (a, b: fingerprints) that connect all fingerprints `fp`, each there once, that are within the radius and agree under one of the
    masks at least, through others where need be."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _forests(batches, radius, masks):
            yield pa.RecordBatch.from_arrays([_column(a), _column(b)], ["a", "b"])

    kind = _kind(len(masks[0]))
    return _sent(prints, masks).transform(mapped, compare, f"a {kind}, b {kind}").distinct()


def once(frame: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """Rows of words that come packed from many tasks, each once: columns by their names and numbers of words."""
    words, n = sum(k for _, k in names), width(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(blob.as_py())[0].reshape(-1, words) for batch in batches for blob in batch.column("blob")]
        if parts:
            rows, at, columns = np.unique(np.concatenate(parts), axis=0), 0, []
            for _, k in names:
                columns.append(_bytes(rows[:, at : at + k]))
                at += k
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in names])

    return dealt(frame, n).transform(mapped, run, ", ".join(f"{c} binary" for c, _ in names))


def _addressed(rows: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows of words, each of them once, to partitions by their hash."""
    rows = np.unique(rows, axis=0)
    where = ((_folded(rows) >> U64(40)) % U64(n)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield packed_rows([i], [packed([rows[order[edges[i] : edges[i + 1]]].ravel()])])


def touched(prints: DataFrame, radius: int, masks: list[np.ndarray]) -> DataFrame:
    """The fingerprints `fp`, each there once, that have another one within the radius that agrees under one of the masks."""
    n, words = width(prints.sparkSession), len(masks[0])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for pair in _forests(batches, radius, masks):
            found += pair
            held += len(pair[0])
            if held > 1 << 18:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
        if found:
            yield from _addressed(np.concatenate(found), n)

    return once(_sent(prints, masks).transform(mapped, compare, PACKED_SCHEMA), [("fp", words)])


def fingerprinted(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """doc_id and fp: the fingerprint as a signed long, or the bytes of its words where it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                fp = fingerprints(*buffer(piece.column("text")), shingle, words)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _column(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(mapped, run, f"doc_id bigint, fp {_kind(words)}")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, masks: list[np.ndarray] | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links) for every document.

    By default, fingerprints of 256 bits that agree under one of 40 masks of 16 bits and differ in WIDE_RADIUS bits at most. Null and
    empty texts have fingerprint zero and link like any other. Fewer words than a shingle make one shingle. Equal rows meet in one
    component; a null doc_id takes part and counts as larger than all others. An empty table gives an empty one; other columns than
    doc_id and text are not read.
    """
    masks = tables(4, 40, 16) if masks is None else masks
    prints = stored(fingerprinted(docs, shingle, len(masks[0])))
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups, radius, masks))
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    many = stored(rooted.join(ids, "root").select("fp", "component_id").filter(F.col("component_id").isNotNull()))
    return with_group(prints, groups, many)


def with_group(prints: DataFrame, groups: DataFrame, many: DataFrame) -> DataFrame:
    """Each document with its fingerprint's component; the join is one that Spark splits where a fingerprint is hot."""
    return prints.join(many, "fp", "left").select("doc_id", "fp", "component_id")


def _sets(docs: DataFrame, shingle: int, by: Sieve) -> DataFrame:
    """sig, items (each text's distinct shingle hashes in order) and wide, their fingerprint of WIDE_WORDS words, of the rows (text, h) whose h
    passes the sieve."""
    sent = docs.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sent.value.passes(np.asarray(batch.column("h"), dtype=np.int64).view(U64))))
            for piece in slices(some, "text", 1 << 20):
                values, begin = distinct(*shingled(*buffer(piece.column("text")), shingle))
                items = pa.array([values[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([_column(signatures(values, begin)), items, _bytes(voted(values, begin, WIDE_WORDS))], ["sig", "items", "wide"])

    return docs.select("text", "h").transform(mapped, run, "sig binary, items binary, wide binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b: sigs) with `same`: whether the sets' exact Jaccard similarity is `similarity` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                same.append(shared >= similarity * (len(both) - shared) - 1e-9)  # 0.8 of a number may lie a little above it
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b")), pa.array(same, pa.bool_())], ["a", "b", "same"])

    found = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
    return found.select("a", "b", "x", "y").transform(mapped, run, "a binary, b binary, same boolean")


def differing(a: int, b: int, similarity: float) -> float:
    """The share of bits in which the fingerprints of sets of a and b random hashes differ at most, where their similarity is the least allowed.

    A bit is the majority of the hashes' bits; up to 64 hashes the chance is summed exactly, beyond by the angle between the sets.
    """
    common = min(a, b, math.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))
    if max(a, b) > 64:
        return math.acos(min(1.0, common / math.sqrt(a * b))) / math.pi
    total = 0.0
    for k in range(common + 1):
        over = [sum(math.comb(n - common, j) for j in range(n - common + 1) if 2 * (k + j) > n) / 2 ** (n - common) for n in (a, b)]
        total += math.comb(common, k) / 2**common * (over[0] * (1 - over[1]) + over[1] * (1 - over[0]))
    return total


@functools.lru_cache(1 << 16)
def wide_radius(a: int, b: int, similarity: float) -> int:
    """Bits of a wide fingerprint in which sets of a and b hashes may differ; -1 where their sizes alone rule the similarity out."""
    a, b = min(a, b), max(a, b)
    if a < similarity * b - 1e-9:
        return -1
    bits, p = 64 * WIDE_WORDS, differing(a, b, similarity) if b else 0.0
    return math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def near_all(values: np.ndarray, cut: np.ndarray, radius: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group within the radius, some at a time; for those who keep few of them."""
    sizes = np.diff(cut)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_GROUP)]).tolist():
        i, j = np.triu_indices(n, 1)
        begin = cut[:-1][sizes == n]
        for k in range(0, len(begin), max(1, step // len(i))):
            some = begin[k : k + max(1, step // len(i)), None]
            a, b = (some + i).ravel(), (some + j).ravel()
            hit = near_pairs(values[a], values[b], radius)
            yield a[hit], b[hit]
    for low, n in zip(cut[:-1][sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        words = -(-n // 64)
        padded = np.zeros((64 * words, values.shape[1]), U64)
        padded[:n] = values[low : low + n]
        table, live = planes(padded), np.full(words, ~U64(0))
        if n % 64:
            live[-1] = U64((1 << n % 64) - 1)
        for k in range(0, n, max(1, step // words)):
            rows = np.arange(k, min(n, k + max(1, step // words)))
            a, b = near(padded, np.repeat(rows, words), np.tile(np.arange(words), len(rows)), table, live, radius)
            yield low + a[a < b], low + b[a < b]


def nearest(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` nearest of the label of either of their rows."""
    keep = np.zeros(len(a), bool)
    for own in (label[a], label[b]):
        order = np.lexsort((b, a, apart, own))
        begin = runs(own[order])
        rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        keep[order[rank < most]] = True
    return keep


def candidates(prints: np.ndarray, wide: np.ndarray, size: np.ndarray, label: np.ndarray, cut: np.ndarray, radius: int, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a group that may be similar and have different labels: of each label the `most` nearest, and which rows are in a pair that was left out."""
    left, right, gaps, more = (np.zeros(0, np.int64),) * 3 + (np.zeros(len(prints), bool),)
    for a, b in near_all(prints, cut, radius):
        other = label[a] != label[b]
        a, b = a[other], b[other]
        if not len(a):
            continue
        kinds, which = np.unique(np.stack([size[a], size[b]], 1), axis=0, return_inverse=True)
        most_apart = np.array([wide_radius(int(x), int(y), similarity) for x, y in kinds])[which.ravel()]
        apart = np.concatenate([np.bitwise_count(wide[a[k : k + (1 << 14)]] ^ wide[b[k : k + (1 << 14)]]).sum(1, dtype=np.int64) for k in range(0, len(a), 1 << 14)])
        ok = apart <= most_apart
        left, right, gaps = (np.concatenate(x) for x in ((left, a[ok]), (right, b[ok]), (gaps, apart[ok])))
        keep = nearest(label, left, right, gaps, most)
        more[left[~keep]] = more[right[~keep]] = True
        left, right, gaps = left[keep], right[keep], gaps[keep]
    return left, right, more


def _proposed(members: DataFrame, masks: list[np.ndarray], radius: int, similarity: float, most: int) -> DataFrame:
    """Pairs (a, b: sigs) to verify next: under each value of each mask, of each label the `most` nearest pairs with another one. A pair of
    equal ones says that some with it were left out."""
    n, words = width(members.sparkSession), len(masks[0])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, wide = _words(batch.column("fp"), words), _words(batch.column("wide"), WIDE_WORDS)
            sig, label = (_words(batch.column(c), 2) for c in ("sig", "label"))
            rows = np.concatenate([fp, wide, sig, _folded(label)[:, None], np.asarray(batch.column("size"), dtype=np.int64).view(U64)[:, None]], axis=1)
            whole: list[list[np.ndarray]] = [[] for _ in range(n)]
            for k, mask in enumerate(masks):
                where = (mixed(_folded(fp & mask) + U64(k)) >> U64(40)) % U64(n)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(n + 1))
                for i in range(n):
                    whole[i].append(order[edges[i] : edges[i + 1]].astype(np.uint32))
            for i in range(n):  # each row goes to a partition once, with the numbers of those under each mask
                own = np.unique(np.concatenate(whole[i]))
                if len(own):
                    yield packed_rows([i], [packed([rows[own].ravel(), *(_narrow(np.searchsorted(own, x)) for x in whole[i])])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, under, base = [], [[] for _ in masks], 0
        for batch in batches:
            for blob in batch.column("blob"):
                rows, *mine = unpacked(blob.as_py())
                parts.append(rows.reshape(-1, words + WIDE_WORDS + 4))
                for k, x in enumerate(mine):
                    under[k].append(x.astype(np.int64) + base)
                base += len(parts[-1])
        if not parts:
            return
        rows = np.concatenate(parts)
        parts.clear()
        fp, wide, sig, size = np.ascontiguousarray(rows[:, :words]), rows[:, words : words + WIDE_WORDS], rows[:, words + WIDE_WORDS : words + WIDE_WORDS + 2], rows[:, -1].astype(np.int64)
        label = np.unique(rows[:, -2], return_inverse=True)[1]
        found, left_out = [], np.zeros(len(rows), bool)
        for mask, at in zip(masks, under):
            at = np.concatenate(at)
            key = _folded(fp[at] & mask)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            cut = np.append(runs(key), len(at))
            many = np.repeat(np.diff(cut) > 1, np.diff(cut))
            at, key = at[many], key[many]
            if not len(at):
                continue
            a, b, more = candidates(fp[at], wide[at], size[at], label[at], np.append(runs(key), len(at)), radius, similarity, most)
            left_out[at[more]] = True
            found.append(np.stack([np.minimum(at[a], at[b]), np.maximum(at[a], at[b])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        x, y = sig[pairs[:, 0]], sig[pairs[:, 1]]
        ahead = (x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1]))
        both = np.where(ahead[:, None], np.concatenate([x, y], 1), np.concatenate([y, x], 1))
        yield from _addressed(np.concatenate([both, np.tile(sig[left_out], (1, 2))]), n)

    found = dealt(members.select("fp", "wide", "sig", "label", "size").transform(mapped, send, PACKED_SCHEMA), n).transform(mapped, compare, PACKED_SCHEMA)
    return once(found, [("a", 2), ("b", 2)])


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = CANDIDATE_RADIUS, masks: list[np.ndarray] | None = None) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by verified links) for every document.

    Fingerprints only make candidates: within the radius, in agreement under a mask, and near enough in a wider fingerprint. A link counts if
    the exact Jaccard similarity of the sets of shingles is `similarity` or more. Texts are verified round by round: each verified group
    proposes its nearest pairs with others, which are joined with their sets of shingles; groups that a true link joins are one from then on,
    so that a large group takes few pairs. It ends when no candidate between two groups is left untested, so a false one loses no true one.
    Texts with equal sets are one node. Null and doubled doc_ids are as in `near_duplicates`.
    """
    words = 4 if masks is None else len(masks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, begin = shingled(*buffer(piece.column("text")), shingle)
                values, edges = distinct(hashes, begin)
                columns = [piece.column("doc_id"), piece.column("key"), _bytes(voted(hashes, begin, words)), _column(signatures(values, edges)), pa.array(np.diff(edges))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "sig", "size"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    prints = stored(keyed.transform(mapped, run, "doc_id bigint, key bigint, fp binary, sig binary, size bigint"))
    nodes = stored(prints.groupBy("sig", "fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key")).alias("row"), F.min("size").alias("size")))
    first = stored(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    masks = growing_tables(first.count(), words, similarity) if masks is None else masks
    near_ones = touched(first, radius, masks).unionAll(first.filter("n > 1").select("fp")).distinct()
    active = stored(nodes.join(near_ones, "fp", "left_semi").select("sig", "fp", "size", "row"))
    # one row of each active set is read again; a sieve lets them and few others pass, so that texts are not shuffled
    one = active.groupBy("sig").agg(F.min("row").alias("row")).select(F.xxhash64("row.doc_id", "row.key").alias("h"))
    sets = stored(_sets(keyed.withColumn("h", F.xxhash64("doc_id", "key")), shingle, sieve(one)).dropDuplicates(["sig"]))
    members = stored(active.join(sets.select("sig", "wide"), "sig").select("sig", "fp", "wide", "size", F.col("sig").alias("label")))
    labels = stored(members.select("sig", "label").distinct())
    tested, most = None, 2
    while True:
        asked = stored(_proposed(members, masks, radius, similarity, most))
        fresh = asked.filter("a <> b")
        fresh = fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti")
        found = stored(_verified(fresh, sets, similarity))
        tested = found.select("a", "b") if tested is None else tested.unionAll(found.select("a", "b"))
        open_ = asked.filter("a = b").select(F.col("a").alias("sig"))
        joined = found.filter("same").join(labels.select(F.col("sig").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("sig").alias("b"), F.col("label").alias("y")), "b")
        roots = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
        labels = stored(labels.join(roots, F.col("label") == F.col("node"), "left").select("sig", F.coalesce("root", "label").alias("label")))
        if open_.first() is None:
            break
        # only those with a pair that was left out go on
        members = stored(members.drop("label").join(open_, "sig", "left_semi").join(labels, "sig").select("sig", "fp", "wide", "size", "label"))
        most *= 16
    rooted = nodes.select("sig", "least").join(labels, "sig", "left").select("sig", "least", F.coalesce("label", "sig").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    many = stored(rooted.select("sig", "root").distinct().join(ids, "root").select("sig", "component_id").filter(F.col("component_id").isNotNull()))
    return prints.join(many, "sig", "left").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = CANDIDATE_RADIUS, masks: list[np.ndarray] | None = None) -> DataFrame:
    """The documents whose doc_id is their component's; all columns stay, whatever their names. Rows that repeat such a doc_id stay with it,
    rows without a doc_id stay; null and empty texts are one group; an empty table gives an empty one."""
    found = similar_groups(docs, shingle, similarity, radius, masks)
    dropped = stored(found.filter("doc_id <> component_id").select(F.xxhash64("doc_id").alias("h"), "doc_id").distinct())
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    dropped = stored(dropped.join(kept, "doc_id", "left_anti"))  # of rows that share an id one may be kept: then they all are
    by, name = sieve(dropped.select("h")), unused(docs, "_gone")
    # most rows pass as they are; those that the sieve holds back meet the list
    key, gone = F.xxhash64("doc_id"), dropped.select(F.col("doc_id").alias(name))
    held = sifted(docs, key, by)
    return sifted(docs, key, by, inside=False).unionAll(held.join(gone, held["doc_id"] == F.col(name), "left_anti"))
