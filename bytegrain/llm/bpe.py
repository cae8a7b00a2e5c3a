"""Byte-level BPE over length-bucketed padded matrices, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .exchange import mapped
from .text import mixed, slices

U64 = np.uint64
NONE = np.int32(1 << 30)


class PairTable:
    """Merged id (which is the rank) of a pair of ids, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, ~U64(0), U64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, place = np.array(keys, U64), None
        vals = np.array(values, np.int32)
        place = self._slot(left)
        while len(left):  # of those that want a slot the first gets it, the rest go one further
            free = self.keys[place] == ~U64(0)
            at = np.flatnonzero(free)
            took = at[np.unique(place[at], return_index=True)[1]]
            self.keys[place[took]], self.values[place[took]] = left[took], vals[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, vals, place = left[rest], vals[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none; negative ids have no pairs."""
        keys = a.astype(U64) << U64(32) | (b.astype(U64) & U64(0xFFFFFFFF))
        place = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        while len(left):
            there = self.keys[place[left]]
            same = there == keys[left]
            out[left[same]] = self.values[place[left[same]]]
            left = left[~same & (there != ~U64(0))]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        return out


class BytePairEncoder:
    """Encodes and decodes as the ranks file says. long_piece: pieces of more bytes are merged by a heap, one at a time."""

    def __init__(self, path: str, pattern: str, long_piece: int = 64, cache: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern, self.pairs, self.long_piece, self.cache_size = regex.compile(pattern), PairTable(self.ranks), long_piece, cache
        self.bytes_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes_id < 0).any():
            raise ValueError("the ranks lack single bytes")
        self.cache: dict[str, tuple[int, ...]] = {}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def pieces(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is not None:
                out[i] = (known,)
            elif len(w) > self.long_piece:
                out[i] = self._merged(w)
            else:
                buckets.setdefault(4 * (-(-len(w) // 4)), []).append(i)
        for size, rows in buckets.items():
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                for i, ids in zip(part, self._matrix([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        n = len(words)
        lens = np.array([len(w) for w in words])
        ids = np.full((n, size + 1), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = self.bytes_id[flat]
        ranks = np.full((n, size + 1), NONE, np.int32)
        ranks[:, :size] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size)
        done = np.empty((n, size + 1), np.int32)
        row, columns = np.arange(n), np.arange(size + 1)
        while len(row):
            at = ranks.argmin(1)  # the leftmost of the lowest
            k = np.arange(len(row))
            best = ranks[k, at]
            go = best < NONE
            if not go.all():
                done[row[~go]] = ids[~go]
                row, ids, ranks, at, best = row[go], ids[go], ranks[go], at[go], best[go]
                k = np.arange(len(row))
                if not len(row):
                    break
            shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), size)
            ids[k, at] = best
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, size] = -1
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[:, size] = NONE
            ranks[k, at] = self.pairs.get(best, ids[k, np.minimum(at + 1, size)])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pairs.get(ids[some, at[some] - 1], best[some])
        full = done >= 0
        ends = np.cumsum(full.sum(1))
        whole = done[full].tolist()
        return [tuple(whole[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        """One long piece: a linked list of parts and a heap of (rank, place)."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return tuple(self.ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more for the end)."""
        split = [self.pattern.findall(t) for t in texts]
        cache = self.cache
        missing = list(set(chain.from_iterable(split)) - cache.keys())
        if missing:
            if len(cache) + len(missing) > self.cache_size:
                cache.clear()
                missing = list(set(chain.from_iterable(split)))
            cache.update(zip(missing, self.pieces([w.encode() for w in missing])))
        rows = [list(chain.from_iterable(map(cache.__getitem__, s))) for s in split]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        return np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1]), offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.flat[np.arange(total) + np.repeat(self.begins[ids] - (ends - lengths), lengths)].tobytes()
        cut = np.concatenate([[0], ends])[offsets]
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """This worker's encoder, built once. The vocabulary file lies at the same path on every machine."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BytePairEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. Null and empty texts have no ids; repeated rows give equal rows; an empty table an empty one.

    Each match of `pattern` is encoded on its own, without special tokens. Other columns than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                ids, offsets = coder.encode([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns doc_id and ids, and decoded (binary); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                piece = batch.slice(low, 500)
                column = piece.column("ids")
                lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
                flat = np.asarray(column.flatten(), dtype=np.int32)
                raw = coder.decode(flat, np.concatenate([[0], np.cumsum(lengths)]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), column, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").transform(mapped, run, "doc_id bigint, ids array<int>, decoded binary")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip (the ids decode to the text's bytes), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                ids, offsets = coder.encode(texts)
                same = [a == b.encode() for a, b in zip(coder.decode(ids, offsets), texts)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), piece.column("source"), pa.array(np.diff(offsets)), lists, pa.array(same, pa.bool_())], ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "lang", "source", "text").transform(mapped, run, "doc_id bigint, lang string, source string, n_tokens bigint, ids array<int>, round_trip boolean")
