"""Substring dedup by recompression.

Rounds name runs of equal tokens and pairs of neighbours. A name is a hash of what it stands for, so every task gives equal parts equal
names without a common dictionary, and whether two neighbours are joined depends on their own names only. A name therefore recurs
wherever the words recur that it depends on (`reach`). A window of words that repeats must repeat every name whose reach lies inside it:
one exchange finds the names that more than one document has, and windows that hold an unshared name are ruled out. The other windows
are verified in a second exchange by what they are made of after the rounds: the names whose reach lies in the window, and the words around
them; 32 bits of hash over the words alone go with it. A third pass removes the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED_SCHEMA, bucket_of, dealt, mapped, packed, unpacked, width
from .text import SPACE, _powers, buffer, covered, mixed, owners, slices, span_hashes, spans, window_hashes

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
ROUNDS = 3
MIN_WORDS = 3


def names(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After `rounds` rounds: each name, the words [low, high) it stands for, and the words [from, to) it depends on."""
    n = len(words)
    doc = owners(first)
    # runs of equal words; to know a run's ends its neighbours must be seen
    new = np.ones(n, bool)
    if n:
        new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], n)
    length = (high - low).astype(U64)
    name = np.where(length > 1, mixed(words[low] + length * GOLD), words[low])
    doc, since, to = doc[low], low - 1, high + 1
    for k in range(rounds):
        if len(name) < 2:
            break
        salt = mixed(np.array([k + 1], U64))[0]
        left = (mixed(name ^ salt) & U64(1)).astype(bool)
        joins = np.zeros(len(name), bool)  # with the next
        joins[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        joined = np.zeros(len(name), bool)  # with the one before
        joined[1:] = joins[:-1]
        alone = ~joins & ~joined
        # who stays alone depends on the neighbour it could have joined: the next one for the left kind, else the one before
        other = np.clip(np.arange(len(name)) + np.where(left, 1, -1), 0, len(name) - 1)
        outside = (doc[other] != doc) | (other == np.arange(len(name)))  # no neighbour here, but perhaps elsewhere
        to = np.where(alone, np.maximum(to, np.where(outside, high + 1, to[other])), to)
        since = np.where(alone, np.minimum(since, np.where(outside, low - 1, since[other])), since)
        at = np.flatnonzero(joins)
        name[at] = mixed(name[at] * GOLD + mixed(name[at + 1] + salt))
        high[at] = high[at + 1]
        since[at], to[at] = np.minimum(since[at], since[at + 1]), np.maximum(to[at], to[at + 1])
        keep = ~joined
        name, low, high, since, to, doc = name[keep], low[keep], high[keep], since[keep], to[keep], doc[keep]
    return name, low, high, since, to


def useful(found: tuple, first: np.ndarray, size: int) -> np.ndarray:
    """Which names can rule windows out: their reach lies in one window of their document, and they stand for some words."""
    _, low, high, since, to = found
    doc = np.searchsorted(first, low, "right") - 1
    return np.flatnonzero((to - since <= size) & (high - low >= MIN_WORDS) & (since >= first[doc]) & (to <= first[doc + 1]))


def window_symbols(words: np.ndarray, size: int, found: tuple, at: np.ndarray) -> np.ndarray:
    """A hash of every `size` consecutive words as they are after the rounds: names of `found` (those at `at`) whose reach lies in the window
    stand for their words. Equal windows have equal names there, wherever they lie, since a name follows from its reach alone."""
    n = len(words)
    up, down = _powers(0, n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mixed(words) * up[:n], out=sums[1:])
    name, low, high, since, to = (x[at] for x in found)
    # in the windows that hold its reach, a name replaces the sum of its words
    swap = mixed(name ^ GOLD) * up[low] - (sums[high] - sums[low])
    edge = np.zeros(n + 2, U64)
    begin, end = np.maximum(to - size, 0), since + 1
    np.add.at(edge, begin, swap)
    np.subtract.at(edge, np.maximum(end, begin), swap)
    inside = np.cumsum(edge, dtype=U64)[: n - size + 1]
    return mixed((sums[size:] - sums[:-size] + inside) * down[: n - size + 1])


def sealed(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a key in a document."""
    return mixed(keys + mixed(doc.view(U64) * GOLD))


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """The partition of a document, as with_answers() has it."""
    return (doc ^ (doc >> 13) ^ (doc >> 27)) % n


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


class Outbox:
    """What a slice sends: questions (a key and the smallest document of the slice that has it) and answers that need no question."""

    def __init__(self, n: int):
        self.n, self.kinds, self.buckets, self.blobs = n, [], [], []

    def _send(self, kind: int, where: np.ndarray, arrays: list[np.ndarray], constant: list[np.ndarray]) -> None:
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(self.n + 1))
        arrays = [a[order] for a in arrays]
        for i in np.flatnonzero(np.diff(edges)):
            self.kinds.append(kind)
            self.buckets.append(int(i))
            self.blobs.append(packed([*(a[edges[i] : edges[i + 1]] for a in arrays), *constant]))

    def ask(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray, several: np.ndarray) -> None:
        base = doc.min() if len(doc) else np.int64(0)
        self._send(0, bucket_of(key, self.n), [key, check, _narrow((doc - base).view(U64)), several.astype(np.uint8)], [np.array([base], np.int64)])

    def answer(self, key: np.ndarray, doc: np.ndarray) -> None:
        self._send(1, home(doc, self.n), [sealed(key, doc)], [])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.kinds, pa.int8()), pa.array(self.buckets, pa.int32()), pa.array(self.blobs, pa.binary())], ["kind", "bucket", "blob"])
        self.kinds, self.buckets, self.blobs = [], [], []
        return out


SENT = "kind tinyint, bucket int, blob binary"


def post(out: Outbox, key: np.ndarray, check: np.ndarray, doc: np.ndarray, earliest: bool) -> None:
    """Sends a slice's (key, document) pairs. Each key is asked for once, however many documents of the slice have it.

    earliest: an answer means that a smaller document has the key; else that any other document has it.
    """
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    pair = head.copy()
    pair[1:] |= doc[1:] != doc[:-1]
    key, check, doc, head = key[pair], check[pair], doc[pair], head[pair]
    at = np.flatnonzero(head)
    sizes = np.diff(np.append(at, len(key)))
    known = np.repeat(sizes > 1, sizes)
    if earliest:
        known &= ~head
    out.ask(key[at], check[at], doc[at], sizes > 1)
    out.answer(key[known], doc[known])


def replies(sent: DataFrame, n: int, earliest: bool) -> DataFrame:
    """Answers the questions, key by key, and passes the answers on to their documents' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for kind, bucket, blob in zip(kinds, batch.column("bucket").to_pylist(), batch.column("blob")):
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob.as_py()], pa.binary())], ["bucket", "blob"])
                else:
                    key, check, doc, several, base = unpacked(blob.as_py())
                    parts.append((key, check, doc.astype(np.int64) + base[0], several))
        if not parts:
            return
        key, check, doc, several = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((doc, check, key))
        key, check, doc, several = key[order], check[order], doc[order], several[order].astype(bool)
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(head)
        sizes = np.diff(np.append(at, len(key)))
        least = np.repeat(doc[at], sizes)
        if earliest:
            told = doc > least
        else:
            most = np.repeat(np.maximum.reduceat(doc, at), sizes)
            told = ~several & (most > least)
            # a lone slice-document that equals another slice's is the same document twice; `several` elsewhere tells of a second one
            told |= ~several & (np.repeat(np.maximum.reduceat(several.astype(np.int8), at), sizes) > 0)
        out = Outbox(n)
        out.answer(key[told], doc[told])
        if out.blobs:
            yield out.batch().select(["bucket", "blob"])

    return dealt(sent, n).transform(mapped, run, PACKED_SCHEMA)


def _words(piece: pa.RecordBatch) -> tuple:
    data, offsets = buffer(piece.column("text"))
    starts, ends, first = spans(data, offsets, SPACE)
    ids = np.asarray(piece.column("doc_id").fill_null(0), dtype=np.int64)
    ids = np.where(np.asarray(piece.column("doc_id").is_null()), np.iinfo(np.int64).min, ids)
    return data, starts, ends, first, ids


NULL_ID = np.iinfo(np.int64).min


def with_answers(docs: DataFrame, answers: DataFrame, n: int, work: Callable, schema: str) -> DataFrame:
    """Brings documents and the answers for them to one task, and gives `work` slices of documents and a sorted array of answers."""
    i = F.coalesce(F.col("doc_id"), F.lit(0))
    bucket = F.pmod(i.bitwiseXOR(F.shiftright(i, 13)).bitwiseXOR(F.shiftright(i, 27)), F.lit(n)).cast("int")
    rows = docs.select(bucket.alias("bucket"), "doc_id", "text").transform(mapped, _pressed, "bucket int, doc_id bigint, text binary, blob binary")
    both = rows.unionByName(answers.select("bucket", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = [], []
        for batch in batches:
            answer = batch.column("blob").is_valid()
            told += [unpacked(b)[0] for b in batch.column("blob").filter(answer).to_pylist()]
            held.append(batch.select(["doc_id", "text"]).filter(pc.invert(answer)))
        known = np.unique(np.concatenate(told)) if told else np.zeros(0, U64)
        told.clear()
        while held:
            batch = held.pop()
            for low in range(0, batch.num_rows, 2000):
                for piece in slices(_unpressed(batch.slice(low, 2000)), "text", 6 << 20):
                    yield from work(piece, known)

    return dealt(both, n).transform(mapped, run, schema)


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go through the exchange compressed, which takes less than Spark's own compression of shuffled blocks."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for piece in slices(batch, "text"):
            texts = [None if t is None else press.compress(t.encode()) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("bucket"), piece.column("doc_id"), pa.array(texts, pa.binary()), pa.nulls(piece.num_rows, pa.binary())], ["bucket", "doc_id", "text", "blob"])


def _unpressed(batch: pa.RecordBatch) -> pa.RecordBatch:
    press = zstandard.ZstdDecompressor()
    texts = [None if t is None else press.decompress(t) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.large_binary())], ["doc_id", "text"])


def contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def remove_repeats(docs: DataFrame, size: int = 13, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words joined by single spaces) or kept_sha256 of it, for every document.

    A word is removed if a window of `size` consecutive words covers it that also starts in a document with a smaller doc_id.
    Null and empty texts have no words; documents shorter than a window keep all; rows that share a doc_id are one document's parts and do
    not remove each other; a null doc_id removes nothing and loses nothing. An empty table gives an empty one; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    n = width(docs.sparkSession)

    def ask_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(n)
        for batch in batches:
            for piece in slices(batch, "text"):
                data, starts, ends, first, ids = _words(piece)
                found = names(span_hashes(data, starts, ends), first, rounds)
                at = useful(found, first, size)
                doc = ids[np.searchsorted(first, found[1][at], "right") - 1]
                real = doc != NULL_ID
                post(out, found[0][at][real], np.zeros(int(real.sum()), np.uint8), doc[real], earliest=False)
                yield out.batch()

    shared = replies(docs.transform(mapped, ask_names, SENT), n, earliest=False)

    def ask_windows(piece: pa.RecordBatch, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, starts, ends, first, ids = _words(piece)
        words = span_hashes(data, starts, ends)
        if len(words) < size:
            return
        found = names(words, first, rounds)
        at = useful(found, first, size)
        name, since, to = found[0][at], found[3][at], found[4][at]
        lone = ~contains(known, sealed(name, ids[np.searchsorted(first, found[1][at], "right") - 1]))
        begin = np.maximum(to[lone] - size, 0)
        ruled_out = covered(len(words), begin, since[lone] - begin + 1)
        doc = owners(first)
        start = np.flatnonzero((doc[: len(words) - size + 1] == doc[size - 1 :]) & ~ruled_out[: len(words) - size + 1])
        start = start[ids[doc[start]] != NULL_ID]
        one = window_symbols(words, size, found, at)[start]
        two = (window_hashes(span_hashes(data, starts, ends, 1), size, 1)[start] >> U64(32)).astype(np.uint32)
        out = Outbox(n)
        post(out, one, two, ids[doc[start]], earliest=True)
        yield out.batch()

    repeats = replies(with_answers(docs, shared, n, ask_windows, SENT), n, earliest=True)

    def remove(piece: pa.RecordBatch, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, starts, ends, first, ids = _words(piece)
        words = span_hashes(data, starts, ends)
        gone = np.zeros(len(words), bool)
        if len(known) and len(words) >= size:
            doc = owners(first)
            start = np.flatnonzero(doc[: len(words) - size + 1] == doc[size - 1 :])
            found = names(words, first, rounds)
            start = start[contains(known, sealed(window_symbols(words, size, found, useful(found, first, size))[start], ids[doc[start]]))]
            gone = covered(len(words), start, size)
        kept = _joined(data, starts, ends, first, ~gone)
        removed = np.concatenate([[0], np.cumsum(gone)])
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept] if not keep_text else [x.decode() for x in kept], pa.string())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]), last], names=["doc_id", "n_words", "n_removed", "text" if keep_text else "kept_sha256"])

    return with_answers(docs, repeats, n, remove, REMOVED if keep_text else REMOVED.replace("text string", "kept_sha256 string"))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    out = np.full(at[-1], 32, np.uint8)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    out[place] = data[np.cumsum(edge[:-1]) > 0]
    raw, cut = out.tobytes(), at[kept_first]
    return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
