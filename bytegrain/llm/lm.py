"""A hierarchical Pitman-Yor language model: words after words, words alone, and spellings.

The lowest restaurants are contexts, the word before (hashed to CONTEXTS restaurants, whose totals are what the driver holds of them); they share
one parent, the restaurant of words; its parent spells a word byte by byte up to a space, by restaurants of none to three bytes of the word
so far, whose root's parent is uniform over bytes. Everywhere the customers of a parent are the tables of its children. A sweep of the
Gibbs sampler reseats all customers: those of one word in one restaurant are seated one after another given all other restaurants' totals.
Predictive probabilities are averaged over the sweeps after the first ones.

Words meet by hash: each slice of documents sends every word once with the contexts and documents that it has there, and the task that owns
the word keeps them in a cell, a row of a written table, over which sweeps and scoring run. Words that hold more than one in 4096 of all
tokens are spread over the tasks by their context; what is known of them as words passes the driver, as totals do. Seatings are not stored:
each pass draws them again from the same seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bucket_of, dealt, mapped, packed, runs, stored, unpacked, width
from .text import LOWER, SPACE, buffer, mixed, slices, span_hashes, spans

U64 = np.uint64
DEPTH = 3
END = 10
#: 32 classes of bytes in a context: a to z, space, end, digits, other ASCII, and two kinds of bytes beyond ASCII.
CLASS = np.full(256, 29, np.uint32)
CLASS[97:123] = np.arange(26)
CLASS[32], CLASS[END] = 26, 27
CLASS[48:58] = 28
CLASS[128:] = 30 + (np.arange(128) & 1)
#: Discount and strength of the restaurants at each depth.
DISCOUNTS = (0.3, 0.5, 0.6, 0.7)
STRENGTHS = (1.0, 1.0, 1.0, 1.0)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of each place of each word and of the space after it, and where each word's begin. An empty span is the end token."""
    n, sizes = len(starts), ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.full(begin[-1], 32, np.uint8)
    place = np.ones(begin[-1], bool)
    place[begin[1:] - 1] = False
    text[place] = data[np.arange(begin[-1] - n) + np.repeat(starts - (begin[:-1] - np.arange(n)), sizes - 1)]
    text[begin[1:][sizes == 1] - 1] = END
    padded = np.full(len(text) + DEPTH * n, END, np.uint8)
    at = np.arange(len(text)) + np.repeat(DEPTH * np.arange(1, n + 1), sizes)
    padded[at] = text
    c = CLASS[padded]
    # the class of the nearest byte comes highest, so that a parent's number is a child's without its low bits
    context = (c[at - 1] << np.uint32(10)) | (c[at - 2] << np.uint32(5)) | c[at - 3]
    return (context << np.uint32(8)) | text, begin


@dataclass
class Seating:
    """Customers and tables of every kind of customer at one depth: kinds are (context, byte), sorted."""

    kinds: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    restaurant: np.ndarray  # index of each kind's restaurant
    parent: np.ndarray  # index of its kind one depth up


def seat(customers: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after all its customers sat down one by one: where i sit at t tables, the next opens one with probability
    a / (a + i - discount * t); a is what the restaurant's other totals give a new table. Beyond 32 customers they come in blocks, each as
    many as sit already, within which the probability is that of the block's middle."""
    tables = np.minimum(customers, 1).astype(np.float64)
    live, i = np.flatnonzero(customers > 1), 1
    while len(live) and i < 32:
        w = a[live]
        tables[live] += rng.random(len(live)) * (w + i - discount * tables[live]) < w
        i += 1
        live = live[customers[live] > i]
    while len(live):
        more, w = np.minimum(customers[live] - i, i), a[live]
        p = w / (w + i + more / 2 - discount * tables[live])
        tables[live] += rng.binomial(more, p)
        i *= 2
        live = live[customers[live] > i]
    return tables


class PitmanYor:
    """Spellings: seating of customers (context, byte) in restaurants of bytes. Predictive probabilities are averaged over samples."""

    def __init__(self, kinds: np.ndarray, customers: np.ndarray, seed: int = 17, burn_in: int = 4, samples: int = 4):
        self.rng = np.random.default_rng(seed)
        self.levels: list[Seating] = []
        part = [kinds.astype(np.int64)]
        for depth in range(DEPTH, 0, -1):
            context, byte = part[-1] >> 8, part[-1] & 255
            part.append(np.unique((context >> 5) << 8 | byte))
        counts = customers.astype(np.int64)
        for k, own in enumerate(part):
            depth = DEPTH - k
            restaurant = np.unique(own >> 8, return_inverse=True)[1] if len(own) else np.zeros(0, np.int64)
            up = (own >> 13) << 8 | (own & 255)
            parent = np.searchsorted(part[k + 1], up) if depth else np.zeros(len(own), np.int64)
            tables = np.minimum(counts, 1)
            self.levels.append(Seating(own, counts, tables, restaurant, parent))
            counts = np.bincount(parent, tables, len(part[k + 1])).astype(np.int64) if depth else counts
        total = np.zeros(1 << 23, np.float32)
        for sweep in range(burn_in + samples):
            self._sweep()
            if sweep >= burn_in:
                self.predictive(total)
        self.log10 = np.empty(1 << 23, np.float16)
        for low in range(0, 1 << 23, 1 << 19):
            self.log10[low : low + (1 << 19)] = np.log10(total[low : low + (1 << 19)] / samples)

    def _known(self) -> list[np.ndarray]:
        """Predictive probability of each kind at its depth, from leaf to root."""
        out: list[np.ndarray] = []
        up = np.zeros(0)
        for k in range(DEPTH, -1, -1):
            s, depth = self.levels[k], DEPTH - k
            d, theta = DISCOUNTS[depth], STRENGTHS[depth]
            n = np.bincount(s.restaurant, s.customers)
            t = np.bincount(s.restaurant, s.tables)
            above = up[s.parent] if depth else np.full(len(s.kinds), 1 / 256)
            up = (s.customers - d * s.tables + (theta + d * t[s.restaurant]) * above) / (theta + n[s.restaurant]) if len(s.kinds) else np.zeros(0)
            out.append(up)
        return out[::-1]

    def _sweep(self) -> None:
        """Reseats all customers, depth by depth from the leaves."""
        known = self._known()
        for k in range(DEPTH + 1):
            s, depth = self.levels[k], DEPTH - k
            if not len(s.kinds):
                return
            d, theta = DISCOUNTS[depth], STRENGTHS[depth]
            above = known[k + 1][s.parent] if depth else np.full(len(s.kinds), 1 / 256)
            others = np.bincount(s.restaurant, s.tables)[s.restaurant] - s.tables
            s.tables = seat(s.customers, (theta + d * others) * above, d, self.rng)
            if depth:
                up = self.levels[k + 1]
                up.customers = np.bincount(s.parent, s.tables, len(up.kinds)).astype(np.int64)
                up.tables = np.minimum(up.tables, up.customers)

    def predictive(self, total: np.ndarray) -> None:
        """Adds the probability of every byte in every leaf context, some contexts at a time."""
        up = np.full((1, 256), 1 / 256)
        for k in range(DEPTH, -1, -1):
            s, depth = self.levels[k], DEPTH - k
            d, theta = DISCOUNTS[depth], STRENGTHS[depth]
            contexts = 32**depth
            n = np.bincount(s.kinds >> 8, s.customers, contexts)
            t = np.bincount(s.kinds >> 8, s.tables, contexts)
            step, out = min(contexts, 2048), None if depth == DEPTH else np.empty((contexts, 256))
            for low in range(0, contexts, step):
                a, b = np.searchsorted(s.kinds, [low << 8, (low + step) << 8])
                table = np.zeros(step * 256)
                table[s.kinds[a:b] - (low << 8)] = s.customers[a:b] - d * s.tables[a:b]
                rows = slice(low, low + step)
                base = up[np.arange(low, low + step) // 32] if depth else up
                p = (table.reshape(step, 256) + (theta + d * t[rows])[:, None] * base) / (theta + n[rows])[:, None]
                if out is None:
                    total[low << 8 : (low + step) << 8] += p.ravel()
                else:
                    out[rows] = p
            up = out


def _tokens(piece: pa.RecordBatch) -> tuple:
    data, offsets = buffer(piece.column("text"))
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SPACE)
    return data, starts, ends, first


def _unique(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by word, and the sorted places where words begin."""
    order = np.argsort(key)
    word = np.ones(len(key), bool)
    word[1:] = key[order[1:]] != key[order[:-1]]
    if (~word[1:] & (check[order[1:]] != check[order[:-1]])).any():  # two words of one key
        order = np.lexsort((check, key))
        word[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order, np.flatnonzero(word)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each word."""
    return span_hashes(data, starts, ends, 0), (span_hashes(data, starts, ends, 1) >> U64(32)).astype(np.uint32)


#: Restaurants that contexts are hashed to. The last is that of a document's first word.
CONTEXTS = 1 << 16
#: A word is spread over tasks if it holds more than one in so many tokens; there are no more of them than that.
HOT_SHARE = 4096
#: Entries of a cell at most, unless one word has more.
CELL_ENTRIES = 1 << 18


def hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the words that hold more than one in HOT_SHARE of the tokens, sorted. Slices leave out what is under half of that there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                data, starts, ends, _ = _tokens(piece)
                keys, total = span_hashes(data, starts, ends), len(starts) + piece.num_rows
                place = (keys >> U64(44)).astype(np.int64)
                few = np.bincount(place, minlength=1 << 20) * 2 * HOT_SHARE <= total
                keys, counts = np.unique(keys[~few[place]], return_counts=True)  # of those alone whose place holds that many
                many = counts * 2 * HOT_SHARE > total
                keys = np.append(keys[many], _hashed(data, np.zeros(1, np.int64), np.zeros(1, np.int64))[0])  # the end token
                yield pa.RecordBatch.from_arrays([pa.array([*keys.view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[many].tolist(), piece.num_rows, total], pa.int64())], ["key", "n"])

    counts = docs.select("text").transform(mapped, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    total = counts.filter("key is null").first()
    if total is None:
        return np.zeros(0, U64)
    return np.sort(np.array([r[0] for r in counts.filter(f"key is not null and n * {HOT_SHARE} > {total['n']}").collect()], np.int64).view(U64))


def _rank(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among sorted ones, -1 where it is not among them."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


_ASKED = "bucket int, kind tinyint, blob binary"


def _pressed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(packed(arrays))


def _unpressed(blob: bytes) -> list[np.ndarray]:
    return unpacked(zstandard.ZstdDecompressor().decompress(blob))


def _flat(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    return data[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def asked(rows: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """Of each slice, to the owners of words: kind 0, words and their entries (context, document, times); kind 1, to the documents' homes: what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                data, starts, ends, first = _tokens(piece)
                number = np.asarray(piece.column("row"), dtype=np.int64)
                learned = ~np.asarray(piece.column("held"), dtype=bool)
                m = len(number)
                # each document's end token comes after its words
                at = np.repeat(np.arange(m), np.diff(first)) + np.arange(len(starts))
                places, doc = np.zeros(len(starts) + m, np.int64), np.repeat(np.arange(m), np.diff(first) + 1)
                begin, stop = places.copy(), places.copy()
                begin[at], stop[at] = starts, ends
                key, check = _hashed(data, begin, stop)
                context = np.full(len(key), CONTEXTS - 1, np.int64)
                context[1:] = (mixed(key[:-1]) >> U64(32)).astype(np.int64) % (CONTEXTS - 1)
                context[first[:-1] + np.arange(m)] = CONTEXTS - 1
                order, head = _unique(key, check)
                word = np.empty(len(key), np.int64)
                word[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
                entry, times = np.unique((word << 40) | (context << 24) | doc, return_counts=True)
                word, context, doc = entry >> 40, (entry >> 24) & (CONTEXTS - 1), entry & ((1 << 24) - 1)
                some = order[head]
                key, begin, sizes = key[some], begin[some], (stop - begin)[some]
                spread = _rank(hot, key)[word] >= 0
                where = bucket_of(np.where(spread, mixed(key[word] + mixed(context.astype(U64))), key[word]), n)
                where = where.astype(np.uint16 if n <= 1 << 16 else np.uint32)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(n + 1))
                kinds, buckets, blobs, flags = [], [], [], np.packbits(learned)
                for i in np.flatnonzero(np.diff(edges)).tolist():
                    e = order[edges[i] : edges[i + 1]]
                    w = word[e]  # in order
                    cut = runs(w)
                    w, many = w[cut], np.diff(np.append(cut, len(w)))
                    kinds.append(0)
                    buckets.append(i)
                    blobs.append(_pressed([key[w], _narrow(sizes[w]), _flat(data, begin[w], sizes[w]), _narrow(many), context[e].astype(np.uint16), _narrow(doc[e]), _narrow(times[e]), flags, number[:1]]))
                ids = np.asarray(piece.column("doc_id").fill_null(0), dtype=np.int64)
                null = np.asarray(piece.column("doc_id").is_null())
                home = number % n
                for i in np.unique(home).tolist():
                    d = np.flatnonzero(home == i)
                    kinds.append(1)
                    buckets.append(i)
                    blobs.append(packed([number[d], ids[d], null[d].astype(np.uint8), learned[d].astype(np.uint8), np.diff(first)[d] + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    return rows.transform(mapped, run, _ASKED)


def cells(sent: DataFrame, n: int) -> DataFrame:
    """The owners' tables: kind 0, cells of words with all that slices sent of them; kind 1 as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
                if kind:
                    yield _row(bucket, 1, blob.as_py())
                else:
                    parts.append(_unpressed(blob.as_py()))
                    own = bucket
        if not parts:
            return
        parts.sort(key=lambda x: int(x[8][0]))  # whatever the order of arrival
        key, sizes = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.int64)
        data, ends = np.concatenate([x[2] for x in parts]), np.cumsum(sizes)
        starts = ends - sizes
        order, head = _unique(key, span_hashes(data, starts, ends, 1))
        number = np.empty(len(key), np.int64)
        number[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
        word = np.repeat(number.astype(np.uint32), np.concatenate([x[3] for x in parts]).astype(np.int64))
        # word, context, and the place of arrival, in one number that sorts them
        place = (word.astype(U64) << U64(16)) | np.concatenate([x[4] for x in parts]).astype(U64)
        order_of = np.argsort(place, kind="stable")
        word, context = (place[order_of] >> U64(16)).astype(np.uint32), (place[order_of] & U64(0xFFFF)).astype(np.uint16)
        del place
        piece = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x[5]) for x in parts])[order_of]
        learned = np.concatenate([np.unpackbits(x[7])[x[5]] for x in parts])[order_of]
        doc, times = (_narrow(np.concatenate([x[i].astype(np.uint32) for x in parts]))[order_of] for i in (5, 6))
        bases = np.array([x[8][0] for x in parts])
        parts.clear()
        del order_of
        some = order[head]
        key, sizes, starts = key[some], sizes[some], starts[some]
        ends = np.searchsorted(word, np.arange(len(some)), "right")
        low = 0
        while low < len(some):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + CELL_ENTRIES, "right")))
            e = slice(base, ends[high - 1])
            w, c = word[e].astype(np.int64) - low, context[e]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            customers = np.add.reduceat(times[e].astype(np.int64) * learned[e], at)
            own_sizes = sizes[low:high]
            yield _row(own, 0, _pressed([
                np.array([own, low]), key[low:high], _narrow(own_sizes), _flat(data, starts[low:high], own_sizes), _narrow(np.bincount(w[at], minlength=high - low)), c[at], _narrow(customers), _narrow(np.diff(np.append(at, len(w)))),
                _narrow(piece[e]), _narrow(doc[e]), _narrow(times[e]), bases,
            ]))
            low = high

    return dealt(sent, n).transform(mapped, run, _ASKED)


@dataclass
class Totals:
    """What a sweep needs of all others: tables in each context, customers and tables of the restaurant of words, both of each hot word."""

    context_tables: np.ndarray
    customers: float
    tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Model:
    """Counts, discounts, spellings (log10 of bytes in contexts; the second ones are fitted on the tables of words) and the totals of all sweeps."""

    hot: np.ndarray
    hot_counts: np.ndarray
    tokens: int
    vocabulary: int
    context_customers: np.ndarray
    discount: float
    word_discount: float
    strength: float
    burn_in: int
    spellings: list[np.ndarray]
    sweeps: list[Totals] = field(default_factory=list)


class Cell:
    """Words of one owner: w and k are the word and context of each pair that occurs, c its training customers."""

    def __init__(self, blob: bytes, model: Model | None = None, hot: np.ndarray | None = None):
        self.name, self.key, sizes, self.data, pairs, self.k, c, self.entries, self.piece, self.doc, self.times, self.bases = _unpressed(blob)
        sizes = sizes.astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.c = c.astype(np.int64)
        self.w = np.repeat(np.arange(len(self.key)), pairs)
        self.model = model
        self.hot = _rank(model.hot if model else hot, self.key)
        self.cold = self.hot < 0
        self.count = np.bincount(self.w, self.c, len(self.key)).astype(np.int64)  # of a hot word only those that are here

    def spelled(self, log10: np.ndarray) -> np.ndarray:
        """Probability of each word under the spellings."""
        code, begin = codes(self.data, self.starts, self.ends)
        return 10.0 ** np.add.reduceat(log10[code], begin[:-1], dtype=np.float64)

    def code_counts(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each (context, byte) is spelled, words weighing as given: the numbers of those that are, and how often."""
        code, begin = codes(self.data, self.starts, self.ends)
        total = np.bincount(code, np.repeat(weight, np.diff(begin)))
        some = np.flatnonzero(total)
        return some, total[some].astype(np.float32)

    def words(self, customers: np.ndarray, tables: np.ndarray, t: Totals, spelled: np.ndarray) -> np.ndarray:
        """Probability of each word alone."""
        m, hot = self.model, self.hot[~self.cold]
        customers, tables = customers.astype(np.float64), tables.astype(np.float64)
        customers[~self.cold], tables[~self.cold] = t.hot_customers[hot], t.hot_tables[hot]
        rest = m.strength + m.word_discount * t.tables
        return (np.maximum(customers - m.word_discount * tables, 0) + rest * spelled) / (m.strength + t.customers)

    def replay(self, known: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each sweep whose totals before it are known (of `known` ones, if given): the tables of each pair; customers, tables and probability before it of words."""
        m = self.model
        spelled = [self.spelled(x) for x in m.spellings]
        seen = np.bincount(self.w, self.c > 0, len(self.key))
        pair, customers, tables = np.minimum(self.c, 1), seen, np.minimum(seen, 1)
        for s, t in enumerate(m.sweeps[:known]):
            own = spelled[min(s >= m.burn_in, len(spelled) - 1)]
            p = self.words(customers, tables, t, own)
            rng = np.random.default_rng([int(self.name[0]), int(self.name[1]), s])
            a = (m.strength + m.discount * np.maximum(t.context_tables[self.k] - pair, 0)) * p[self.w]  # of all but the pair's own customers
            pair = seat(self.c, a, m.discount, rng)
            customers = np.bincount(self.w, pair, len(self.key))
            tables = seat(customers.astype(np.int64), (m.strength + m.word_discount * np.maximum(t.tables - tables, 0)) * own, m.word_discount, rng)
            yield pair, customers, tables, own


def _summed(table: DataFrame, work, n: int) -> list:
    """Sums of the arrays that `work` makes of a cell, over all cells: each is cut into n parts that are summed apart. A pair of places
    and values stands for an array of 2^23, also in the result."""

    def cut(i: int, part: list[np.ndarray]) -> pa.RecordBatch:
        some = [np.flatnonzero(x) for x in part]
        return _row(i, 0, packed([y for x, at in zip(part, some) for y in (at.astype(np.uint32), x[at], np.array([len(x)]))]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob"):
                found = work(blob.as_py())
                if total is None:
                    total = [np.zeros(1 << 23, np.float32) if isinstance(x, tuple) else np.zeros(len(x)) for x in found]
                for x, y in zip(total, found):
                    if isinstance(y, tuple):
                        x[y[0]] += y[1]
                    else:
                        x += y
        if total is not None:
            for i in range(n):
                yield cut(i, [x[len(x) * i // n : len(x) * (i + 1) // n] for x in total])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = None, 0
        for batch in batches:
            for i, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                x, bucket = unpacked(blob.as_py()), i
                total = [np.zeros(int(size[0]), v.dtype) for v, size in zip(x[1::3], x[2::3])] if total is None else total
                for k, (at, v) in enumerate(zip(x[::3], x[1::3])):
                    total[k][at] += v
        if total is not None:
            yield cut(bucket, total)

    found = dealt(table.filter("kind = 0").transform(mapped, count, _ASKED), n).transform(mapped, merge, _ASKED)
    got = [unpacked(r["blob"]) for r in found.select("bucket", "blob").sort("bucket").collect()]
    out: list = []
    for k in range(0, len(got[0]) if got else 0, 3):
        sizes = [int(x[k + 2][0]) for x in got]
        places = np.concatenate([x[k].astype(np.int64) + base for x, base in zip(got, np.cumsum([0, *sizes]))])
        values = np.concatenate([x[k + 1] for x in got])
        if sum(sizes) == 1 << 23:
            out.append((places, values))
        else:
            out.append(np.zeros(sum(sizes), np.float64))
            out[-1][places] = values
    return out


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.1, 0.95))


def fit(table: DataFrame, hot: np.ndarray, burn_in: int = 2, samples: int = 2, strength: float = 1.0, seed: int = 17) -> Model:
    """Runs the sampler over the cells. The driver holds totals by context, by hot word and by (context, byte) of spellings, however large the corpus."""
    spark, n = table.sparkSession, min(256, width(table.sparkSession))

    def first(blob: bytes) -> list[np.ndarray]:
        x = Cell(blob, hot=hot)
        seen, here = np.bincount(x.w, x.c > 0, len(x.key)), x.count > 0
        by_hot = [np.bincount(x.hot[~x.cold], v[~x.cold], len(hot)) for v in (x.count, seen)]
        own = seen[x.cold]
        sums = np.array([x.count.sum(), (x.cold & here).sum(), (x.c == 1).sum(), (x.c == 2).sum(), (own == 1).sum(), (own == 2).sum(), own.sum()], np.float64)
        # a hot word is spelled once: by the task that has its first letters anyway, the driver adds nothing
        return [np.bincount(x.k, x.c, CONTEXTS), np.bincount(x.k, x.c > 0, CONTEXTS).astype(np.float64), *by_hot, sums, x.code_counts((x.cold & here).astype(np.float64))]

    got = _summed(table, first, n)
    if not got:
        return Model(hot, np.zeros(len(hot)), 0, 0, np.zeros(CONTEXTS), 0.5, 0.5, strength, burn_in, [np.full(1 << 23, np.log10(1 / 256), np.float16)])
    context_customers, types, hot_counts, hot_types, sums, (kinds, spelt) = got
    spelling = PitmanYor(kinds, spelt.astype(np.int64), seed=seed).log10
    known_hot = int((hot_counts > 0).sum())
    model = Model(hot, hot_counts, int(sums[0]), int(sums[1]) + known_hot, context_customers, _discount(sums[2], sums[3]), _discount(sums[4], sums[5]), strength, burn_in, [spelling])
    model.sweeps.append(Totals(types, sums[6] + hot_types.sum(), sums[1] + known_hot, hot_types, np.minimum(hot_types, 1)))
    rng = np.random.default_rng(seed)
    for sweep in range(burn_in + samples):
        sent = spark.sparkContext.broadcast(model)
        spell = sweep + 1 == burn_in

        def work(blob: bytes, sent=sent, spell=spell) -> list[np.ndarray]:
            x = Cell(blob, sent.value)
            *_, (pair, customers, tables, _) = x.replay()
            sums = np.array([customers[x.cold].sum(), tables[x.cold].sum()])
            out = [np.bincount(x.k, pair, CONTEXTS), np.bincount(x.hot[~x.cold], customers[~x.cold], len(sent.value.hot)), sums]
            return [*out, x.code_counts(np.where(x.cold, tables, 0))] if spell else out

        context_tables, hot_customers, sums, *kinds = _summed(table, work, n)
        last = model.sweeps[-1]
        # hot words are long known: of their many customers' tables a word's spelling has little share, about that of a word alone
        hot_tables = seat(hot_customers.astype(np.int64), np.full(len(hot), (strength + model.word_discount * last.tables) * 1e-4), model.word_discount, rng)
        model.sweeps.append(Totals(context_tables, sums[0] + hot_customers.sum(), sums[1] + hot_tables.sum(), hot_customers, hot_tables))
        if spell:
            model.spellings.append(PitmanYor(kinds[0][0], kinds[0][1].astype(np.int64), seed=seed + 1).log10)
        sent.destroy()
    return model


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def predictive(x: Cell) -> np.ndarray:
    """Probability of each pair's word in its context, averaged over the samples."""
    m, out = x.model, np.zeros(len(x.c))
    for s, (pair, customers, tables, own) in enumerate(x.replay(len(m.sweeps) - 1)):
        if s >= m.burn_in:
            t = m.sweeps[s + 1]
            rest = m.strength + m.discount * t.context_tables[x.k]
            out += (np.maximum(x.c - m.discount * pair, 0) + rest * x.words(customers, tables, t, own)[x.w]) / (m.strength + m.context_customers[x.k])
    return out / max(1, len(m.sweeps) - 1 - m.burn_in)


def _by_document(found: list[tuple]) -> tuple:
    """Sums of the same document's parts."""
    number, *sums = (np.concatenate(x) for x in zip(*found))
    number, same = np.unique(number, return_inverse=True)
    return number, *(np.bincount(same, x, len(number)) for x in sums)


def _answers(found: tuple, n: int) -> Iterator[pa.RecordBatch]:
    """Parts of documents to their homes."""
    number, base_log, score_log, known = found
    home = number % n
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        d = order[edges[i] : edges[i + 1]]
        base = number[d].min()
        yield _row(i, 2, packed([_narrow(number[d] - base), base_log[d], score_log[d].astype(np.float32), _narrow(known[d].astype(np.int64)), np.array([base])]))


def score(docs: DataFrame, held=None, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, vocabulary, base_score (add-one unigrams) and score (log10 probability) of every document.

    Learns from all rows that are not held out. Null and empty texts are one end token. Repeated rows count and score each; an empty table
    gives an empty one; other columns than doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    held = held_out() if held is None else held
    docs = docs.select("doc_id", "text", held.alias("held"))
    n = width(spark)
    hot = hot_words(docs)
    table = stored(cells(asked(docs.withColumn("row", F.monotonically_increasing_id()), n, hot), n))
    model = fit(table, hot, **settings)
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's share of the logarithms. Kind 1 passes through, kind 2: number, logarithms and known tokens of documents."""
        m, found, held = sent.value, [], 0
        for batch in batches:
            for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
                if kind:
                    yield _row(bucket, 1, blob.as_py())
                    continue
                x = Cell(blob.as_py(), m)
                total = x.count.astype(np.float64)
                total[~x.cold] = m.hot_counts[x.hot[~x.cold]]
                pair = np.repeat(np.arange(len(x.c)), x.entries)
                times, word = x.times.astype(np.float64), x.w[pair]
                number, doc = np.unique(x.bases[x.piece] + x.doc, return_inverse=True)
                logs = np.log10(np.maximum(predictive(x), 1e-300))
                found.append((number, *(np.bincount(doc, times * y, len(number)) for y in (np.log10(total + 1)[word], logs[pair], (total > 0)[word]))))
                held += len(number)
                if held > 1 << 21:
                    found = [_by_document(found)]
                    if len(found[0][0]) > 1 << 20:
                        yield from _answers(found[0], n)
                        found = []
                    held = len(found[0][0]) if found else 0
        if found:
            yield from _answers(_by_document(found), n)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, parts = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                x = unpacked(blob.as_py())
                held_.append(x) if kind == 1 else parts.append((x[0].astype(np.int64) + x[4][0], *x[1:4]))
        if not held_:
            return
        number, ids, null, learned, n_tokens = (np.concatenate(x) for x in zip(*held_))
        order = np.argsort(number)
        number = number[order]
        sums = [np.zeros(len(number)) for _ in range(3)]
        for which, *some in parts:
            at = np.searchsorted(number, which)
            for total, x in zip(sums, some):
                np.add.at(total, at, x)
        columns = [pa.array(ids[order], mask=null[order].astype(bool)), pa.array(learned[order] == 0), pa.array(n_tokens[order]), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    found = dealt(table.transform(mapped, count, _ASKED), n).transform(mapped, finish, SCORED)
    base = F.log10(F.lit(float(model.tokens + model.vocabulary + 1)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.lit(model.vocabulary).cast("bigint").alias("vocabulary"), (F.col("base") - F.col("n_tokens") * base).alias("base_score"), "score")


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def _row(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int8()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])
