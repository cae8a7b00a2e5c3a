"""Line dedup: sharded cuckoo filters over an exact table of reference counts, reversible by document."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import mapped, stored, unused
from .text import LOWER, SPACE, buffer, lines, mixed, owners, slices, span_hashes

U64 = np.uint64
COUNTS = "k1 bigint, k2 bigint, n bigint"


class CuckooFilter:
    """Fingerprints of 32 bits, four to a bucket; keys are 64-bit hashes. Supports deletion of keys that were inserted."""

    SLOTS = 4

    def __init__(self, capacity: int):
        self.size = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.8))))
        self.table = np.zeros((self.size, self.SLOTS), np.uint32)

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        return np.maximum((keys >> U64(32)).astype(np.uint32), np.uint32(1))

    def _places(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = keys & U64(self.size - 1)
        return one, one ^ (mixed(marks.astype(U64)) & U64(self.size - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks = self._marks(keys)
        one, two = self._places(keys, marks)
        return (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Every key takes a slot, keys of equal marks one each. Many at once: of those that want a free slot the first gets it, the others
        go on to their next one; only those that find none free push others out, one by one."""
        marks = self._marks(keys)
        one, two = (x.astype(np.int64) for x in self._places(keys, marks))
        left = np.arange(len(keys))
        for place in (one, two):
            for k in range(self.SLOTS):
                free = left[self.table[place[left], k] == 0]
                took = free[np.unique(place[free], return_index=True)[1]]
                self.table[place[took], k] = marks[took]
                left = np.setdiff1d(left, took, assume_unique=True)
        for i in left.tolist():
            if not (self._put(int(marks[i]), one[i]) or self._put(int(marks[i]), two[i])):
                self._push(int(marks[i]), int(two[i]))

    def _put(self, mark: int, place: int) -> bool:
        row = self.table[place]
        for k in range(self.SLOTS):
            if not row[k]:
                row[k] = mark
                return True
        return False

    def _push(self, mark: int, place: int) -> None:
        mask = self.size - 1
        for step in range(2000):
            k = (step * 7 + mark) % self.SLOTS
            mark, self.table[place, k] = int(self.table[place, k]), mark
            place ^= int(mixed(np.array([mark], U64))[0]) & mask
            if self._put(mark, place):
                return
        raise OverflowError("the filter is too full; build it again with more capacity")

    def delete(self, keys: np.ndarray) -> None:
        marks = self._marks(keys)
        for mark, *places in zip(marks.tolist(), *(x.tolist() for x in self._places(keys, marks))):
            for place in places:
                hit = np.flatnonzero(self.table[place] == mark)
                if len(hit):
                    self.table[place, hit[0]] = 0
                    break


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(keys) >> U64(33)) % U64(shards)).astype(np.int64)


class ShardedFilter:
    """One cuckoo filter for each shard of the keys, and the keys of the corpus that it takes wrongly. Keys can be added and deleted; only
    their shards change."""

    def __init__(self, shards: int, parts: list[CuckooFilter] | None = None, held: list[int] | None = None, wrong: np.ndarray | None = None):
        self.shards, self.parts, self.held = shards, parts or [CuckooFilter(1) for _ in range(shards)], held or [0] * shards
        self.wrong = np.zeros(0, U64) if wrong is None else np.sort(wrong)

    @classmethod
    def of(cls, keys: np.ndarray, shards: int) -> ShardedFilter:
        """shards: of about equal numbers of keys."""
        out, where = cls(shards), shard_of(keys, shards)
        for k in range(shards):
            own = keys[where == k]
            out.held[k], out.parts[k] = len(own), _filled(own)
        return out

    def insert(self, keys: np.ndarray, all_of: Callable[[int], np.ndarray]) -> np.ndarray:
        """Adds keys that are not held, and returns the shards that changed. all_of: the keys of a shard, for one that is full and is made anew with more room."""
        where = shard_of(keys, self.shards)
        changed = np.unique(where)
        for k in changed.tolist():
            own = keys[where == k]
            part = CuckooFilter.__new__(CuckooFilter)
            part.size, part.table = self.parts[k].size, self.parts[k].table.copy()
            try:
                if self.held[k] + len(own) > 0.9 * part.size * part.SLOTS:
                    raise OverflowError
                part.insert(own)
                self.parts[k] = part
            except OverflowError:
                self.parts[k] = _filled(all_of(k))
            self.held[k] += len(own)
        return changed

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes out keys that are held; returns the shards that changed."""
        where = shard_of(keys, self.shards)
        changed = np.unique(where)
        for k in changed.tolist():
            own = keys[where == k]
            self.parts[k].delete(own)
            self.held[k] -= len(own)
        return changed

    def taken(self, keys: np.ndarray) -> np.ndarray:
        """What the filters say, wrong answers included."""
        out, where = np.zeros(len(keys), bool), shard_of(keys, self.shards)
        for k, part in enumerate(self.parts):
            at = np.flatnonzero(where == k)
            out[at] = part.contains(keys[at])
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Exact for every key of the corpus."""
        out = self.taken(keys)
        if len(self.wrong) and out.any():
            at = np.flatnonzero(out)
            out[at] = ~np.isin(keys[at], self.wrong)
        return out


def _filled(keys: np.ndarray) -> CuckooFilter:
    room = 1
    while True:
        part = CuckooFilter(room * max(1, len(keys)))
        try:
            part.insert(keys)
            return part
        except OverflowError:
            room *= 2


def keyed_lines(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Lines' spans, their document, whether their key has a character, and the key's two hashes."""
    starts, ends, first = lines(data, offsets)
    solid = np.flatnonzero(~SPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = high > low
    a = np.where(full, solid[np.minimum(low, max(len(solid) - 1, 0))] if len(solid) else starts, starts)
    b = np.where(full, (solid[np.maximum(high - 1, 0)] if len(solid) else starts) + 1, a)
    low_case = LOWER[data]
    return starts, ends, first, full, span_hashes(low_case, a, b, 0), span_hashes(low_case, a, b, 1)


def reference_counts(docs: DataFrame) -> DataFrame:
    """The number of documents (rows) that hold each line key: k1, k2 (128 bits of hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                _, _, first, full, k1, k2 = keyed_lines(*buffer(piece.column("text")))
                owner, k1, k2 = owners(first)[full], k1[full], k2[full]
                order = np.lexsort((owner, k2, k1))
                owner, k1, k2 = owner[order], k1[order], k2[order]
                new_key = np.ones(len(k1), bool)
                new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                new_pair = new_key.copy()
                new_pair[1:] |= owner[1:] != owner[:-1]
                at = np.flatnonzero(new_key)
                n = np.add.reduceat(new_pair.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(n)], ["k1", "k2", "n"])

    return docs.select("text").transform(mapped, run, COUNTS).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


MEMBERS = "doc_id bigint, digest bigint, times bigint"


def _members(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id", F.xxhash64("text").alias("digest")).agg(F.count(F.lit(1)).alias("times"))


class LineIndex:
    """Exact reference counts and the documents that they count, in stored tables, and cuckoo filters over the frequent keys.

    Documents can be added and taken out again: counts change by those of their lines, and a filter's shard by the keys alone that become
    frequent or cease to be. What was added and taken out leaves no trace.
    """

    def __init__(self, counts: DataFrame, members: DataFrame, filters: ShardedFilter | None, min_docs: int = 10, shard_keys: int = 1 << 16, filter_keys: int = 4_000_000):
        """shard_keys: keys of one cuckoo filter. filter_keys: up to so many frequent keys (32 MB or so) filters are kept and sent to the tasks; beyond, there are none, and keys meet the table by a join."""
        self.counts, self.members, self.filters, self.min_docs, self.shard_keys, self.filter_keys = counts, members, filters, min_docs, shard_keys, filter_keys

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, shard_keys: int = 1 << 16, filter_keys: int = 4_000_000, removable: bool = False) -> LineIndex:
        """An index of all lines of docs. removable: keeps which documents they are, so that they can be deleted. Null and empty texts have
        no keys; a repeated row counts as a document of its own; an empty table gives an empty index."""
        members = stored(_members(docs)) if removable else docs.sparkSession.createDataFrame([], MEMBERS)
        out = cls(stored(reference_counts(docs)), members, None, min_docs, shard_keys, filter_keys)
        n = out.frequent().count()
        if n <= filter_keys:
            out.filters = ShardedFilter.of(out._keys(out.frequent()), max(1, -(-n // shard_keys)))
            out._correct(np.arange(out.filters.shards))
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents, too."""
        members = self.members.unionByName(_members(docs)).groupBy("doc_id", "digest").agg(F.sum("times").alias("times"))
        return self._moved(docs, 1, stored(members))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without documents that were inserted before, with the text that they had then; others are refused."""
        gone = _members(docs).withColumn("times", -F.col("times"))
        members = stored(self.members.unionByName(gone).groupBy("doc_id", "digest").agg(F.sum("times").alias("times")))
        if (bad := members.filter("times < 0").first()) is not None:
            raise ValueError(f"document {bad['doc_id']} is not in the index with this text")
        return self._moved(docs, -1, members.filter("times > 0"))

    def _moved(self, docs: DataFrame, sign: int, members: DataFrame) -> LineIndex:
        more = reference_counts(docs).select("k1", "k2", F.lit(0).cast("bigint").alias("before"), (F.col("n") * sign).alias("change"))
        both = self.counts.select("k1", "k2", F.col("n").alias("before"), F.lit(0).cast("bigint").alias("change")).unionByName(more)
        moved = stored(both.groupBy("k1", "k2").agg(F.sum("before").alias("before"), F.sum("change").alias("change")).withColumn("n", F.col("before") + F.col("change")))
        out = LineIndex(moved.filter("n > 0").select("k1", "k2", "n"), members, None, self.min_docs, self.shard_keys, self.filter_keys)
        if self.filters is None or out.frequent().limit(self.filter_keys + 1).count() > self.filter_keys:
            return out
        old = self.filters
        out.filters = ShardedFilter(old.shards, list(old.parts), list(old.held), old.wrong)
        rises = self._keys(moved.filter((F.col("before") < self.min_docs) & (F.col("n") >= self.min_docs)))
        falls = self._keys(moved.filter((F.col("before") >= self.min_docs) & (F.col("n") < self.min_docs)))
        for k in np.unique(shard_of(falls, old.shards)).tolist():  # the old index keeps its own
            part = CuckooFilter.__new__(CuckooFilter)
            part.size, part.table = old.parts[k].size, old.parts[k].table.copy()
            out.filters.parts[k] = part
        changed = np.union1d(out.filters.delete(falls), out.filters.insert(rises, lambda k: out._shard(out.frequent(), k)))
        out._correct(changed, (moved.filter("change <> 0 and n > 0").select("k1", "k2", "n")))
        return out

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n") >= self.min_docs)

    @staticmethod
    def _keys(table: DataFrame) -> np.ndarray:
        return np.asarray(table.select("k1").toArrow().column(0), dtype=np.int64).view(U64)

    def _shard(self, table: DataFrame, k: int) -> np.ndarray:
        keys = self._keys(table)
        return keys[shard_of(keys, self.filters.shards) == k]

    def _correct(self, changed: np.ndarray, more: DataFrame | None = None) -> None:
        """Finds again which rare keys the changed shards take, and which of `more` (keys whose counts moved) the others do; the filters
        are given up where these are too many."""
        made, limit = self.filters, self.min_docs
        sent = self.counts.sparkSession.sparkContext.broadcast((made, changed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters, changed = sent.value
            for batch in batches:
                keys = np.asarray(batch.column("k1"), dtype=np.int64).view(U64)
                rare = np.asarray(batch.column("n"), dtype=np.int64) < limit
                keys = keys[rare & np.isin(shard_of(keys, filters.shards), changed)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[filters.taken(keys)].view(np.int64))], ["k1"])

        kept = made.wrong[~np.isin(shard_of(made.wrong, made.shards), changed)]
        if more is not None:  # keys that are new in a shard that did not change, or not rare any more, or gone
            moved = np.asarray(more.filter(F.col("n") < limit).select("k1").toArrow().column(0), dtype=np.int64).view(U64)
            moved = moved[~np.isin(shard_of(moved, made.shards), changed)]
            kept = np.union1d(kept, moved[made.taken(moved)])
        found = self.counts.transform(mapped, run, "k1 bigint").limit(self.filter_keys + 1).toArrow().column(0) if len(changed) else pa.array([], pa.int64())
        made.wrong = np.union1d(kept, np.asarray(found, dtype=np.int64).view(U64))
        if len(made.wrong) > self.filter_keys:
            self.filters = None

    def save(self, path: str) -> None:
        """Writes counts, documents and filters into a folder."""
        spark, f = self.counts.sparkSession, self.filters
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        rows = [] if f is None else [(k, p.size, f.held[k], bytearray(p.table.tobytes())) for k, p in enumerate(f.parts)] + [(-1, 0, 0, bytearray(f.wrong.tobytes()))]
        spark.createDataFrame(rows, "shard int, size bigint, held bigint, cells binary").write.mode("overwrite").parquet(f"{path}/filters")
        spark.createDataFrame([(self.min_docs, self.shard_keys, self.filter_keys)], "min_docs bigint, shard_keys bigint, filter_keys bigint").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        rows = {r["shard"]: r for r in spark.read.parquet(f"{path}/filters").collect()}
        filters = None
        if rows:
            parts = []
            for k in range(len(rows) - 1):
                part = CuckooFilter.__new__(CuckooFilter)
                part.size, part.table = rows[k]["size"], np.frombuffer(bytes(rows[k]["cells"]), np.uint32).reshape(-1, CuckooFilter.SLOTS).copy()
                parts.append(part)
            filters = ShardedFilter(len(parts), parts, [rows[k]["held"] for k in range(len(parts))], np.frombuffer(bytes(rows[-1]["cells"]), U64))
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/members"), filters, *spark.read.parquet(f"{path}/settings").first())


DROPPED = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"


def drop_lines(docs: DataFrame, index: LineIndex, keep_text: bool = True) -> DataFrame:
    """Documents without their frequent lines: doc_id, n_lines before, n_dropped, text (or kept_sha256), then the other columns.

    Null or empty text is one empty line. Lines whose key is empty always stay. A repeated row counts as a document of its own.
    Columns named like the results are replaced by them. An empty table gives an empty one.
    """
    found = index.filters
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped", "kept_sha256")] if keep_text else []
    held = docs.select("doc_id", "text", *extra)
    row, mine = unused(docs, "_row"), unused(docs, "_frequent")
    if found is None:
        held = _with_frequent(held, index, row, mine)
    sent = docs.sparkSession.sparkContext.broadcast(found)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    last = "text string" if keep_text else "kept_sha256 string"
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "n_lines bigint", "n_dropped bigint", last, *(f"`{c}` {kinds[c]}" for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offsets = buffer(piece.column("text"))
                starts, ends, first, full, k1, _ = keyed_lines(data, offsets)
                if sent.value is not None:
                    drop = full & sent.value.contains(k1)
                else:
                    marks = piece.column(mine).to_pylist()
                    drop = np.zeros(len(full), bool)
                    for i, own in enumerate(marks):
                        if own:
                            drop[first[i] : first[i + 1]] = full[first[i] : first[i + 1]] & np.isin(k1[first[i] : first[i + 1]], np.array(own, np.int64).view(U64))
                raw, out, null = data.tobytes(), [], piece.column("text").is_null().to_pylist()
                gone = np.concatenate([[0], np.cumsum(drop)])
                n_dropped = gone[first[1:]] - gone[first[:-1]]
                for i in range(piece.num_rows):
                    if not n_dropped[i]:
                        rest = raw[offsets[i] : offsets[i + 1]]
                    else:
                        at = np.flatnonzero(~drop[first[i] : first[i + 1]]) + first[i]
                        rest = b"\n".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                    out.append(hashlib.sha256(rest).hexdigest() if not keep_text else None if null[i] else rest.decode())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first)), pa.array(n_dropped), pa.array(out, pa.string()), *(piece.column(c) for c in extra)], names=["doc_id", "n_lines", "n_dropped", last.split()[0], *extra])

    return held.transform(mapped, run, schema)


def _with_frequent(docs: DataFrame, index: LineIndex, row: str, mine: str) -> DataFrame:
    """The way beyond filters: each document's keys meet the table of counts, and come back as one list for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                _, _, first, full, k1, k2 = keyed_lines(*buffer(piece.column("text")))
                ids = np.asarray(piece.column(row), dtype=np.int64)[owners(first)[full]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k1[full].view(np.int64)), pa.array(k2[full].view(np.int64))], ["row", "k1", "k2"])

    # a row is known by its id and text, which do not change when the table is read again
    docs = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    asked = docs.select(row, "text").transform(mapped, run, "row bigint, k1 bigint, k2 bigint").distinct()
    found = asked.join(index.frequent().select("k1", "k2"), ["k1", "k2"]).groupBy(F.col("row").alias(row)).agg(F.collect_set("k1").alias(mine))
    return docs.join(found, row, "left").drop(row)
