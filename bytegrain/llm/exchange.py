"""Packed exchanges: tasks send few rows of packed arrays to numbered partitions, and tables are cut off in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def width(spark: SparkSession) -> int:
    """The number of partitions that packed arrays are dealt to; it follows the session's setting, which follows the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(frame: DataFrame, n: int) -> DataFrame:
    """Row by row to partition `bucket`, which the sender filled evenly by hash."""
    return frame.repartitionById(n, F.col("bucket"))


#: Bytes of rows that Spark hands to Python at once; its own limit is a number of rows, however long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """frame.mapInArrow with batches of bounded bytes (unless the session has a limit of its own); a worker gives memory back after each task,
    so that idle workers of one stage do not take the room of the next."""
    spark = frame.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return frame.mapInArrow(lean, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir. Only where that is unset and all tasks run on this machine, as in tests, a local one is
    taken; on a cluster an unset folder is an error, since machines would not see each other's files."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    MADE.append(f"{root.rstrip('/')}/bytegrain-{uuid.uuid4().hex}")
    return MADE[-1]


#: Folders that this process has made, oldest first.
MADE: list[str] = []


def forget(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders made after the first `since` ones, but those to keep: for a caller whose result has been written elsewhere."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for folder in [f for f in MADE[since:] if f not in keep]:
        path(folder).getFileSystem(conf).delete(path(folder), True)
        MADE.remove(folder)


def stored(frame: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and rereads it: lineage ends there, and a lost executor loses nothing."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of a sieve at most: 16 MB. With more keys than it has room for it lets more pass, and what follows has more to do.
SIEVE_BITS = 1 << 27


class Sieve:
    """A Bloom filter over 64-bit hashes: lets all of its keys pass, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        return np.stack([(hashes >> np.uint64(s)) & np.uint64(size - 1) for s in (0, 16, 32, 37)], 1).astype(np.int64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, 64 * len(self.bits))
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def sieve(keys: DataFrame) -> Sieve:
    """A sieve over the only column of keys, 64-bit hashes. Tasks send words of bits; the driver gets SIEVE_BITS at most."""
    name, size = keys.columns[0], 1 << 12
    n = keys.count()
    while size < 16 * n and size < SIEVE_BITS:
        size <<= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Sieve.places(np.asarray(batch.column(0), dtype=np.int64).view(np.uint64), size))
            cut = runs(at >> 6)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), cut) if len(cut) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at[cut] >> 6), pa.array(masks.view(np.int64))], ["word", "mask"])

    got = keys.filter(F.col(name).isNotNull()).transform(mapped, run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[np.asarray(got.column("word"), dtype=np.int64)] = np.asarray(got.column("mask"), dtype=np.int64)
    return Sieve(bits.view(np.uint64))


def sifted(frame: DataFrame, key, by: Sieve, inside: bool = True) -> DataFrame:
    """The rows whose key (a column of 64-bit hashes) passes the sieve, or those whose key does not; no shuffle."""
    sent, name = frame.sparkSession.sparkContext.broadcast(by), unused(frame, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(batch.num_columns - 1), dtype=np.int64).view(np.uint64)
            kept = sent.value.passes(keys) == inside
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(kept))

    return frame.withColumn(name, key).transform(mapped, run, frame.schema)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Partition of each hash, by its high bits."""
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any fixed type, one after another, with their types and lengths."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size, out = int.from_bytes(blob[:4], "little"), []
    at = 4 + size
    for x in bytes(blob[4:at]).decode().split(";"):
        kind, n = np.dtype(x[:3]), int(x[3:])
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


PACKED_SCHEMA = "bucket int, blob binary"


def packed_rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
