"""WARC archives: a deterministic sharded writer with manifests, and a reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import dealt, mapped, stored, width
from .text import slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, n_records bigint, n_bytes bigint, sha256 string, first_id bigint, last_id bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI, reachable from every executor; a bare path is a local or mounted one."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _line(text: str) -> str:
    return "".join(" " if c in "\r\n" else c for c in text)


def record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """One record with headers made anew from its parts, as a gzip member; the same parts always give the same bytes."""
    block = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url and payload (the html in UTF-8; null is empty)."""
    return pages.select("page_id", "url", F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b"")).alias("payload"))


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, refers_to, d (hex SHA-1 of the payload): of records with equal payloads of min_bytes at least, that with the largest page_id is referred to by the others.

    Records meet by digest only; digests of one record are dropped before the join. A null page_id counts as smaller than any other; where all
    are null, none refers to another. Records that share the largest page_id are all referred to. An empty table gives an empty one; other
    columns than page_id and payload are not read.
    """
    digests = stored(records.filter(F.octet_length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("d")))
    groups = digests.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").select("d", "refers_to")
    return digests.join(groups, "d").filter("not page_id <=> refers_to").select("page_id", "refers_to", "d")


LEAST_ID = -(1 << 63)
#: Payload bytes of a range, where the session's number of partitions would make larger ones.
RANGE_BYTES = 256 << 20


def _keyed(page_id: Column, sha1: Column) -> list[Column]:
    """The key that ranges are made of: page_id (null as the least), then 60 bits of the payload's digest."""
    return [F.coalesce(page_id, F.lit(LEAST_ID)).alias("id"), F.conv(F.substring(sha1, 1, 15), 16, 10).cast("bigint").alias("h")]


def edges(keys: DataFrame, n: int, cells: int = 1 << 14) -> list[tuple[int, int]]:
    """Where ranges 1 to n - 1 of the key (id, h) begin, so that each has about as many of the bytes `size`.

    Sizes are summed exactly, not sampled, so the ranges are the same in every run: first over `cells` equal cells between the least and the
    largest key, then over cells of those cells alone that hold over a quarter of a range, each between its own least and largest key, until
    none does or it is one key. Neither an outlier nor a crowd of ids makes a range large. The driver gets about `cells` sums a round.
    """
    whole = keys.agg(F.min(F.struct("id", "h")).alias("low"), F.max(F.struct("id", "h")).alias("high"), F.sum("size").alias("size")).first()
    if whole["low"] is None:
        return []
    spark, total = keys.sparkSession, max(1, whole["size"])
    leaves, open_, rows = [], [(tuple(whole["low"]), tuple(whole["high"]), whole["size"])], keys.withColumn("cell", F.lit(0))
    while open_:
        plan = []
        for k, (low, high, _) in enumerate(open_):
            by_id = low[0] != high[0]
            a, b = (low[0], high[0]) if by_id else (low[1], high[1])
            shift = int(b - a >= 1 << 62)  # differences must not overflow
            plan.append((k, by_id, shift, a >> shift, ((b >> shift) - (a >> shift)) // max(2, cells // len(open_)) + 1))
        cut = F.broadcast(spark.createDataFrame(plan, "cell int, by_id boolean, shift int, low bigint, step bigint"))  # len(open_) <= 4 n rows
        rows = rows.join(cut, "cell").withColumn("sub", F.expr("(shiftright(if(by_id, id, h), shift) - low) div step")).select("id", "h", "size", "cell", "sub")
        found = rows.groupBy("cell", "sub").agg(F.min(F.struct("id", "h")).alias("low"), F.max(F.struct("id", "h")).alias("high"), F.sum("size").alias("size")).collect()
        open_, names = [], []
        for r in sorted(found, key=lambda r: r["low"]):
            cell = (tuple(r["low"]), tuple(r["high"]), r["size"])
            if r["size"] * 4 * n > total and cell[0] != cell[1]:
                names.append((r["cell"], r["sub"], len(open_)))
                open_.append(cell)
            else:
                leaves.append(cell)
        if open_:
            some = F.broadcast(spark.createDataFrame(names, "cell int, sub bigint, next int"))
            rows = rows.join(some, ["cell", "sub"]).select("id", "h", "size", F.col("next").alias("cell"))
    out, seen = [], 0
    for low, _, size in sorted(leaves):
        if seen * n >= total * (len(out) + 1) and seen:  # a new range begins at the first cell past each n-th part
            out.append(low)
        seen += size
    return out


def range_of(found: list[tuple[int, int]]) -> Column:
    """The number of the range of columns id and h, by binary search in a constant."""
    if not found:
        return F.lit(0)
    ids, hs = (F.split(F.lit(",".join(str(e[k]) for e in found)), ",").cast("array<bigint>") for k in range(2))
    steps = [1 << k for k in reversed(range(len(found).bit_length()))]

    def go(at: Column, step: Column) -> Column:
        k = at + step - 1
        return at + F.when((F.get(ids, k) < F.col("id")) | ((F.get(ids, k) == F.col("id")) & (F.get(hs, k) <= F.col("h"))), step).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go)


def write(records: DataFrame, again: DataFrame, folder: str, roll_bytes: int = 16 << 20, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes records (page_id, url, payload) in order of page_id, those of `again` (page_id, refers_to, d) as revisits, and returns the manifest.

    Of rows that share a page_id each becomes a record; a revisit's refers_to holds for those with its payload's digest. Null ids come first, a
    null url is written as an empty one. An empty table gives an empty manifest; other columns are not read.

    Files are rolled once their compressed size reaches roll_bytes. Each is written under a temporary name and renamed when complete, so a
    task that runs again replaces the same file by the same bytes. The archive counts as committed once the manifest stands beside it.
    Tasks take ranges of about equal bytes: as many as the session has shuffle partitions, more where a range would hold over range_bytes.
    """
    spark = records.sparkSession
    sizes = stored(records.select(*_keyed(F.col("page_id"), F.sha1("payload")), (F.octet_length("payload") + 512).cast("bigint").alias("size")))
    n = max(width(spark), -(-(sizes.agg(F.sum("size")).first()[0] or 0) // range_bytes))
    # records of one id and payload are ordered by url, so that the bytes do not depend on the order of arrival
    none = F.lit(None)
    both = records.select("page_id", "url", "payload", none.cast("bigint").alias("refers_to"), none.cast("string").alias("d"), *_keyed(F.col("page_id"), F.sha1("payload"))).unionByName(
        again.select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "refers_to", "d", *_keyed(F.col("page_id"), F.col("d")))
    )
    ordered = dealt(both.withColumn("bucket", range_of(edges(sizes, n))), n).sortWithinPartitions("id", "h", F.col("refers_to").isNull(), "url").select("page_id", "url", "payload", "refers_to", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        task, part, out, rows, digest = TaskContext.get(), 0, None, [], None
        done = []

        def close() -> None:
            nonlocal out
            out.close()
            store.move(temporary, f"{root}/{name}")
            done.append((name, len(rows), n_bytes, digest.hexdigest(), rows[0], rows[-1]))
            out = None

        marks: dict = {}  # of one page_id
        for page_id, url, payload, refers_to, d in (row for batch in batches for piece in slices(batch, "payload") for row in zip(*(c.to_pylist() for c in piece.columns))):
            if refers_to is not None:  # comes before the records with that id
                marks = (marks if marks.get("of") == page_id else {"of": page_id}) | {d: refers_to}
                continue
            sha1 = hashlib.sha1(payload).digest()
            refers_to = marks.get(sha1.hex()) if marks.get("of") == page_id else None
            if out is None:
                name = f"part-{task.partitionId():05d}-{part:05d}.warc.gz"
                temporary = f"{root}/_tmp-{name}-{task.taskAttemptId()}"
                out, rows, n_bytes, digest = store.open_output_stream(temporary, compression=None), [], 0, hashlib.sha256()
                part += 1
            raw = record(page_id, url or "", payload, "response" if refers_to is None else "revisit", refers_to, base64.b32encode(sha1).decode())
            out.write(raw)
            digest.update(raw)
            rows.append(page_id)
            n_bytes += len(raw)
            if n_bytes >= roll_bytes:
                close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)] if done else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())], names=[c.split()[0] for c in MANIFEST.split(", ")])

    manifest = ordered.transform(mapped, run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest-{(mark := uuid.uuid4().hex)}.tmp")
    store, root = _open(folder)
    store.move(f"{root}/_manifest-{mark}.tmp", f"{root}/_manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked."""
    press, out = zlib.decompressobj(31), []
    while raw := stream.read(chunk):
        while raw:
            out.append(press.decompress(raw))
            raw = press.unused_data
            if press.eof:
                yield b"".join(out)
                press, out = zlib.decompressobj(31), []
            else:
                break
    if any(out):
        raise ValueError("the archive ends within a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; digests and length must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"a damaged record: {fields.get('WARC-Record-ID')}")
    return fields, block


RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, block binary, headers string"


def read(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The records of all files that the manifest names. A file is streamed, record by record; blocks=False leaves the blocks out.

    An empty manifest gives no records. A damaged record, or a file that ends within one, is an error."""
    files = read_manifest(spark, folder).select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)

        def sent(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        h, block = parsed(raw)
                        refers = h.get("X-Refers-To-Page-ID")
                        rows.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(refers) if refers else None, block if blocks else None, json.dumps(h) if blocks else None))
                        held += len(raw)
                        if held > 4 << 20:
                            yield sent(rows)
                            rows, held = [], 0
                if rows:
                    yield sent(rows)

    return files.repartition(width(spark)).transform(mapped, run, RECORDS)
