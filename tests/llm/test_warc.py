"""The archive writer: ranges of even bytes whatever the ids, equal bytes of every run, records that can be trusted."""

import glob
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from bytegrain.llm import warc
from bytegrain.llm.exchange import shared_folder

PAGES = "page_id bigint, url string, payload binary"


def keyed(spark, rows):
    return spark.createDataFrame(rows, "id bigint, h bigint, size bigint")


def loads(rows, edges):
    out = [0] * (len(edges) + 1)
    for i, h, size in rows:
        out[sum((i, h) >= e for e in edges)] += size
    return out


@pytest.mark.parametrize("name", ["in order", "hashed", "outlier", "one id", "long payloads", "none"])
def test_ranges_hold_equal_bytes(spark, name):
    draw = random.Random(4)
    ids = {
        "in order": list(range(3000)), "hashed": [draw.randrange(-(1 << 63), 1 << 63) for _ in range(3000)], "outlier": [*range(3000), (1 << 62), -(1 << 62)], "one id": [7] * 3000, "long payloads": list(range(3000)), "none": [],
    }[name]
    rows = [(i, draw.randrange(1 << 60), 900 if name == "long payloads" and i < 300 else 10) for i in ids]
    edges = warc.edges(keyed(spark, rows), 8, cells=64)
    assert edges == sorted(set(edges)) and edges == warc.edges(keyed(spark, rows[::-1]), 8, cells=64)
    if rows:
        assert len(edges) == 7 and max(loads(rows, edges)) <= 1.6 * sum(r[2] for r in rows) / 8
        got = keyed(spark, rows).select("id", "h", warc.range_of(edges).alias("r")).collect()
        assert all(r["r"] == sum((r["id"], r["h"]) >= e for e in edges) for r in got)


def test_thousands_of_ranges_can_be_planned(spark):
    found = [(k, 0) for k in range(0, 20000, 10)]
    got = spark.range(-5, 20005).select(F.col("id"), F.lit(5).cast("bigint").alias("h")).withColumn("r", warc.range_of(found)).collect()
    assert all(r["r"] == min(2000, max(0, r["id"] // 10 + 1)) for r in got)


def pages(spark):
    body = [b"", b"<p>same</p>", b"x" * 3000, "é".encode() * 50]
    rows = [(k, f"http://a.net/{k}", body[k % 4] + (b"%d" % k if k % 4 > 2 else b"")) for k in range(200)]
    return spark.createDataFrame([*rows, (None, None, b"<p>same</p>"), (None, "u", b"alone"), (5, "again", b"<p>same</p>"), (1 << 62, "far", b"far"), (-(1 << 62), "far\r\nX: y", b"far")], PAGES)


def files(folder):
    root = folder.removeprefix("file://")
    return {os.path.basename(f): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{root}/*.warc.gz")}


def test_runs_write_equal_bytes_and_roll(spark):
    written = []
    for parts in (3, 5):
        records, folder = pages(spark).repartition(parts), shared_folder(spark)
        manifest = warc.write(records, warc.revisits(records), folder, roll_bytes=4000).collect()
        written.append(files(folder))
        assert {r["file"]: r["sha256"] for r in manifest} == written[-1] and sum(r["n_records"] for r in manifest) == 205
    assert written[0] == written[1] and len(written[0]) > 4
    # what a task that died left behind is not named by the manifest, and a task that runs again replaces its file
    root = folder.removeprefix("file://")
    open(f"{root}/_tmp-part-00000-00000.warc.gz-9", "wb").write(b"half")
    assert warc.read(spark, folder).count() == 205


def test_null_and_repeated_ids(spark):
    records, folder = pages(spark), shared_folder(spark)
    warc.write(records, warc.revisits(records), folder)
    got = {(r["page_id"], r["url"]): r for r in warc.read(spark, folder).collect()}
    assert len(got) == 205
    same = max(k for k in range(200) if k % 4 == 1)
    assert (got[None, ""]["record_type"], got[None, ""]["refers_to"]) == ("revisit", same)
    assert (got[5, "again"]["record_type"], got[5, "again"]["refers_to"]) == ("revisit", same) == (got[5, "http://a.net/5"]["record_type"], got[5, "http://a.net/5"]["refers_to"])
    assert got[None, "u"]["record_type"] == got[1 << 62, "far"]["record_type"] == "response"
    assert got[-(1 << 62), "far  X: y"]["refers_to"] == 1 << 62
    lone = spark.createDataFrame([(None, "a", b"z"), (None, "b", b"z"), (9, "c", b"y"), (9, "d", b"y")], PAGES)
    assert warc.revisits(lone).collect() == []


def test_damage_is_found(spark):
    raw = warc.record(1, "http://a/", b"payload", "response", None, warc.base32_sha1(b"payload"))
    text = gzip.decompress(raw)
    assert warc.parsed(text)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(text.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))
    with pytest.raises(ValueError):
        import io

        list(warc.members(io.BytesIO(raw + raw[:-9])))
