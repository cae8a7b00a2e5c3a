"""Every query of the catalog against its SQL, on the smallest tables."""

import glob
import itertools
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bytegrain.plans import catalog
from bytegrain.sources import payloads
from bytegrain.streaming import decode

SF = "/root/testdata/sf0.001"


def norm(rows):
    def one(v):
        return int(v) if isinstance(v, float) and v == int(v) else bytes(v) if isinstance(v, bytearray) else v

    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert norm([r[c] for c in names] for r in frame.collect()) == norm(cursor.fetchall())


def test_census(spark):
    assert {r["format"] for r in catalog.QUERIES["census_ops"](spark, SF).collect()} >= {"png", "tar", "text"}


def test_files_and_stream(spark, tmp_path):
    for k, raw in enumerate((b"NUMS\0\1", b"NUMX\0\1", b"NUM")):
        (tmp_path / f"f{k}.num").write_bytes(raw)
    schema = "struct<values:array<struct<tag:string,u8:bigint>>>"
    found = payloads.decode_column(payloads.read_files(spark, str(tmp_path), "*.num"), "numbers", schema).collect()
    assert sorted(r["error"] is None for r in found) == [False, False, True]
    stream = decode.decode_stream(decode.read_stream(spark, str(tmp_path), "*.num"), "numbers", schema, keep=["path"])
    run = stream.writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("decoded").count() == 3


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["anti_prefix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "p_name" not in plan.split("ReadSchema")[1]


#: Types of three ranges that begin and end with the same type.
MIRRORED = [(k, "b" if k % 4096 in (7, 9) else "a") for k in range(3 * 4096)]
MIXED = [(k, "abc"[k * k % 11 % 3]) for k in range(120)]
EVENTS = {
    "mirrored": MIRRORED,
    "negative": [(k - 2 * 4096, t) for k, t in MIRRORED],
    "null types": [(k, None if t == "b" else t) for k, t in MIRRORED] + [(-1, None)],
    "far": [((k - 60) << 40, t) for k, t in MIXED] + [(-(2**63), "a"), (2**63 - 1, "a")],
    "close to 2 ** 63": [(2**63 - 1 - k, t) for k, t in MIXED],
    "one without an id": [(None if k == 50 else k, t) for k, t in MIXED],
    "none": [],
}


def _runs(spark, folder, rows):
    ids, types = [k for k, _ in rows], [t for _, t in rows]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "event_type": pa.array(types, pa.string())}), folder / "events.parquet")
    return norm(catalog.QUERIES["rle_encode_events"](spark, str(folder)).select("event_type", "first_id", "n").collect())


@pytest.mark.parametrize("kind,span", [*((k, 4096) for k in EVENTS), ("mirrored", 16), ("one without an id", 4)])
def test_runs_of_events(spark, tmp_path, monkeypatch, kind, span):
    monkeypatch.setattr(catalog, "SPAN", span)
    found = _runs(spark, tmp_path, EVENTS[kind])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert found == norm(con.execute(catalog.ORACLES["rle_encode_events"]).fetchall())


@pytest.mark.parametrize("span", [4, 4096])
def test_runs_of_equal_and_missing_ids(spark, tmp_path, monkeypatch, span):
    """SQL leaves their order open; here it is that of the file, ids that are missing last."""
    monkeypatch.setattr(catalog, "SPAN", span)
    rows = [(None if k % 5 == 0 else k // 7, t) for k, t in MIXED]
    expected = []
    for t, run in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[1]):
        ids = [k for k, _ in run]
        expected.append((t, min((k for k in ids if k is not None), default=None), len(ids)))
    assert _runs(spark, tmp_path, rows) == norm(expected)
