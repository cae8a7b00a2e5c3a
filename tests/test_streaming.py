"""Decoding streams: windows, sessions, and payloads that come too late."""

import datetime as dt

import pytest

from bytegrain.streaming import decode

START = dt.datetime(2024, 1, 1, 12)
SCHEMA = "time timestamp, source string, payload binary"


def stream(spark, folder, batches):
    """A stream that takes one file of rows (minutes after START, source, payload) a time, in order."""
    for k, rows in enumerate(batches):
        made = [(START + dt.timedelta(minutes=m), s, bytearray(p)) for m, s, p in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def finished(frame, name, mode="append"):
    run = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    return run


GOOD, BAD = b"NUMS\0\1", b"NUMX"


def minutes(rows):
    return sorted(((r["start"] - START).total_seconds() / 60, r["n_good"], r["n_bad"]) for r in rows)


@pytest.mark.parametrize("slide, want", [(None, [(0, 2, 1), (10, 1, 0)]), ("5 minutes", [(-5, 2, 1), (0, 2, 1), (5, 1, 0), (10, 1, 0)])])
def test_windows_and_late_data(spark, tmp_path, slide, want):
    batches = [[(1, "a", GOOD), (2, "a", BAD), (3, "b", GOOD)], [(14, "a", GOOD)], [(40, "b", GOOD)], [(41, "b", GOOD)], [(4, "a", GOOD)], [(60, "a", BAD)]]
    decoded = decode.decode_stream(stream(spark, tmp_path, batches), "numbers", "struct<values:array<struct<tag:string>>>", keep=["time", "source"])
    name = f"windows_{'slide' if slide else 'plain'}"
    finished(decode.counts_by_time(decoded, "time", "10 minutes", "5 minutes", slide), name)
    got = minutes(spark.table(name).collect())
    # what came at minute 4 after minute 40 had been seen in an earlier batch but one is not counted; windows that the last watermark (55) has not passed are open
    assert got[: len(want)] == want and sum(g for _, g, _ in got) == (5 if slide is None else 10)


def test_sessions(spark, tmp_path):
    batches = [[(0, "a", GOOD), (4, "a", GOOD), (30, "a", BAD), (1, "b", GOOD)], [(90, "c", GOOD)], [(91, "c", GOOD)]]
    decoded = decode.decode_stream(stream(spark, tmp_path, batches), "numbers", "struct<values:array<struct<tag:string>>>", keep=["time", "source"])
    finished(decode.counts_by_session(decoded, "time", "source", "10 minutes", "5 minutes"), "sessions")
    rows = spark.table("sessions").collect()
    got = sorted((r["source"], (r["start"] - START).total_seconds() / 60, (r["end"] - START).total_seconds() / 60, r["n_good"], r["n_bad"]) for r in rows)
    assert got == [("a", 0, 14, 2, 0), ("a", 30, 40, 0, 1), ("b", 1, 11, 1, 0)]
