"""What goes wrong with one row stays with that row."""

import decimal

from pyspark.sql import functions as F

from bytegrain.operators import combinators as C
from bytegrain.operators import format as N
from bytegrain.sources import payloads


def rows(spark, *raw):
    return spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(raw)], "k int, payload binary")


def test_values_that_a_type_cannot_hold(spark):
    frame = rows(spark, b"\0" * 7 + b"\1", b"\xff" * 8, None, b"\1", b"\0" * 8)
    got = payloads.decode_column(frame, C.u64be, "bigint").orderBy("k").collect()
    assert [r["value"] for r in got] == [1, None, None, None, 0]
    assert [r["error"] and r["error"]["kind"] for r in got] == [None, "eval", None, "Overbyte", None]
    got = payloads.decode_column(frame, C.u64be, "decimal(20,0)").orderBy("k").collect()
    assert [r["value"] for r in got][:2] == [1, decimal.Decimal(2**64 - 1)]


def test_values_of_another_shape(spark):
    got = payloads.decode_column(rows(spark, b"a"), C.u8, "array<bigint>").collect()
    assert got[0]["value"] is None and got[0]["error"]["kind"] == "eval"


def test_inflating_is_bounded(spark):
    import zlib

    press = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = press.compress(bytes(100_000)) + press.flush()
    got = payloads.decode_column(rows(spark, raw), N.Inflate(most=1000), "binary").collect()
    assert got[0]["error"]["kind"] == "Overrun"
    assert payloads.decode_column(rows(spark, raw), N.Inflate(), "binary").select(F.octet_length("value").alias("n")).first()["n"] == 100_000


def test_renderings(spark):
    fmt = C.record(("n", C.u8), ("part", C.record(("a", C.fixed_ascii(2)), ("b", C.cond_maybe(C.X.lift(True), C.u16be)))), ("many", C.repeat(C.u8)))
    got = payloads.render_column(rows(spark, b"\1hi\0\2xyz", None, b""), fmt, "json", "tree", "flat", "located").orderBy("k").collect()
    assert got[0]["json"] == '{"n": 1, "part": {"a": [104, 105], "b": 2}, "many": [120, 121, 122]}'
    assert [tuple(x) for x in got[0]["located"]] == [("n", 0, 1), ("part.a", 1, 3), ("part.b", 3, 5), ("part", 1, 5), ("many", 5, 8)]
    assert [tuple(x) for x in got[0]["flat"]] == [("n", "1"), ("part.a", "hi"), ("part.b", "2"), ("many", "xyz")]
    assert got[0]["tree"].startswith("value\n  n: 1\n  part\n    a: 'hi'\n")
    assert got[1]["json"] is None and got[1]["error"] is None and got[2]["error"]["kind"] == "Overbyte"
