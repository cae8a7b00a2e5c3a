"""Queries over the driver's tables, one for each operator or group of operators, and the same in SQL.

Static layouts become Catalyst expressions made from the same expression trees that decode programs use; data-dependent ones run as decode
programs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import numeric as M
from ..functions import pattern as P
from ..functions.sets import ByteSet
from ..functions.values import Int
from ..operators import combinators as C
from ..operators import format as N
from ..sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
V = X.var


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(frame: DataFrame, *keep: str, **trees: X.Expr) -> DataFrame:
    """Kept columns and expression trees over the frame's columns."""
    return frame.select(*keep, *(X.column(t, {}).alias(k) for k, t in trees.items()))


def be(x, n: int):
    """A number as n bytes, highest first."""
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decimal digits of each order's key."""
    d = F.transform(F.regexp_extract_all(F.col("o_orderkey").cast("string"), F.lit("([0-9])"), 1), lambda c: c.cast("bigint"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))


_DIGITS = "(select o_orderkey, list_transform(string_split(o_orderkey::varchar, ''), lambda c: c::bigint) as d from orders)"


@query("""select doc_id, octet_length(encode(text))::bigint as n_bytes, length(text)::bigint as n_chars,
 length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g'))::bigint as n_one from documents""")
def utf8_decode_stats(spark, sf_dir):
    """Bytes, code points and one-byte sequences of UTF-8 text, by Spark's own functions."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.char_length("text").cast("bigint").alias("n_chars"), F.char_length(F.regexp_replace("text", r"[^\x00-\x7f]", "")).cast("bigint").alias("n_one"))


@query("select doc_id, length(text)::bigint as n_chars, octet_length(encode(text))::bigint as n_bytes, sha256(text) as digest from documents")
def utf8_decode_program(spark, sf_dir):
    """Repeat, Union, Map and AsChar: the text format run as a decode program on every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    found = payloads.decode_column(docs, "text", "string")
    return found.select("doc_id", F.char_length("value").cast("bigint").alias("n_chars"), "n_bytes", F.sha2(F.encode("value", "utf-8"), 256).alias("digest"))


@query("""select page_id, length(regexp_replace(html, '[^0-9]', '', 'g'))::bigint as n_digits, length(regexp_replace(html, '[^A-Za-z]', '', 'g'))::bigint as n_letters, length(regexp_replace(html, '[^<>]', '', 'g'))::bigint as n_angles from pages""")
def byte_class_counts(spark, sf_dir):
    """Byte(set): counts of bytes in sets."""
    sets = {"n_digits": ByteSet.of(b"0123456789"), "n_letters": ByteSet.of(range(65, 91)) | ByteSet.of(range(97, 123)), "n_angles": ByteSet.of(b"<>")}
    return table(spark, sf_dir, "pages").select("page_id", *(F.regexp_count("html", F.lit(s.regex())).cast("bigint").alias(k) for k, s in sets.items()))


def _packed(n: int, order: str):
    raw = F.unhex(F.lpad(F.hex("o_orderkey"), 2 * n, "0"))
    return raw if order == "big" else F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), 1)), ""))


def _roundtrip(kind: str, order: str):
    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", _packed(int(kind[1:]) // 8, order).alias("raw"))
        return orders.select("o_orderkey", X.column(X.endian(kind, order, V("raw")), {}).cast("bigint").alias("value"))

    run.__name__ = f"{kind}{order[0]}e_roundtrip"
    run.__doc__ = f"{kind} numbers, {order}-endian, packed and read."
    return run


for _kind in ("u32", "u64"):
    for _order in ("big", "little"):
        query("select o_orderkey, o_orderkey as value from orders")(_roundtrip(_kind, _order))


@query("select o_orderkey, (o_orderkey & 65535)::bigint as value from orders")
def u16be_program(spark, sf_dir):
    """u16 read by a decode program."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex(F.col("o_orderkey").bitwiseAND(65535)), 4, "0")).alias("payload"))
    return payloads.decode_column(orders, C.u16be, "bigint").select("o_orderkey", "value")


@query("""select o_orderkey, ((o_orderkey >> 7) & 1) <> 0 as table_flag, ((o_orderkey >> 4) & 7)::bigint as color_resolution, ((o_orderkey >> 3) & 1) <> 0 as sort_flag, (o_orderkey & 7)::bigint as table_size from orders""")
def bit_fields_gif_flags(spark, sf_dir):
    """bit_fields: fields of a byte from its highest bit down."""
    key = V("o_orderkey")
    part = lambda at, n: (key >> at) & ((1 << n) - 1)
    return select(table(spark, sf_dir, "orders"), "o_orderkey", table_flag=part(7, 1).ne(0), color_resolution=part(4, 3), sort_flag=part(3, 1).ne(0), table_size=part(0, 3))


@query("select o_orderkey, list_sum([((o_orderkey >> i) & 1) for i in range(8)])::bigint as n_set, (o_orderkey & 1)::bigint as lowest from orders")
def bits_lsb_first(spark, sf_dir):
    """Bits: a byte's bits, lowest first, by a decode program."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex(F.col("o_orderkey").bitwiseAND(255)), 2, "0")).alias("payload"))
    found = payloads.decode_column(orders, C.bits(C.repeat_count(8, C.ANY)), "binary")
    digits = F.hex("value")
    return found.select("o_orderkey", F.regexp_count(digits, F.lit("01")).cast("bigint").alias("n_set"), F.substring(digits, 2, 1).cast("bigint").alias("lowest"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as q from lineitem where l_quantity::bigint between 10 and 20")
def filter_pushed_down(spark, sf_dir):
    """A range test as a filter that reaches the scan."""
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").filter(q.between(10, 20)).select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"))


@query("select o_orderkey, case when o_orderkey % 7 = 3 then 'BadWhere' end as warning from orders")
def where_expect(spark, sf_dir):
    """Where, soft: a warning instead of an error, by a decode program."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0")).alias("payload"))
    found = payloads.decode_column(orders, C.expect(C.u32be, lambda x: (x % 7).ne(3)), "bigint")
    return found.select("o_orderkey", F.get("warnings", F.lit(0)).getField("kind").alias("warning"))


@query("select p_partkey, case when p_size = 1 then 'one' when p_size between 2 and 9 then 'few' else 'many' end as tag, case when p_size between 2 and 9 then p_size::bigint + 1 else 0 end as n from part")
def match_patterns(spark, sf_dir):
    """Match over patterns: literal, range, binding."""
    size = X.lift(0) + V("p_size")
    tag = X.match(size, (P.integer(1), "one"), (P.between(2, 9), "few"), (P.wildcard(), "many"))
    n = X.match(size, (P.integer(1), 0), (P.between(2, 9), size + 1), (P.binding("x"), V("x") * 0))
    return table(spark, sf_dir, "part").select("p_partkey", X.column(tag, {}).alias("tag"), X.column(n, {}).cast("bigint").alias("n"))


@query("select p_type as tag, count(*)::bigint as n from part group by p_type")
def union_look_ahead(spark, sf_dir):
    """Deterministic choice by look-ahead, as a decode program over type names."""
    names = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    choice = N.Union(tuple(N.Variant(k, C.is_bytes(k.encode())) for k in names))
    parts = table(spark, sf_dir, "part").select(F.encode("p_type", "utf-8").alias("payload"))
    return payloads.decode_column(parts, choice, "struct<tag:string>").groupBy(F.col("value.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, p_type from part where not starts_with(p_type, 'ECONOMY')")
def anti_prefix(spark, sf_dir):
    """An anti predicate on a prefix, in the scan."""
    return table(spark, sf_dir, "part").filter(~F.startswith("p_type", F.lit("ECONOMY"))).select("p_partkey", "p_type")


@query("select doc_id, ((512 - n_chars % 512) % 512)::bigint as pad from documents")
def align_pad(spark, sf_dir):
    """Align: bytes up to the next multiple."""
    return select(table(spark, sf_dir, "documents"), "doc_id", pad=(X.lift(512) - V("n_chars") % 512) % 512)


#: Ids of a range, and ranges of a range of the next level; a power of 2.
SPAN = 4096
_RUNS = "select event_type, event_id, row_number() over (order by event_id) - row_number() over (partition by event_type order by event_id) as g from events"


@query(f"select event_type, min(event_id) as first_id, count(*)::bigint as n from ({_RUNS}) group by event_type, g")
def rle_encode_events(spark, sf_dir):
    """Run lengths of event types in order of event_id: runs are found within ranges of ids, and of each range only its first and last run
    go on to the next level, where ranges are ranges of ranges, until few are left; so no task sorts all events, or all ranges. Two runs
    of one range never meet again: what lay between them is done. Events of equal ids follow in the order of the files, and those without
    an id come last; one task handles those of one id."""
    events = table(spark, sf_dir, "events")
    runs = events.select("event_type", F.col("event_id").alias("first_id"), F.lit(1).cast("bigint").alias("n"), F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    out, bits, last = None, 0, False
    while not last:
        last = low is None or (high >> bits) - (low >> bits) < SPAN
        cell, bits = F.col("part") if bits else None, bits + SPAN.bit_length() - 1
        ranged = runs.withColumn("range", F.lit(0) if last else F.shiftright(F.col("first_id").cast("bigint"), bits))
        inside = Window.partitionBy("range").orderBy(F.asc_nulls_last("first_id"), "at")
        new = F.lag("n").over(inside).isNull() | ~F.lag("event_type").over(inside).eqNullSafe(F.col("event_type"))
        if cell is not None:
            new |= F.lag(cell).over(inside).eqNullSafe(cell)
        merged = ranged.withColumn("run", F.sum(new.cast("bigint")).over(inside)).groupBy("range", "run", "event_type").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
        merged = merged.withColumn("edge", F.lit(False) if last else (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("range"))))
        done = merged.filter("not edge").select("event_type", "first_id", "n")
        out = done if out is None else out.unionAll(done)
        runs = merged.filter("edge").select("event_type", "first_id", "n", F.col("run").alias("at"), F.col("range").alias("part"))
    return out


@query("select o_orderkey, repeat(chr(65 + (o_orderkey % 5)::int), 1 + (o_orderkey % 9)::int) || repeat('z', (o_orderkey % 3)::int) as data from orders")
def rle_decode(spark, sf_dir):
    """The run-length format, expanded by a decode program."""
    key = F.col("o_orderkey")
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    raw = F.unhex(F.concat(F.lit("01"), two(key % 9 + 1), two(key % 5 + 65), two(key % 3), F.lit("7A")))
    found = payloads.decode_column(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("payload")), "rle", "struct<tag:string,new:struct<data:binary>>")
    return found.select("o_orderkey", F.decode("value.new.data", "utf-8").alias("data"))


@query("select o_orderkey, list_transform(string_split(o_orderkey::varchar, ''), lambda c: c::bigint) as digits from orders")
def peano_numbers(spark, sf_dir):
    """The unary number format: a decode program over digits spelled as S..SZ."""
    spelled = F.regexp_replace(F.col("o_orderkey").cast("string"), "([0-9])", "$1,")
    raw = F.array_join(F.transform(F.filter(F.split(spelled, ","), lambda d: d != ""), lambda d: F.concat(F.repeat(F.lit("S"), d.cast("int")), F.lit("Z"))), "")
    found = payloads.decode_column(table(spark, sf_dir, "orders").select("o_orderkey", F.encode(raw, "utf-8").alias("payload")), "peano", "array<bigint>")
    return found.select("o_orderkey", F.col("value").alias("digits"))


@query("select user_id, event_id from (select user_id, event_id, coalesce(bool_or(event_type = 'error') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as after from events) where not after")
def window_until_error(spark, sf_dir):
    """A window frame: each user's events up to and with the first error."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.bool_or(F.col("event_type") == "error").over(before), F.lit(False)).alias("after"))
    return marked.filter(~F.col("after")).select("user_id", "event_id")


@query("select user_id, event_id, before as acc from (select user_id, event_id, coalesce(sum(event_id % 7) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from events) where before < 50")
def window_until_sum(spark, sf_dir):
    """A window frame: each user's events while a sum of those before is small."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.sum(F.col("event_id") % 7).over(before), F.lit(0)).alias("acc"))
    return summed.filter("acc < 50")


@query("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    """A lookup in a small table: a join that Spark broadcasts where the table is small."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("select o_orderkey, count(l_orderkey)::bigint as n_lines, coalesce(sum(l_quantity::bigint), 0)::bigint as quantity from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def dependent_join(spark, sf_dir):
    """A dependent join: for each order its lines; lines are summed before they meet the orders."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("q", F.lit(0)).alias("quantity"))


@query("select o_orderkey, left(repeat(right(o_orderkey::varchar, 2), 10), 12) as copied from orders where o_orderkey >= 10")
def lz77_inflate(spark, sf_dir):
    """SubSeqInflate: a copy that runs into what it makes."""
    digits = F.transform(F.regexp_extract_all(F.col("o_orderkey").cast("string"), F.lit("([0-9])"), 1), lambda d: d)
    frame = table(spark, sf_dir, "orders").filter("o_orderkey >= 10").select("o_orderkey", digits.alias("s"))
    tree = X.sub_seq_inflate(V("s"), X.seq_length(V("s")) - 2, 12)
    return frame.select("o_orderkey", F.array_join(X.column(tree, {}), "").alias("copied"))


@query("select o_orderkey, (o_orderkey * 3 + 7) % 1000 as m, o_orderkey // 7 as q, o_orderkey & 255 as a, o_orderkey | 15 as b, (o_orderkey << 2) as l, (o_orderkey >> 2) as r, o_orderkey + 1 as s, o_orderkey > 100 and o_orderkey < 5000 as inside from orders")
def arithmetic(spark, sf_dir):
    """Arith, IntRel, Unary, boolean operators."""
    k = V("o_orderkey")
    return select(table(spark, sf_dir, "orders"), "o_orderkey", m=(k * 3 + 7) % 1000, q=k // 7, a=k & 255, b=k | 15, l=k << 2, r=k >> 2, s=X.succ(k), inside=X.both(k.gt(100), k.lt(5000)))


@query("select o_orderkey, (case when o_orderkey % 256 >= 128 then o_orderkey % 256 - 256 else o_orderkey % 256 end)::bigint as i8, case when o_orderkey <= 65535 then o_orderkey end as fits from orders")
def numeric_casts(spark, sf_dir):
    """The numeric model: two's complement, and a check that a value fits its representation."""
    wrapped, fits = M.column(M.cast_bits(M.var("o_orderkey"), "i8"), {}), M.column(M.cast(M.var("o_orderkey"), "u16"), {})
    return table(spark, sf_dir, "orders").select("o_orderkey", wrapped.cast("bigint").alias("i8"), fits.cast("bigint").alias("fits"))


@query("select p_partkey, (p_size * 100000000000 - 5)::bigint as exact, -(p_size // 3)::bigint as negated, abs(-p_size)::bigint as size from part")
def numeric_auto(spark, sf_dir):
    """The numeric model: exact arithmetic whatever the width of its parts."""
    size = M.var("p_size")
    trees = {"exact": M.binary("sub", M.binary("mul", size, M.const(100_000_000_000)), M.const(5)), "negated": M.unary("neg", M.binary("div", size, M.const(3))), "size": M.unary("abs", M.unary("neg", size))}
    return table(spark, sf_dir, "part").select("p_partkey", *(M.column(t, {}).cast("bigint").alias(k) for k, t in trees.items()))


@query("select p_partkey, chr(64 + p_size::int) as c from part")
def as_char(spark, sf_dir):
    """AsChar: code points to characters."""
    return select(table(spark, sf_dir, "part"), "p_partkey", c=X.as_char(V("p_size") + 64))


def _made(frame: DataFrame, make: Callable[..., bytes], key: str, keyed: bool = False) -> DataFrame:
    """Payloads of a format, packed from texts (keyed: and their keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make((t or "").encode(), *([k] if keyed else [])) for k, t in rows], pa.binary())], [key, "payload"])

    return payloads.spread(frame).mapInArrow(run, f"{key} bigint, payload binary")


def decoded(packed: DataFrame, fmt: N.Format | str, schema: str) -> DataFrame:
    """Of payloads that `_made` has spread already."""
    return payloads.decode_column(packed, fmt, schema, even=False)


def _gzipped(raw: bytes) -> bytes:
    import gzip

    return gzip.compress(raw[: len(raw) // 2], 1, mtime=0) + gzip.compress(raw[len(raw) // 2 :], 9, mtime=0)


@query("select doc_id, 2::bigint as n_members, octet_length(encode(text))::bigint as n_bytes, sha256(text) as digest from documents")
def gzip_roundtrip(spark, sf_dir):
    """gzip members, inflated."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _gzipped, "doc_id")
    found = decoded(packed, "gzip", "array<struct<data:binary>>")
    whole = F.concat(F.col("value")[0]["data"], F.col("value")[1]["data"])
    return found.select("doc_id", F.size("value").cast("bigint").alias("n_members"), F.octet_length(whole).cast("bigint").alias("n_bytes"), F.sha2(whole, 256).alias("digest"))


def _blocked(raw: bytes) -> bytes:
    """A member of a stored, a fixed and a dynamic block, or as many of these as the text fills."""
    import struct
    import zlib

    third = -(-len(raw) // 3)
    out, parts = b"", [raw[:third][:65535], raw[third : 2 * third], raw[2 * third :]]
    parts[1] = raw[len(parts[0]) : 2 * third]
    out += b"\0" + struct.pack("<HH", len(parts[0]), 0xFFFF - len(parts[0])) + parts[0]
    press = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_FIXED)
    out += press.compress(parts[1]) + press.flush(zlib.Z_FULL_FLUSH)
    press = zlib.compressobj(9, zlib.DEFLATED, -15)
    out += press.compress(parts[2]) + press.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + out + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@query("select doc_id, sha256(coalesce(text, '')) as digest, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, 'stored' as first_block from documents")
def deflate_blocks(spark, sf_dir):
    """Deflate's own grammar: blocks of all kinds with their codes, on Bits, Dynamic, Apply and FlatMapList, written out as zlib would."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _blocked, "doc_id")
    found = decoded(packed, "gzip-blocks", "array<struct<data:struct<blocks:array<struct<data:struct<tag:string>>>,inflate:binary>>>")
    data = F.col("value")[0]["data"]
    return found.select("doc_id", F.sha2(data["inflate"], 256).alias("digest"), F.octet_length(data["inflate"]).cast("bigint").alias("n_bytes"), data["blocks"][0]["data"]["tag"].alias("first_block"))


def _tarred(raw: bytes) -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for k, part in enumerate((raw[:100], raw[100:])):
            info = tarfile.TarInfo(f"part{k}")
            info.size = len(part)
            t.addfile(info, io.BytesIO(part))
    return out.getvalue()


@query("select doc_id, k::bigint as k, 'part' || k as name, (case when k = 0 then least(octet_length(encode(text)), 100) else greatest(octet_length(encode(text)) - 100, 0) end)::bigint as size from documents, (values (0), (1)) as ks(k)")
def tar_listing(spark, sf_dir):
    """Members of tar archives as rows."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _tarred, "doc_id")
    found = decoded(packed, "tar", "struct<contents:array<struct<header:struct<name:string,size:bigint>>>>")
    rows = found.select("doc_id", F.posexplode("value.contents").alias("k", "e"))
    return rows.select("doc_id", F.col("k").cast("bigint").alias("k"), F.regexp_replace("e.header.name", "\x00+$", "").alias("name"), F.col("e.header.size").alias("size"))


def _riffed(raw: bytes) -> bytes:
    chunks = b"".join(t + len(d).to_bytes(4, "little") + d + b"\0" * (len(d) % 2) for t, d in ((b"head", raw[:7]), (b"body", raw[7:])))
    return b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"TEXT" + chunks


@query("select doc_id, tag, (case tag when 'head' then least(octet_length(encode(text)), 7) else greatest(octet_length(encode(text)) - 7, 0) end)::bigint as n from documents, (values ('head'), ('body')) as t(tag)")
def riff_chunks(spark, sf_dir):
    """Chunks of RIFF files as rows."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _riffed, "doc_id")
    found = decoded(packed, "riff", "struct<data:struct<chunks:array<struct<tag:string,length:bigint>>>>")
    return found.select("doc_id", F.explode("value.data.chunks").alias("c")).select("doc_id", "c.tag", F.col("c.length").alias("n"))


def _png(raw: bytes) -> bytes:
    import struct
    import zlib

    def chunk(tag: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + tag + data + zlib.crc32(tag + data).to_bytes(4, "big")

    texts = [chunk(b"tEXt", b"k\0" + raw[:5])] * (len(raw) % 3)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(raw), 1, 8, 0, 0, 0, 0)) + b"".join(texts) + chunk(b"IDAT", zlib.compress(b"\0" + raw)) + chunk(b"IEND", b"")


@query("select doc_id, octet_length(encode(text))::bigint as width, (octet_length(encode(text)) % 3)::bigint as n_text, (octet_length(encode(text)) + 1)::bigint as n_pixels from documents")
def png_chunks(spark, sf_dir):
    """PNG: header, chunk counts by tag, inflated pixels."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _png, "doc_id")
    found = decoded(packed, "png", "struct<ihdr:struct<data:struct<width:bigint>>,chunks:array<struct<tag:string>>,idat:struct<data:binary>>")
    return found.select("doc_id", F.col("value.ihdr.data.width").alias("width"), F.size(F.filter("value.chunks.tag", lambda t: t == "tEXt")).cast("bigint").alias("n_text"), F.octet_length("value.idat.data").cast("bigint").alias("n_pixels"))


def _font(raw: bytes) -> bytes:
    import struct

    svg = struct.pack(">HII", 0, 10, 0) + struct.pack(">H2H2I", 1, 3, 9, 14, len(raw)) + raw
    kern = struct.pack(">2H3H4H2Hh", 0, 1, 0, 20, 1, 1, 6, 0, 0, 1, 2, -(len(raw) % 1000))
    rows, at = b"", 12 + 2 * 16
    for tag, data in ((b"SVG ", svg), (b"kern", kern)):
        rows += tag + struct.pack(">3I", 0, at, len(data))
        at += len(data)
    return b"\0\1\0\0" + struct.pack(">4H", 2, 0, 0, 0) + rows + svg + kern


@query("select doc_id, sha256(coalesce(text, '')) as document, (-(octet_length(encode(coalesce(text, ''))) % 1000))::bigint as kerning from documents")
def opentype_tables(spark, sf_dir):
    """OpenType: a document captured at an offset from its table, and a kerning pair, found by tags in the directory."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _font, "doc_id")
    found = decoded(packed, "opentype", "struct<font:struct<svg:struct<documents:struct<items:array<struct<document:binary>>>>,kern:struct<subtables:struct<items:array<struct<data:struct<pairs:struct<pairs:array<struct<value:bigint>>>>>>>>>>")
    font = F.col("value.font")
    return found.select("doc_id", F.sha2(font["svg"]["documents"]["items"][0]["document"], 256).alias("document"), font["kern"]["subtables"]["items"][0]["data"]["pairs"]["pairs"][0]["value"].alias("kerning"))


def _font_of(raw: bytes, key: int) -> bytes:
    """A font with a head table, and by its key with lookups, device metrics or a table that nobody knows."""
    import struct

    x = key % 77
    head = struct.pack(">HHIIIHHqqhhhhHHhhh", 1, 0, 0x10000, 0, 0x5F0F3CF5, 0, key % 1000 + 16, 0, 0, x, -5, x + 100, 50, 0, 8, 2, 0, 0)
    lookup = lambda kind: struct.pack(">3H", kind, 0, 0)
    gsub = struct.pack(">2H3H", 1, 0, 0, 0, 10) + struct.pack(">3H", 2, 6, 12) + lookup(key % 7 + 1) + lookup(1)
    n = 2 + key % 2
    vdmx = struct.pack(">3H", 0, 2, n) + b"\1\1\1\1" * n + struct.pack(">H", 0) * n
    tables = {0: [(b"head", head), (b"GSUB", gsub), (b"zzzz", b"?")], 1: [(b"head", head), (b"VDMX", vdmx)], 2: [(b"head", head), (b"zzzz", b"?")]}[key % 3]
    rows, body, at = b"", b"", 12 + 16 * len(tables)
    for tag, data in tables:
        rows += tag + struct.pack(">3I", 0, at + len(body), len(data))
        body += data
    return b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0) + rows + body


def _elf_of(raw: bytes, key: int) -> bytes:
    """A 64-bit little-endian file of a null section and one that holds the text."""
    import struct

    sections = struct.pack("<IIQQQQIIQQ", *[0] * 10) + struct.pack("<IIQQQQIIQQ", 1, 1, 0, 0, 64, len(raw), 0, 0, 1, 0)
    return b"\x7fELF\2\1\1\0" + b"\0" * 8 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, key, 0, 64 + len(raw), 0, 64, 56, 0, 64, 2, 0) + raw + sections


def _film(raw: bytes) -> bytes:
    import struct

    def atom(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", 8 + len(data)) + tag + data

    out = atom(b"stts", struct.pack(">4I", 0, 1, len(raw), 512))
    for tag in (b"stbl", b"minf", b"mdia", b"trak", b"moov"):
        out = atom(tag, out)
    return atom(b"ftyp", b"isom\0\0\2\0mp41") + out + struct.pack(">I4sQ", 1, b"mdat", 16 + len(raw)) + raw


@query("select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_samples, octet_length(encode(coalesce(text, '')))::bigint as media_size from documents")
def mpeg4_atoms(spark, sf_dir):
    """ISO media: a sample table six atoms deep, and the size of the media data, which are skipped."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _film, "doc_id")
    deep = "table:struct<entries:array<struct<`sample-count`:bigint>>>"
    for tag in ("stts", "stbl", "minf", "mdia", "trak", "moov"):
        deep = f"atoms:array<struct<{'size:bigint,' if tag == 'moov' else ''}data:struct<{tag}:struct<{deep}>>>>"
    found = decoded(packed, "mpeg4", f"struct<{deep}>")
    at = F.col("value.atoms")[1]["data"]["moov"]
    for tag in ("trak", "mdia", "minf", "stbl", "stts"):
        at = at["atoms"][0]["data"][tag]
    return found.select("doc_id", at["table"]["entries"][0]["sample-count"].alias("n_samples"), F.col("value.atoms")[2]["size"].alias("media_size"))


@query("select case when octet_length(encode(text)) % 3 = 0 then 0 else 1 end::bigint as has_text, count(*)::bigint as n_files, sum(octet_length(encode(text)) % 3)::bigint as n_chunks from documents group by 1")
def chunk_pivot(spark, sf_dir):
    """Analytics over decoded chunks: files by whether they hold a text chunk, and how many chunks there are."""
    chunks = png_chunks(spark, sf_dir)
    return chunks.groupBy((F.col("n_text") > 0).cast("bigint").alias("has_text")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_text").alias("n_chunks"))


@query("select o_orderkey, o_orderkey as u64, -o_orderkey as i64, (o_orderkey % 256)::bigint as u8 from orders")
def numbers_decode(spark, sf_dir):
    """The tagged numbers format."""
    key = F.col("o_orderkey")
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    raw = F.unhex(F.concat(F.hex(F.lit("NUMS").cast("binary")), F.lit("06"), wide(key), F.lit("07"), wide(-key), F.lit("00"), F.lpad(F.hex(key % 256), 2, "0")))
    found = payloads.decode_column(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("payload")), "numbers", "struct<values:array<struct<u64:bigint,i64:bigint,u8:bigint>>>")
    v = F.col("value.values")
    return found.select("o_orderkey", v[0]["u64"].alias("u64"), v[1]["i64"].alias("i64"), v[2]["u8"].alias("u8"))


@query("select vec_id, 64::bigint as n, label::bigint as label from embeddings")
def read_array(spark, sf_dir):
    """ReadArray at a view: numbers of a fixed width, in place."""
    packed = F.concat(F.unhex(F.lit("0040")), F.unhex(F.repeat(F.lpad(F.hex(F.col("label") % 256), 4, "0"), 64)))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", packed.alias("payload"))
    fmt = C.record(("n", C.u16be), ("items", C.let_view("here", C.read_array("here", V("n"), "u16"))))
    found = payloads.decode_column(vectors, fmt, "struct<items:array<bigint>>")
    return found.select("vec_id", F.size("value.items").cast("bigint").alias("n"), F.array_max("value.items").alias("label"))


@query("select doc_id, case when n_chars % 4 = 0 then 'Overrun' end as kind, case when n_chars % 4 = 0 then 1::bigint end as at from documents")
def decode_errors(spark, sf_dir):
    """Errors beside values: a row that fails does not fail the job."""
    short = F.col("n_chars") % 4 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.when(short, "0A41").otherwise("0141")).alias("payload"))
    fmt = C.record(("n", C.u8), ("data", C.repeat_count(V("n"), C.ANY)))
    found = payloads.decode_column(docs, fmt, "struct<data:binary>")
    return found.select("doc_id", F.col("error.kind").alias("kind"), F.col("error.offset").alias("at"))


# Sequences


@query(f"select o_orderkey, list_sum(d)::bigint as total, list_reduce(d, lambda a, x: a * 10 + x)::bigint as number from {_DIGITS}")
def left_fold(spark, sf_dir):
    """LeftFold: a sum, and the number that the digits spell."""
    return select(digits(spark, sf_dir), "o_orderkey", total=X.left_fold(lambda a, x: a + x, 0, V("d")), number=X.left_fold(lambda a, x: a * 10 + x, 0, V("d")))


@query(f"select o_orderkey, flatten(list_transform(d, lambda x: [x, x % 3])) as flat from {_DIGITS}")
def flat_map(spark, sf_dir):
    """FlatMap: each element to a sequence, joined."""
    return select(digits(spark, sf_dir), "o_orderkey", flat=X.flat_map(lambda x: X.seq_of(x, x % 3), V("d")))


@query(f"select o_orderkey, flatten(list_transform(range(1, len(d) + 1), lambda i: [list_sum(d[1:i - 1]), list_sum(d[1:i])]))::bigint[] as sums from (select o_orderkey, list_concat([0], d) as e, d from {_DIGITS})".replace("list_sum(d[1:i - 1])", "list_sum(e[1:i])"))
def flat_map_accum(spark, sf_dir):
    """FlatMapAccum: the running sum before and after each element."""
    return select(digits(spark, sf_dir), "o_orderkey", sums=X.flat_map_accum(lambda acc, x: X.tuple_of(acc + x, X.seq_of(acc, acc + x)), 0, V("d")))


@query(f"select o_orderkey, list_sort(list_distinct(d)) as kinds from {_DIGITS}")
def flat_map_list(spark, sf_dir):
    """FlatMapList: each step sees what came out so far; here, digits not seen yet."""
    fresh = X.flat_map_list(lambda out, x: X.match(X.find_by_key(lambda y: y, x, out), (P.absent(), X.seq_of(x)), (P.wildcard(), X.sub_seq(X.seq_of(x), 0, 0))), V("d"))
    return select(digits(spark, sf_dir), "o_orderkey", kinds=fresh).select("o_orderkey", F.array_sort("kinds").alias("kinds"))


@query(f"select o_orderkey, list_filter(d, lambda x: x % 4 = 2)[1] as found from {_DIGITS}")
def find_by_key_unsorted(spark, sf_dir):
    """FindByKey: the first element with a key."""
    return select(digits(spark, sf_dir), "o_orderkey", found=X.find_by_key(lambda x: x % 4, 2, V("d")))


@query("select c_custkey, case when c_nationkey % 3 = 0 then c_nationkey::bigint end as found from customer")
def find_by_key_sorted(spark, sf_dir):
    """FindByKey in a sorted sequence, by halving in a decode program."""
    keys = X.lift([Int(k, "u8") for k in range(0, 25, 3)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", be("c_nationkey", 1).alias("payload"))
    fmt = C.record(("k", C.u8), ("found", C.compute(X.find_by_key(lambda x: x, V("k"), keys, is_sorted=True))))
    return payloads.decode_column(rows, fmt, "struct<found:bigint>").select("c_custkey", F.col("value.found").alias("found"))


@query(f"select o_orderkey, d[1:1] as part, d[1] as first_digit, list_concat(d, [0, len(d)]) as more, list_transform(range(d[1]), lambda i: 9::bigint) as copies, range(0, len(d))::bigint[] as numbers, len(d)::bigint as n from {_DIGITS}")
def sequence_operators(spark, sf_dir):
    """SubSeq, SeqIx, Append, Dup, EnumFromTo, SeqLength as columns."""
    d, n = V("d"), X.seq_length(V("d"))
    return select(digits(spark, sf_dir), "o_orderkey", part=X.sub_seq(d, 0, 1), first_digit=d.at(0), more=X.append(d, X.seq_of(0, n)), copies=X.dup(d.at(0), X.lift(0) + 9), numbers=X.enum_from_to(0, n), n=n).withColumn("copies", F.col("copies").cast("array<bigint>"))


@query("select o_orderkey, substr(s, 2, 3) as part, substr(s, 3, 1) as third, s || 'zz' as more, repeat(substr(s, 1, 1), 4) as copies from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') as s from orders)")
def sequence_program(spark, sf_dir):
    """SubSeq, SeqIx, Append, Dup over bytes in a decode program."""
    s = V("s")
    made = X.record_of(part=X.sub_seq(s, 1, 3), third=X.seq_of(s.at(2)), more=X.append(s, X.lift(b"zz")), copies=X.dup(4, s.at(0)))
    fmt = C.chain(C.repeat_count(8, C.ANY), "s", C.compute(made))
    found = payloads.decode_column(keys_as_text(spark, sf_dir), fmt, "struct<part:binary,third:binary,more:binary,copies:binary>")
    return found.select("o_orderkey", *(F.col(f"value.{c}").cast("string").alias(c) for c in ("part", "third", "more", "copies")))


# One node at a time, by decode programs


def keys_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits of each order's key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "utf-8").alias("payload"))


def keys_as_bytes(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", be("o_orderkey", n).alias("payload"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as q from lineitem where l_quantity::bigint between 10 and 20")
def where_require(spark, sf_dir):
    """Where, hard: a byte in a range, an error elsewhere."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", be(F.col("l_quantity").cast("bigint"), 1).alias("payload"))
    return payloads.decode_column(lines, C.where_between(C.u8, 10, 20), "bigint").filter("error is null").select("l_orderkey", "l_linenumber", "l_partkey", F.col("value").alias("q"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey else -1 end as value, case when o_orderkey % 3 = 0 then 4 else 0 end::bigint as place, case when o_orderkey % 3 <> 0 then 'BadWhere' end as warning from orders")
def permit_fallback(spark, sf_dir):
    """Permit: where the part fails, its fallback, a warning, and nothing consumed."""
    fmt = C.record(("value", C.permit(C.where(C.u32be, lambda x: (x % 3).eq(0)), -1)), ("place", N.Pos()))
    found = payloads.decode_column(keys_as_bytes(spark, sf_dir), fmt, "struct<value:bigint,place:bigint>")
    return found.select("o_orderkey", "value.value", "value.place", F.get("warnings", F.lit(0)).getField("kind").alias("warning"))


@query("select o_orderkey, case when o_orderkey % 7 <> 3 then o_orderkey end as value, case when o_orderkey % 7 = 3 then 'BadWhere' end as error from orders")
def enforce_expectation(spark, sf_dir):
    """Enforce: the part's first warning becomes an error."""
    found = payloads.decode_column(keys_as_bytes(spark, sf_dir), C.enforce(C.expect(C.u32be, lambda x: (x % 7).ne(3))), "bigint")
    return found.select("o_orderkey", "value", F.col("error.kind").alias("error"))


@query("select o_orderkey, case when o_orderstatus = 'F' then o_custkey::bigint end as customer, case when o_orderstatus = 'F' then 5 else 1 end::bigint as place from orders")
def maybe_field(spark, sf_dir):
    """Maybe: a field that is there where a test holds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.encode("o_orderstatus", "utf-8"), be("o_custkey", 4)).alias("payload"))
    fmt = C.record(("status", C.u8), ("customer", C.cond_maybe(V("status").eq(ord("F")), C.u32be)), ("place", N.Pos()))
    return payloads.decode_column(rows, fmt, "struct<customer:bigint,place:bigint>").select("o_orderkey", "value.customer", "value.place")


@query("select event_id, event_type as tag, case when event_type = 'click' then user_id::bigint end as click, case when event_type = 'error' then 'e' || event_id % 10 end as error from events")
def match_variant_tag(spark, sf_dir):
    """Variant and Union: a sum type, as a struct of the tag and one value."""
    kind, user = F.encode("event_type", "utf-8"), be("user_id", 4)
    last = F.when(F.col("event_type") == "error", F.encode(F.concat(F.lit("e"), (F.col("event_id") % 10).cast("string")), "utf-8")).otherwise(user)
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(kind, last).alias("payload"))
    names = {"click": C.u32be, "error": C.fixed_ascii(2), "purchase": C.u32be, "signup": C.u32be, "view": C.u32be}
    fmt = N.Union(tuple(N.Variant(k, C.monad_seq(C.is_bytes(k.encode()), f)) for k, f in names.items()))
    return payloads.decode_column(rows, fmt, "struct<tag:string,click:bigint,error:string>").select("event_id", "value.*")


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'pair' when 1 then 'char' when 2 then 'many' else 'none' end as kind, case o_orderkey % 4 when 0 then o_orderkey // 4 % 100 + 1 when 1 then 7 when 2 then 3 else 0 end::bigint as n from orders")
def pattern_program(spark, sf_dir):
    """Patterns over a tagged value, a tuple, a character, a range and a sequence, by Match and Destructure in a decode program."""
    n = X.cast("u8", (V("key") // 4) % 100)
    made = X.match(
        V("key") % 4,
        (P.integer(0, "u32"), X.tagged("pair", X.tuple_of(n, X.u8(1)))), (P.integer(1, "u32"), X.tagged("char", X.as_char(X.u8(65)))), (P.integer(2, "u32"), X.tagged("many", X.seq_of(1, 2, 3))), (P.between(3, None), X.tagged("none", X.none())),
    )
    number = X.match(
        V("made"),
        (P.variant("pair", P.tuple_of(P.binding("a"), P.binding("b"))), V("a") + V("b")), (P.variant("char", P.char("A")), X.lift(7)), (P.variant("many", P.seq(P.wildcard(), P.wildcard(), P.binding("c"))), V("c")), (P.variant("none", P.absent()), X.lift(0)),
    )
    twice = X.destructure(X.tuple_of(V("number"), X.lift(True)), P.tuple_of(P.binding("x"), P.boolean(True)), V("x"))
    fmt = C.record(("key", C.u32be), ("made", C.compute(made)), ("number", C.compute(number)), ("n", C.compute(twice)))
    found = payloads.decode_column(keys_as_bytes(spark, sf_dir), fmt, "struct<made:struct<tag:string>,n:bigint>")
    return found.select("o_orderkey", F.col("value.made.tag").alias("kind"), "value.n")


@query("select o_orderkey, (o_orderkey & 255)::bigint as low, ((o_orderkey >> 8) & 255)::bigint as high, (o_orderkey & 65535)::bigint as little, not (o_orderkey & 255) > 127 as small, (o_orderkey & 255) > 200 or (o_orderkey & 255) < 10 as either from orders")
def casts_and_booleans(spark, sf_dir):
    """U16Le, AsU8, AsU16, BoolNot and BoolOr in a decode program and as columns."""
    raw = F.unhex(F.concat(F.lpad(F.hex(F.col("o_orderkey").bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright("o_orderkey", 8).bitwiseAND(255)), 2, "0")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("payload"))
    x = V("little")
    fmt = C.record(("little", C.u16le), ("low", C.compute(X.cast("u8", x & 255))), ("high", C.compute(X.cast("u8", X.cast("u16", x >> 8)))), ("small", C.compute(X.negate(V("low").gt(127)))))
    found = payloads.decode_column(rows, fmt, "struct<low:bigint,high:bigint,little:bigint,small:boolean>").select("o_orderkey", "value.*")
    return select(found, "o_orderkey", "low", "high", "little", "small", either=X.either(V("low").gt(200), V("low").lt(10)))


@query("select p_partkey, case when starts_with(p_type, 'ECONOMY') then 'Unexpected' end as error, case when not starts_with(p_type, 'ECONOMY') then p_type end as value from part")
def excluding_peek_not(spark, sf_dir):
    """PeekNot: anything but a prefix."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_type", "utf-8").alias("payload"))
    found = payloads.decode_column(parts, C.excluding(C.is_bytes(b"ECONOMY"), C.ascii_string(C.opaque_bytes())), "string")
    return found.select("p_partkey", F.col("error.kind").alias("error"), "value")


@query("select doc_id, left(hex(encode(coalesce(text, ''))), 8) as head, least(octet_length(encode(coalesce(text, ''))), 16) + 2 as place, octet_length(encode(coalesce(text, ''))) + 2 as stop from documents")
def slice_skip_rest(spark, sf_dir):
    """Slice and SkipRemainder: the first bytes of a window, the rest of it skipped, and the place after it."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(be(F.least(F.octet_length(raw), F.lit(16)), 2), raw).alias("payload"))
    inner = C.chain(C.repeat_between(0, 4, C.ANY), "h", C.monad_seq(N.SkipRemainder(), C.compute(V("h"))))
    fmt = C.record(("n", C.u16be), ("head", C.slice_of(V("n"), inner)), ("place", N.Pos()), ("__rest", N.SkipRemainder()), ("stop", N.Pos()))
    return payloads.decode_column(docs, fmt, "struct<head:binary,place:bigint,stop:bigint>").select("doc_id", F.hex("value.head").alias("head"), "value.place", "value.stop")


@query("select doc_id, substr(hex(encode(text)), (2 * (doc_id % octet_length(encode(text))) + 1)::bigint, 10) as found, 4::bigint as place from documents where octet_length(encode(text)) > 0")
def offset_read(spark, sf_dir):
    """WithRelativeOffset: a read at a computed place, from which the cursor comes back."""
    raw = F.encode("text", "utf-8")
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0).select("doc_id", F.concat(be(F.col("doc_id") % F.octet_length(raw), 4), raw).alias("payload"))
    fmt = C.record(("at", C.u32be), ("found", C.with_relative_offset(4, V("at"), C.repeat_between(0, 5, C.ANY))), ("place", N.Pos()))
    return payloads.decode_column(docs, fmt, "struct<found:binary,place:bigint>").select("doc_id", F.hex("value.found").alias("found"), "value.place")


@query("select doc_id, case when contains(text, chr(10)) then octet_length(encode(split_part(text, chr(10), 1))) + 1 end as n, case when not contains(text, chr(10)) then 'Overbyte' end as error from documents")
def repeat_until_last(spark, sf_dir):
    """RepeatUntilLast: bytes up to and with the first line break."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    found = payloads.decode_column(docs, C.repeat_until_last(lambda x: x.eq(10), C.ANY), "binary")
    return found.select("doc_id", F.octet_length("value").cast("bigint").alias("n"), F.col("error.kind").alias("error"))


_PREFIX = "(select o_orderkey, s, list_transform(string_split(s, ''), lambda c: c::bigint) as d from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') || '99' as s from orders))"
_FIRST = "list_min(list_filter(range(0, 11), lambda i: coalesce(list_sum(d[1:i]), 0) >= {}))"


def _padded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys_as_text(spark, sf_dir).select("o_orderkey", F.concat("payload", F.lit("99").cast("binary")).alias("payload"))


@query(f"select o_orderkey, left(s, greatest({_FIRST.format(9)}, 1)::bigint) as found from {_PREFIX}")
def repeat_until_seq(spark, sf_dir):
    """RepeatUntilSeq: digits until their sum is 9 or more."""
    fmt = C.ascii_string(C.repeat_until_seq(lambda s: X.left_fold(lambda a, x: a + (x - 48), X.u8(0), s).gte(9), C.ANY))
    return payloads.decode_column(_padded_keys(spark, sf_dir), fmt, "string").select("o_orderkey", F.col("value").alias("found"))


@query(f"select o_orderkey, list_sum(d[1:k])::bigint as acc, k::bigint as n from (select o_orderkey, d, {_FIRST.format(10)} as k from {_PREFIX})")
def accum_until(spark, sf_dir):
    """AccumUntil: the accumulator is tested before each element."""
    fmt = C.accum_until(lambda acc, seq: acc.gte(10), lambda acc, x: acc + (x - 48), X.u8(0), C.ANY)
    found = payloads.decode_column(_padded_keys(spark, sf_dir), fmt, "struct<_0:bigint,_1:binary>")
    return found.select("o_orderkey", F.col("value._0").alias("acc"), F.octet_length("value._1").cast("bigint").alias("n"))


@query("select o_orderkey, [substr(s, 1, a), substr(s, a + 1, b)] as parts from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') as s, o_orderkey % 3 + 1 as a, o_orderkey % 5 + 1 as b from orders)")
def for_each(spark, sf_dir):
    """ForEach: a part for each of some sizes that came before."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(be(key % 3 + 1, 1), be(key % 5 + 1, 1), F.encode(F.lpad(key.cast("string"), 8, "0"), "utf-8")).alias("payload"))
    fmt = C.record(("sizes", C.repeat_count(2, C.u8)), ("parts", C.for_each(V("sizes"), "n", C.fixed_ascii(V("n")))))
    return payloads.decode_column(rows, fmt, "struct<parts:array<string>>").select("o_orderkey", "value.parts")


@query("select o_orderkey, list_transform(range(0, 8), lambda i: (((o_orderkey >> (2 * i)) & 1) * 2 + ((o_orderkey >> (2 * i + 1)) & 1))::bigint) as symbols from orders")
def dynamic_apply(spark, sf_dir):
    """Dynamic and Apply: a prefix code made of lengths that the payload gives, read from its bits."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.unhex(F.lit("02020202")), be(key.bitwiseAND(255), 1), be(F.shiftright(key, 8).bitwiseAND(255), 1)).alias("payload"))
    symbols = C.bits(N.Dynamic("code", V("lengths"), C.repeat_count(8, N.Apply("code"))))
    fmt = C.record(("lengths", C.repeat_count(4, C.u8)), ("symbols", symbols))
    return payloads.decode_column(rows, fmt, "struct<symbols:array<bigint>>").select("o_orderkey", "value.symbols")


@query("select o_orderkey, (o_orderkey >> 16)::bigint as high, (o_orderkey & 65535)::bigint as low, 2::bigint as place from orders")
def call_and_views(spark, sf_dir):
    """Call (its scope holds its arguments only), LetView, ReifyView, ParseFromView, Phantom."""
    half = N.Call("half", C.parse_from_view("v", C.u16be, V("n")), args=(("n", X.lift(2)),), views=(("v", "all"),))
    fmt = C.let_view("all", C.record(("high", C.u16be), ("place", C.let_view("now", C.reify_view("now"))), ("low", half), ("nothing", N.Phantom(C.u64be)), ("rest", C.u16be)))
    found = payloads.decode_column(keys_as_bytes(spark, sf_dir), fmt, "struct<high:bigint,low:bigint,place:bigint,nothing:bigint>")
    return found.filter("value.nothing is null").select("o_orderkey", "value.high", "value.low", "value.place")


@query("select o_orderkey, o_orderkey % 6 as depth, (o_orderkey % 9)::bigint as leaf, o_orderkey % 6 + 1 as width from orders")
def item_var(spark, sf_dir):
    """ItemVar: a module's format that calls itself with an argument; brackets around a digit, as many as there are."""
    key = F.col("o_orderkey")
    nested = F.concat(F.repeat(F.lit("("), (key % 6).cast("int")), (key % 9).cast("string"), F.repeat(F.lit(")"), (key % 6).cast("int")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(nested, "utf-8").alias("payload"))
    module = N.Module()
    leaf = C.map_format(C.byte_in(range(48, 58)), lambda b: X.record_of(depth=V("n"), leaf=b - 48))
    inner = C.chain(C.is_byte(40), "_open", C.chain(module.call("node", V("n") + 1), "_in", C.monad_seq(C.is_byte(41), C.compute(V("_in")))))
    module.define("node", C.union(leaf, inner), params=("n",))
    found = payloads.decode_column(rows, C.record(("node", module.call("node", 0)), ("__end", N.EndOfInput())), "struct<node:struct<depth:bigint,leaf:bigint>>")
    return found.select("o_orderkey", "value.node.depth", "value.node.leaf", (F.col("value.node.depth") + 1).alias("width"))


@query("select o_orderkey, case when o_orderkey % 2 = 1 then 'Fail' end as error, case when o_orderkey % 2 = 0 then o_orderkey end as value from orders")
def fail_branch(spark, sf_dir):
    """Fail, chosen by Match."""
    fmt = C.chain(C.u32be, "n", C.match(V("n") % 2, (P.integer(1), N.Fail()), (P.wildcard(), C.compute(V("n")))))
    return payloads.decode_column(keys_as_bytes(spark, sf_dir), fmt, "bigint").select("o_orderkey", F.col("error.kind").alias("error"), "value")


@query("select o_orderkey, (o_orderkey + 5)::bigint as plus, (-o_orderkey % 7)::bigint as rest, (o_orderkey + 1)::bigint as next, (o_orderkey - 1)::bigint as before from orders")
def numeric_program(spark, sf_dir):
    """The numeric model in a decode program: add, rem, succ, pred and negation."""
    n = M.var("n")
    trees = {"plus": M.binary("add", n, M.const(5)), "rest": M.binary("rem", M.unary("neg", n), M.const(7)), "next": M.unary("succ", n), "before": M.unary("pred", n)}
    fmt = C.record(("n", C.u32be), *((k, C.compute(X.number(t))) for k, t in trees.items()))
    return payloads.decode_column(keys_as_bytes(spark, sf_dir), fmt, "struct<plus:bigint,rest:bigint,next:bigint,before:bigint>").select("o_orderkey", "value.*")


_KINDS = ("text", "gzip", "tgz", "png", "riff", "numbers", "rle", "peano", "tar", "waldo", "gif", "elf", "mpeg4", "jpeg", "opentype")


@query("select doc_id, ([" + ", ".join(f"'{k}'" for k in _KINDS) + "])[doc_id % 15 + 1] as kind from documents")
def sniff_union_nondet(spark, sf_dir):
    """UnionNondet: every registered format, tried in order on files of fifteen kinds."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _of_any_kind, "doc_id", keyed=True)
    return decoded(packed, "sniff", "struct<data:struct<tag:string>>").select("doc_id", F.col("value.data.tag").alias("kind"))


def _of_any_kind(raw: bytes, key: int) -> bytes:
    import gzip
    import struct

    kind, some = _KINDS[key % 15], raw[:300]
    made = {
        "text": lambda: raw, "gzip": lambda: gzip.compress(raw, 1, mtime=0), "tgz": lambda: gzip.compress(_tarred(raw), 1, mtime=0), "png": lambda: _png(raw), "riff": lambda: _riffed(raw), "numbers": lambda: b"NUMS\0" + raw[:1].ljust(1, b"x"),
        "rle": lambda: bytes([1, 1 + len(raw) % 9, 65]), "peano": lambda: b"SSZ" * (1 + len(raw) % 5), "tar": lambda: _tarred(raw), "waldo": lambda: (9 + 7).to_bytes(8, "big") + b"\xff" * 7 + b"\0" + b"Waldo" + some, "gif": lambda: b"GIF89a\1\0\1\0\0\0\0!\xfe" + bytes([len(some[:99]) or 1]) + (some[:99] or b" ") + b"\0;",
        "elf": lambda: b"\x7fELF\2\1\1\0" + b"\0" * 8 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 0, 0, 64, 56, 0, 64, 0, 0), "mpeg4": lambda: _film(raw),
        "jpeg": lambda: b"\xff\xd8\xff\xfe" + (2 + len(some)).to_bytes(2, "big") + some + b"\xff\xda\0\2xy\xff\xd9", "opentype": lambda: _font(raw),
    }
    return made[kind]()


# Sinks


@query("""select o_orderkey, '{"values": [{"tag": "u32", "data": ' || o_orderkey || '}, {"tag": "u8", "data": ' || o_orderkey % 256 || '}]}' as json,
 ['values[0]/u32=' || o_orderkey, 'values[1]/u8=' || o_orderkey % 256] as leaves,
 'value' || chr(10) || '  values [2]' || chr(10) || '    0: {u32}' || chr(10) || '      u32: ' || o_orderkey || chr(10) || '    1: {u8}' || chr(10) || '      u8: ' || o_orderkey % 256 || chr(10) as tree from orders""")
def rendered(spark, sf_dir):
    """JSON, tree and flat list of decoded values, a column of each."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("NUMS").cast("binary"), F.unhex(F.lit("04")), be(key, 4), F.unhex(F.lit("00")), be(key % 256, 1)).alias("payload"))
    found = payloads.render_column(rows, "numbers", "json", "tree", "flat")
    return found.select("o_orderkey", "json", F.transform("flat", lambda x: F.concat(x["path"], F.lit("="), x["value"])).alias("leaves"), "tree")


@query("select o_orderkey, [0, 4]::bigint[] as starts, [4, 6]::bigint[] as stops from orders")
def located(spark, sf_dir):
    """Decoded values with the places that they were read from."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(be("o_orderkey", 4), F.unhex(F.lit("0102"))).alias("payload"))
    found = payloads.render_column(rows, C.record(("a", C.u32be), ("b", C.fixed_ascii(2))), "located")
    return found.select("o_orderkey", F.col("located.start").alias("starts"), F.col("located.stop").alias("stops"))


@query()
def census_ops(spark, sf_dir):
    """Which nodes each registered format uses."""
    return payloads.census(spark)


from . import analytics, relational  # noqa: E402, F401  they add their queries
