"""Analytics over decoded data: statistics of runs, pivots of chunks and lookups, listings of headers and tables, checks."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import helpers as H
from ..operators import combinators as C
from ..sources import payloads
from .catalog import _elf_of, _font_of, _made, _png, be, decoded, keys_as_text, query, table

V = X.var


def symbol(n: Column) -> Column:
    """How often something is there: - for never, 1 for once, * for more."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "-").when(n == 1, "1").otherwise("*")


def pivoted(rows: DataFrame, key: str, tag: str, tags: list[str], flag: str | None = None) -> DataFrame:
    """One row for each key: a symbol for each tag; with a flag (a boolean column), A where all rows of a tag have it, a where some do."""
    rows = rows.groupBy(key, tag).agg(F.count(F.lit(1)).alias("_n"), *([F.bool_and(flag).alias("_all"), F.bool_or(flag).alias("_any")] if flag else []))
    out = symbol(F.first("_n"))
    if flag:
        out = F.concat(out, F.when(F.first("_all"), "A").when(F.first("_any"), "a").otherwise(""))
    found = rows.groupBy(key).pivot(tag, tags).agg(out)
    return found.select(key, *(F.coalesce(F.col(f"`{t}`"), F.lit("-")).alias(t) for t in tags))


@query("select o_orderkey, 2::bigint as n_runs, least(o_orderkey % 9 + 1, o_orderkey % 3)::bigint as shortest, greatest(o_orderkey % 9 + 1, o_orderkey % 3)::bigint as longest, 500 // (o_orderkey % 9 + 1 + o_orderkey % 3) as percent from orders")
def rle_statistics(spark, sf_dir):
    """Runs of each run-length file: how many, the shortest and longest, and its size in percent of the data's."""
    key = F.col("o_orderkey")
    raw = F.concat(F.unhex(F.lit("00")), be(key % 9 + 1, 1), be(key % 5 + 65, 1), be(key % 3, 1), F.unhex(F.lit("7A")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("payload"), F.octet_length(raw).alias("size"))
    found = payloads.decode_column(rows, "rle", "struct<old:struct<runs:array<struct<len:bigint>>,data:binary>>")
    lengths = F.col("value.old.runs.len")
    return found.select("o_orderkey", F.size(lengths).cast("bigint").alias("n_runs"), F.array_min(lengths).alias("shortest"), F.array_max(lengths).alias("longest"), F.floor(F.col("size") * 100 / F.octet_length("value.old.data")).alias("percent"))


@query("select doc_id, case n % 3 when 0 then '-' when 1 then '1' else '*' end as \"tEXt\", '-' as \"zTXt\", '-' as \"gAMA\" from (select doc_id, octet_length(encode(coalesce(text, ''))) as n from documents) where n % 3 > 0")
def png_pivot(spark, sf_dir):
    """PNG files by the chunks that they hold: never, once, more."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _png, "doc_id")
    chunks = decoded(packed, "png", "struct<chunks:array<struct<tag:string>>>").select("doc_id", F.explode("value.chunks.tag").alias("tag"))
    return pivoted(chunks, "doc_id", "tag", ["tEXt", "zTXt", "gAMA"])


@query("select doc_id, case (doc_id % 4) when 0 then '1A' when 1 then '*A' when 2 then '*a' else '1' end as \"iTXt\" from documents")
def png_compressed(spark, sf_dir):
    """Compressed texts of PNG files: all, some or none of them."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", "text"), _png_texts, "doc_id", keyed=True)
    found = decoded(packed, "png", "struct<chunks:array<struct<tag:string,content:struct<iTXt:struct<`compression-flag`:bigint>>>>>")
    chunks = found.select("doc_id", F.explode("value.chunks").alias("c")).select("doc_id", "c.tag", (F.col("c.content.iTXt.compression-flag") == 1).alias("compressed"))
    return pivoted(chunks, "doc_id", "tag", ["iTXt"], "compressed")


def _png_texts(raw: bytes, key: int) -> bytes:
    import zlib

    def chunk(tag: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + tag + data + zlib.crc32(tag + data).to_bytes(4, "big")

    one = lambda packed: chunk(b"iTXt", b"k\0" + bytes([packed, 0]) + b"en\0k\0" + (zlib.compress(raw[:20]) if packed else raw[:20]))
    texts = {0: one(1), 1: one(1) + one(1), 2: one(1) + one(0), 3: one(0)}[key % 4]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + texts + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


@query("select doc_id, 62::bigint as machine, doc_id as entry, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as digest, 2::bigint as n_sections from documents")
def elf_dump(spark, sf_dir):
    """ELF headers as rows, and a section's contents by its offset."""
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _elf_of, "doc_id", keyed=True)
    found = decoded(packed, "elf", "struct<header:struct<machine:bigint,entry:bigint>,`section-headers`:array<struct<type:bigint,size:bigint>>,sections:array<binary>>")
    v = F.col("value")
    return found.select("doc_id", v["header"]["machine"].alias("machine"), v["header"]["entry"].alias("entry"), v["section-headers"][1]["size"].alias("size"), F.sha2(v["sections"][1], 256).alias("digest"), F.size(v["section-headers"]).cast("bigint").alias("n_sections"))


_TAGS = ("GSUB", "VDMX", "head", "zzzz")


@query("select t as tag, count(*)::bigint as n_fonts from (select unnest(case doc_id % 3 when 0 then ['GSUB', 'head', 'zzzz'] when 1 then ['head', 'VDMX'] else ['head', 'zzzz'] end) as t from documents) group by 1")
def font_tables(spark, sf_dir):
    """Fonts that have a table."""
    return _directory(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n_fonts"))


@query("select doc_id, 'zzzz' as tag from documents where doc_id % 3 <> 1")
def font_extra_tables(spark, sf_dir):
    """Tables that the font format does not know: an anti join with those that it does."""
    known = spark.createDataFrame([(t,) for t in ("head", "GSUB", "GPOS", "VDMX", "maxp", "name", "cmap")], "tag string")
    return _directory(spark, sf_dir).join(F.broadcast(known), "tag", "left_anti").select("doc_id", "tag")


@query("select min(doc_id) as first_id from documents where doc_id % 3 = 0")
def font_first_with(spark, sf_dir):
    """The first font with a table: an existence scan that needs one row of each task."""
    return _directory(spark, sf_dir).filter("tag = 'GSUB'").agg(F.min("doc_id").alias("first_id"))


def _fonts(spark, sf_dir: str, schema: str) -> DataFrame:
    packed = _made(table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("text")), _font_of, "doc_id", keyed=True)
    return decoded(packed, "opentype", f"struct<font:struct<{schema}>>").select("doc_id", "value.font.*", "error")


def _directory(spark, sf_dir: str) -> DataFrame:
    return _fonts(spark, sf_dir, "tables:array<struct<`table-id`:string>>").select("doc_id", F.explode("tables.table-id").alias("tag"))


@query("select doc_id, (doc_id % 1000 + 16)::bigint as units, (doc_id % 77)::bigint as x_min, (doc_id % 77 + 100)::bigint as x_max, (-5)::bigint as y_min, 50::bigint as y_max from documents")
def font_metrics(spark, sf_dir):
    """Metrics of each font's head table, its bounding box among them."""
    found = _fonts(spark, sf_dir, "head:struct<`units-per-em`:bigint,`x-min`:bigint,`y-min`:bigint,`x-max`:bigint,`y-max`:bigint>")
    head = F.col("head")
    return found.select("doc_id", head["units-per-em"].alias("units"), *(head[k.replace("_", "-")].alias(k) for k in ("x_min", "x_max", "y_min", "y_max")))


_LOOKUPS = "(select doc_id, unnest([doc_id % 7 + 1, 1]) as kind from documents where doc_id % 3 = 0)"


@query("select doc_id, " + ", ".join(f"bool_or(kind = {k}) as gsub{k}" for k in range(1, 9)) + f" from {_LOOKUPS} group by doc_id")
def lookup_pivot(spark, sf_dir):
    """Kinds of lookups in each font's GSUB."""
    found = _fonts(spark, sf_dir, "gsub:struct<lookups:struct<items:array<struct<type:bigint>>>>").select("doc_id", F.explode("gsub.lookups.items.type").alias("kind"))
    return found.groupBy("doc_id").agg(*(F.bool_or(F.col("kind") == k).alias(f"gsub{k}") for k in range(1, 9)))


@query("select doc_id, 2::bigint as recs, (2 + doc_id % 2)::bigint as ratios, doc_id % 2 = 0 as consistent from documents where doc_id % 3 = 1")
def vdmx_check(spark, sf_dir):
    """Whether the numbers of records and ratios agree, as the table should have it."""
    found = _fonts(spark, sf_dir, "vdmx:struct<`num-recs`:bigint,`num-ratios`:bigint>").filter("vdmx is not null")
    return found.select("doc_id", F.col("vdmx.num-recs").alias("recs"), F.col("vdmx.num-ratios").alias("ratios"), (F.col("vdmx.num-recs") == F.col("vdmx.num-ratios")).alias("consistent"))


def truncated(column: Column, most: int) -> Column:
    """An array as text, of a long one the ends and how many are between."""
    text = lambda c: F.array_join(c.cast("array<string>"), ", ")
    n, half = F.size(column), most // 2
    cut = F.concat(text(F.slice(column, 1, half)), F.lit(", .. skipping "), (n - 2 * half).cast("string"), F.lit(" .., "), text(F.slice(column, -half, half)))
    return F.concat(F.lit("["), F.when(n > most, cut).otherwise(text(column)), F.lit("]"))


@query("select o_orderkey, case when len(s) <= 4 then '[' || array_to_string(string_split(s, ''), ', ') || ']' else '[' || s[1] || ', ' || s[2] || ', .. skipping ' || (len(s) - 4) || ' .., ' || s[len(s) - 1] || ', ' || s[len(s)] || ']' end as shown from (select o_orderkey, o_orderkey::varchar as s from orders)")
def truncated_arrays(spark, sf_dir):
    """Long arrays by their ends."""
    d = F.regexp_extract_all(F.col("o_orderkey").cast("string"), F.lit("([0-9])"), 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", truncated(d, 4).alias("shown"))


def matrix(column: Column, width: Column) -> Column:
    """Rows of a flat array, row after row."""
    rows = (F.size(column) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(column, (i * width + 1).cast("int"), width.cast("int")))


def merged_by_index(*columns: Column) -> Column:
    """Arrays side by side, as long as the longest."""
    return F.arrays_zip(*columns)


@query("select o_orderkey, [[substr(s, 1, 1)::bigint, substr(s, 2, 1)::bigint, substr(s, 3, 1)::bigint, substr(s, 4, 1)::bigint], [substr(s, 5, 1)::bigint, substr(s, 6, 1)::bigint, substr(s, 7, 1)::bigint, substr(s, 8, 1)::bigint]] as rows, substr(s, 1, 1)::bigint as a, substr(s, 5, 1)::bigint as b from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') as s from orders)")
def matrices(spark, sf_dir):
    """A flat array as a row-major matrix, and two arrays merged by index."""
    d = F.transform(F.regexp_extract_all(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("([0-9])"), 1), lambda c: c.cast("bigint"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", matrix(d, F.lit(4)).alias("rows"))
    pair = merged_by_index(F.col("rows")[0].alias("a"), F.col("rows")[1].alias("b"))[0]
    return found.select("o_orderkey", "rows", pair["a"].alias("a"), pair["b"].alias("b"))


@query("select o_orderkey, list_max(d) as most, list_sum(d)::bigint as total, list_contains(d, 7) as seven, len(list_filter(d, lambda x: x > 4))::bigint as n_large, list_filter(d, lambda x: x > 4)[1] as first_large, len(list_distinct(d))::bigint as n_unique, 8::bigint as stop, d[3] as third from (select o_orderkey, list_transform(string_split(lpad(o_orderkey::varchar, 8, '0'), ''), lambda c: c::bigint) as d from orders)")
def helper_program(spark, sf_dir):
    """Extremes, sums, membership, filters, options and places in a decode program."""
    d = X.map_seq(lambda b: b - 48, V("d"))
    parts = {
        "most": H.maximum(V("n")), "total": H.total(V("n")), "seven": H.is_elem(X.u8(7), V("n")), "n_large": X.seq_length(H.filtered(lambda x: x.gt(4), V("n"))), "first_large": H.seq_to_option(H.filtered(lambda x: x.gt(4), V("n"))),
        "n_unique": X.seq_length(H.unique(V("n"))), "third": H.enumerated(V("n")).at(2)[1],
    }
    fmt = C.chain(H.with_pos(C.repeat_count(8, C.ANY)), "at", C.let("d", V("at")["value"], C.let("n", d, C.compute(X.record_of(stop=V("at")["stop"], **parts)))))
    schema = "struct<most:bigint,total:bigint,seven:boolean,n_large:bigint,first_large:bigint,n_unique:bigint,stop:bigint,third:bigint>"
    return payloads.decode_column(keys_as_text(spark, sf_dir), fmt, schema).select("o_orderkey", "value.*")


@query("select o_orderkey, substr(s, 1, 2) as a, substr(s, 3, 2) as second, left(s, 1) as again, case when o_orderkey % 2 = 0 then 'valid' else 'invalid' end as kind from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') as s from orders)")
def record_edits(spark, sf_dir):
    """Records with fields left out, renamed, put before others and merged; a second pass over the same bytes; a fallback."""
    two = C.record(("a", C.fixed_ascii(2)), ("b", C.fixed_ascii(2)), ("c", C.fixed_ascii(2)))
    edited = H.remap_field(H.subset_fields(two, "a", "b"), ("a", "b"), "b", "second", lambda x: x)
    first = C.record(("x", C.fixed_ascii(1)))
    both = H.two_pass("seen", first, H.merged(edited, C.record(("tail", C.fixed_ascii(1))), ("a", "second"), ("tail",)))
    even = C.where(C.u8, lambda b: (b % 2).eq(0))
    fmt = H.prepend_field("again", C.peek(C.fixed_ascii(1)), C.chain(both, "r", C.chain(H.binary_fallback(even), "k", C.compute(X.record_of(r=V("r"), k=V("k"))))), ("r", "k"))
    found = payloads.decode_column(keys_as_text(spark, sf_dir), fmt, "struct<again:string,r:struct<a:string,second:string>,k:struct<tag:string>>")
    return found.select("o_orderkey", "value.r.a", "value.r.second", "value.again", F.col("value.k.tag").alias("kind"))


@query()
def type_sizes(spark, sf_dir):
    """Least and largest sizes of the registered formats, as far as they are known without data."""
    from ..operators import formats

    rows = [(k, f.size().low, f.size().high) for k, f in sorted(formats.REGISTRY.items())]
    return spark.createDataFrame(rows, "format string, low bigint, high bigint")


__all__ = ["matrix", "merged_by_index", "pivoted", "symbol", "truncated"]
