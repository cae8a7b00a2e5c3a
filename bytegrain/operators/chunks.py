"""What the chunks, atoms and segments of images and films hold, as the public specifications of PNG, ISO base media files and JPEG say."""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from . import combinators as C
from . import format as N

V = X.var
u8, u16, u32, u64, i16, i32 = C.u8, C.u16be, C.u32be, C.u64be, C.i16be, C.i32be


def fields(f: N.Format, *names: str) -> list[tuple[str, N.Format]]:
    return [(name, f) for name in names]


def by_tag(tag: X.Expr, kinds: dict[bytes, N.Format]) -> N.Format:
    """The format of a four-byte tag; other tags leave their bytes as they are."""
    cases = tuple((P.byte_string(k), N.Variant(k.decode().strip(), f)) for k, f in kinds.items())
    return N.Match(tag, (*cases, (P.wildcard(), N.Variant("unknown", C.opaque_bytes()))))


def counted(f: N.Format, count: N.Format = u32) -> N.Format:
    return C.record(("count", count), ("entries", C.repeat_count(V("count"), f)))


# PNG


def png_content(color: X.Expr, zlib: N.Format) -> dict[bytes, N.Format]:
    """Chunks by tag. color: IHDR's colour type, which tRNS, sBIT and bKGD go by. Compressed texts that do not inflate stay bytes."""

    def by_color(what: str, ways: dict[tuple[int, ...], N.Format]) -> N.Format:
        cases = [(P.integer(n), N.Variant(f"color-type-{n}", f)) for kinds, f in ways.items() for n in kinds]
        return N.Match(color, (*cases, (P.wildcard(), N.Variant(f"no-{what}", C.opaque_bytes()))))

    rgb = C.record(*fields(u8, "r", "g", "b"))
    grey16, rgb16 = C.record(("greyscale", u16)), C.record(*fields(u16, "red", "green", "blue"))
    packed = N.UnionNondet((N.Variant("inflated", zlib), N.Variant("bytes", C.opaque_bytes())))
    plain = N.Variant("plain", C.opaque_bytes())
    sample = N.Match(V("sample-depth"), ((P.integer(8), C.record(*fields(u8, "red", "green", "blue", "alpha"), ("frequency", u16))), (P.wildcard(), C.record(*fields(u16, "red", "green", "blue", "alpha", "frequency")))))
    return {
        b"PLTE": N.Repeat(rgb, 1),
        b"tRNS": by_color("transparency", {(0,): grey16, (2,): rgb16, (3,): N.Repeat(u8)}),
        b"bKGD": by_color("background", {(0, 4): grey16, (2, 6): rgb16, (3,): C.record(("palette-index", u8))}),
        b"sBIT": by_color("bits", {(0,): C.record(*fields(u8, "greyscale")), (2, 3): C.record(*fields(u8, "red", "green", "blue")), (4,): C.record(*fields(u8, "greyscale", "alpha")), (6,): C.record(*fields(u8, "red", "green", "blue", "alpha"))}),
        b"cHRM": C.record(*fields(u32, "white-x", "white-y", "red-x", "red-y", "green-x", "green-y", "blue-x", "blue-y")),
        b"gAMA": C.record(("gamma", u32)),
        b"sRGB": C.record(("rendering-intent", u8)),
        b"pHYs": C.record(*fields(u32, "per-unit-x", "per-unit-y"), ("unit", u8)),
        b"tIME": C.record(("year", u16), *fields(u8, "month", "day", "hour", "minute", "second")),
        b"hIST": C.record(("frequencies", N.Repeat(u16))),
        b"sPLT": C.record(("name", C.asciiz()), ("sample-depth", u8), ("samples", N.RepeatWhile(sample))),
        b"iCCP": C.record(("name", C.asciiz()), ("compression-method", u8), ("profile", packed)),
        b"tEXt": C.record(("keyword", C.asciiz()), ("text", C.opaque_bytes())),
        b"zTXt": C.record(("keyword", C.asciiz()), ("compression-method", u8), ("text", packed)),
        b"iTXt": C.record(("keyword", C.asciiz()), *fields(u8, "compression-flag", "compression-method"), ("language", C.asciiz()), ("translated-keyword", C.asciiz()), ("text", N.Match(V("compression-flag"), ((P.integer(1), packed), (P.wildcard(), plain))))),
    }


# ISO base media


def full(*rest: tuple[str, N.Format]) -> N.Format:
    """An atom with a version and flags before its data."""
    return C.record(("version", u8), ("flags", C.repeat_count(3, u8)), *rest)


def atom(kinds: dict[bytes, N.Format]) -> N.Format:
    """Size (32 or 64 bits, less its own header), type, and the data by type."""
    size = N.Match(V("size-field"), ((P.integer(1), C.map_format(u64, lambda n: n - 16)), (P.wildcard(), C.compute(X.cast("u64", V("size-field") - 8)))))
    return C.record(("size-field", u32), ("type", C.fixed_ascii(4)), ("size", size), ("data", C.slice_of(V("size"), by_tag(V("type"), kinds))))


def atoms(kinds: dict[bytes, N.Format]) -> N.Format:
    return C.record(("atoms", N.Repeat(atom(kinds))))


def mpeg4() -> N.Format:
    """Atoms down to the sample tables of tracks and the items of HEIC files; media data are skipped."""
    wide = V("version").eq(1)
    time = N.Match(wide, ((P.boolean(True), u64), (P.boolean(False), C.map_format(u32, lambda n: X.cast("u64", n)))))
    times = [("creation-time", time), ("modification-time", time)]
    matrix = ("matrix", C.repeat_count(9, i32))
    ftyp = C.record(("major-brand", C.fixed_ascii(4)), ("minor-version", u32), ("compatible-brands", N.Repeat(C.fixed_ascii(4))))
    hdlr = full(("predefined", u32), ("handler-type", C.fixed_ascii(4)), ("__reserved", C.repeat_count(3, u32)), ("name", C.opaque_bytes()))
    pair = lambda a, b: full(("table", counted(C.record(*fields(u32, a, b)))))
    entry = C.record(("size", u32), ("format", C.fixed_ascii(4)), ("data", C.slice_of(V("size") - 8, C.opaque_bytes())))
    sizes = N.Match(V("sample-size"), ((P.integer(0), C.repeat_count(V("count"), u32)), (P.wildcard(), C.repeat_count(0, u32))))
    described = C.record(("length", C.present_else(X.both(V("version").eq(1), V("default-length").eq(0)), u32, C.compute(V("default-length")))), ("data", C.slice_of(V("length"), C.opaque_bytes())))
    stbl = atoms({
        b"stsd": full(("table", counted(entry))), b"stts": pair("sample-count", "sample-delta"), b"ctts": pair("sample-count", "sample-offset"), b"stss": full(("table", counted(u32))),
        b"stsc": full(("table", counted(C.record(*fields(u32, "first-chunk", "samples-per-chunk", "description"))))), b"stsz": full(("sample-size", u32), ("count", u32), ("sizes", sizes)), b"stco": full(("table", counted(u32))), b"co64": full(("table", counted(u64))),
        b"sgpd": full(("grouping-type", C.fixed_ascii(4)), ("default-length", u32), ("table", counted(described))), b"sbgp": full(("grouping-type", C.fixed_ascii(4)), ("parameter", C.cond_maybe(wide, u32)), ("table", counted(C.record(*fields(u32, "sample-count", "group"))))),
    })
    dref = full(("table", counted(C.record(("size", u32), ("type", C.fixed_ascii(4)), ("data", C.slice_of(V("size") - 8, C.opaque_bytes()))))))
    minf = atoms({b"vmhd": full(("graphics-mode", u16), ("color", C.repeat_count(3, u16))), b"smhd": full(("balance", i16), ("__reserved", u16)), b"dinf": atoms({b"dref": dref}), b"stbl": stbl})
    mdia = atoms({b"hdlr": hdlr, b"mdhd": full(*times, ("timescale", u32), ("duration", time), ("language", u16), ("predefined", u16)), b"minf": minf})
    span = C.record(("segment-duration", time), ("media-time", time), ("rate", i16), ("rate-fraction", i16))
    tkhd = full(*times, ("track-id", u32), ("__reserved", u32), ("duration", time), ("__more", C.repeat_count(2, u32)), *fields(i16, "layer", "alternate-group", "volume"), ("__last", u16), matrix, ("width", u32), ("height", u32))
    trak = atoms({b"tkhd": tkhd, b"edts": atoms({b"elst": full(("table", counted(span)))}), b"mdia": mdia})
    mvhd = full(*times, ("timescale", u32), ("duration", time), ("rate", u32), ("volume", u16), ("__reserved", C.repeat_count(10, u8)), matrix, ("predefined", C.repeat_count(6, u32)), ("next-track-id", u32))
    infe = full(("item-id", N.Match(V("version"), ((P.integer(3), u32), (P.wildcard(), C.map_format(u16, lambda n: X.cast("u32", n)))))), ("protection", u16), ("item-type", C.cond_maybe(V("version").gte(2), C.fixed_ascii(4))), ("name", C.asciiz()), ("rest", C.opaque_bytes()))
    small = N.Match(V("version"), ((P.integer(0), C.map_format(u16, lambda n: X.cast("u32", n))), (P.wildcard(), u32)))
    meta = full(("atoms", N.Repeat(atom({b"hdlr": hdlr, b"dinf": atoms({b"dref": dref}), b"pitm": full(("item-id", small)), b"iinf": full(("count", small), ("items", N.Repeat(atom({b"infe": infe})))), b"idat": C.opaque_bytes()}))))
    free = N.SkipRemainder()
    top = {b"ftyp": ftyp, b"free": free, b"skip": free, b"mdat": free, b"meta": meta, b"moov": atoms({b"mvhd": mvhd, b"trak": trak, b"udta": atoms({b"meta": meta})})}
    return C.record(("__first", C.peek(N.Tuple((C.repeat_count(4, C.ANY), C.is_bytes(b"ftyp"))))), ("atoms", N.RepeatWhile(atom(top))))


# JPEG


def jpeg_content(tiff: N.Format) -> N.Format:
    """A segment's data by its marker."""

    def nibbles(high: str, low: str) -> N.Format:
        return C.bit_fields(u8, "u8", (high, 4), (low, 4))

    table = C.record(("precision-id", nibbles("precision", "table-id")), ("elements", N.Match(V("precision-id")["precision"], ((P.integer(0), N.Variant("bytes", C.repeat_count(64, u8))), (P.wildcard(), N.Variant("shorts", C.repeat_count(64, u16)))))))
    huffman = C.record(("class-id", nibbles("class", "table-id")), ("counts", C.repeat_count(16, u8)), ("values", C.for_each(V("counts"), "_n", C.repeat_count(V("_n"), u8))))
    component = C.record(("id", u8), ("sampling", nibbles("horizontal", "vertical")), ("quantization-table", u8))
    frame = C.record(("precision", u8), ("lines", u16), ("samples-per-line", u16), ("components", counted(component, u8)))
    jfif = C.record(("__id", C.is_bytes(b"JFIF\0")), *fields(u8, "major", "minor", "units"), *fields(u16, "density-x", "density-y"), *fields(u8, "thumbnail-width", "thumbnail-height"), ("thumbnail", C.opaque_bytes()))
    exif = C.record(("__id", C.is_bytes(b"Exif\0")), ("__pad", C.ANY), ("exif", C.chain(C.opaque_bytes(), "_raw", C.decode_bytes(V("_raw"), C.chain(tiff, "_t", C.monad_seq(N.SkipRemainder(), C.compute(V("_t"))))))))
    xmp = C.record(("__id", C.is_bytes(b"http://ns.adobe.com/xap/1.0/\0")), ("xmp", C.opaque_bytes()))
    other = N.Variant("other", C.opaque_bytes())
    cases = [
        (P.integer(0xDB), N.Variant("dqt", N.Repeat(table, 1))), (P.integer(0xC4), N.Variant("dht", N.Repeat(huffman, 1))), (P.integer(0xCC), N.Variant("dac", N.Repeat(C.record(("class-id", nibbles("class", "table-id")), ("value", u8)), 1))), (P.integer(0xDD), N.Variant("dri", u16)), (P.integer(0xDC), N.Variant("dnl", u16)),
        (P.integer(0xFE), N.Variant("com", C.opaque_bytes())), (P.integer(0xE0), N.UnionNondet((N.Variant("jfif", jfif), other))), (P.integer(0xE1), N.UnionNondet((N.Variant("exif", exif), N.Variant("xmp", xmp), other))), (P.between(0xC0, 0xCF), N.Variant("sof", frame)),
    ]
    return N.Match(V("marker"), (*cases, (P.wildcard(), other)))


def jpeg_scan() -> N.Format:
    tables = C.bit_fields(u8, "u8", ("dc-table", 4), ("ac-table", 4))
    return C.record(("components", counted(C.record(("id", u8), ("tables", tables)), u8)), *fields(u8, "spectral-start", "spectral-end"), ("approximation", C.bit_fields(u8, "u8", ("high", 4), ("low", 4))))
