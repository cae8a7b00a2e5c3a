"""Bundled formats, a registry of them by name, and sniffing."""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from . import combinators as C
from . import format as N
from .chunks import by_tag, jpeg_content, jpeg_scan, mpeg4, png_content
from .deflate import deflate
from .opentype import opentype

V = X.var


def text(allow_nul: bool = True) -> N.Format:
    """UTF-8 in the well-formed ranges of RFC 3629, as characters."""
    tail = C.byte_in(range(0x80, 0xC0))

    def wide(first: range, bits: int, *rest: N.Format) -> N.Format:
        return C.map_format(N.Tuple((C.byte_in(first), *rest)), lambda t: X.as_char(_code(t, bits, len(rest))))

    one = C.map_format(C.byte_in(range(0 if allow_nul else 1, 0x80)), X.as_char)
    ways = [one, wide(range(0xC2, 0xE0), 5, tail)]
    #: Fixed: first bytes and the range of the second where it is narrower than 80 to BF.
    for first, second in ((range(0xE0, 0xE1), range(0xA0, 0xC0)), (range(0xE1, 0xED), None), (range(0xED, 0xEE), range(0x80, 0xA0)), (range(0xEE, 0xF0), None)):
        ways.append(wide(first, 4, C.byte_in(second) if second else tail, tail))
    for first, second in ((range(0xF0, 0xF1), range(0x90, 0xC0)), (range(0xF1, 0xF4), None), (range(0xF4, 0xF5), range(0x80, 0x90))):
        ways.append(wide(first, 3, C.byte_in(second) if second else tail, tail, tail))
    return N.Hint("text", N.Repeat(N.Union(tuple(ways))))


def _code(t: X.Expr, bits: int, n: int) -> X.Expr:
    out = X.cast("u32", t[0] & ((1 << bits) - 1))
    for k in range(1, n + 1):
        out = (out << 6) | X.cast("u32", t[k] & 0x3F)
    return out


def run_length() -> N.Format:
    """A style byte, then pairs of length and byte; the data are the expansion. The old style keeps the runs."""
    pair = C.record(("len", C.u8), ("char", C.u8), ("buf", C.repeat_count(V("len"), N.Compute(V("char")))))
    runs = N.Repeat(pair)
    old = C.record(("__style", C.is_byte(0)), ("runs", runs), ("data", C.compute(X.flat_map(lambda r: r["buf"], V("runs")))))
    new = C.record(("__style", C.is_byte(1)), ("_runs", runs), ("data", C.compute(X.flat_map(lambda r: r["buf"], V("_runs")))))
    return C.alts(old=old, new=new)


def peano() -> N.Format:
    """Numbers 0 to 9, each as so many S and a Z."""
    digit = C.map_format(N.Tuple((C.repeat_between(0, 9, C.is_byte(0x53)), C.is_byte(0x5A))), lambda t: X.seq_length(t[0]))
    return C.repeat1(digit)


#: Fixed: kinds of numbers by their tags 0 to 7.
NUMBER_TAGS = ("u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64")


def numbers() -> N.Format:
    each = N.Union(tuple(N.Variant(k, C.monad_seq(C.is_byte(i), C.number(k))) for i, k in enumerate(NUMBER_TAGS)))
    return C.record(("__magic", C.is_bytes(b"NUMS")), ("values", N.Repeat(each)))


def waldo() -> N.Format:
    """Where a word is, noise, a zero, and the word itself, read where it is."""
    body = C.record(("where", C.u64be), ("noise", N.Repeat(C.is_byte(0xFF))), ("__zero", C.is_byte(0)), ("waldo", C.capture_bytes("start", 5, V("where"))), ("__rest", N.SkipRemainder()))
    return C.let_view("start", body)


def riff() -> N.Format:
    def chunk(data: N.Format) -> N.Format:
        return C.record(("tag", C.fixed_ascii(4)), ("length", C.u32le), ("data", C.slice_of(V("length"), data)), ("pad", C.cond_maybe((V("length") % 2).eq(1), C.is_byte(0))))

    inner = C.record(("tag", C.fixed_ascii(4)), ("chunks", N.Repeat(chunk(C.opaque_bytes()))))
    return C.record(("tag", C.tag(b"RIFF")), ("length", C.u32le), ("data", C.slice_of(V("length"), inner)), ("pad", C.cond_maybe((V("length") % 2).eq(1), C.is_byte(0))))


#: Fixed: the fields of a tar header and their sizes.
TAR_FIELDS = (("name", 100), ("mode", 8), ("uid", 8), ("gid", 8), ("size", 12), ("mtime", 12), ("chksum", 8), ("typeflag", 1), ("linkname", 100), ("magic", 6), ("version", 2), ("uname", 32), ("gname", 32), ("devmajor", 8), ("devminor", 8), ("prefix", 155), ("_pad", 12))


def tar() -> N.Format:
    octal = C.map_format(
        N.Tuple((C.repeat_count(11, C.byte_in(range(0x30, 0x38))), C.byte_in([0, 0x20]))),
        lambda t: X.left_fold(lambda n, d: n * 8 + X.cast("u64", d - 0x30), X.u64(0), t[0]),
    )
    fields = []
    for name, n in TAR_FIELDS:
        f: N.Format = octal if name == "size" else C.tag(b"ustar\0") if name == "magic" else C.fixed_ascii(n)
        fields.append((name, f))
    header = C.record(*fields)
    entry = C.record(("header", header), ("file", C.repeat_count(V("header")["size"], C.ANY)), ("__align", N.Align(512)))
    contents = C.where(N.RepeatWhile(C.excluding(C.is_byte(0), entry)), lambda s: X.seq_length(s).gte(1))
    return C.record(("contents", contents), ("__end", C.repeat_count(1024, C.is_byte(0))), ("__rest", N.Repeat(C.is_byte(0))))


def gzip(part: N.Format | None = None, blocks: bool = False) -> N.Format:
    """Members; with a part, each member's data are decoded by it; blocks: the streams are shown block by block."""
    flags = C.bit_fields(C.u8, "u8", (None, 3), ("fcomment", 1), ("fname", 1), ("fextra", 1), ("fhcrc", 1), ("ftext", 1))
    header = C.record(("__magic", C.is_bytes(b"\x1f\x8b")), ("method", C.u8), ("flags", flags), ("timestamp", C.u32le), ("compression-flags", C.u8), ("os-id", C.u8))
    flag = V("header")["flags"]
    extra = C.record(("xlen", C.u16le), ("subfields", C.slice_of(V("xlen"), C.opaque_bytes())))
    fields = [
        ("header", header), ("fextra", C.cond_maybe(flag["fextra"], extra)), ("fname", C.cond_maybe(flag["fname"], C.asciiz())), ("fcomment", C.cond_maybe(flag["fcomment"], C.asciiz())),
        ("fhcrc", C.cond_maybe(flag["fhcrc"], C.u16le)), ("data", deflate() if blocks else N.Inflate()), ("footer", C.record(("crc", C.u32le), ("length", C.u32le))),
    ]
    if part is not None:
        fields.append(("content", C.decode_bytes(V("data"), part)))
    return C.repeat1(C.record(*fields))


def zlib_stream() -> N.Format:
    method = C.where(C.bit_fields(C.u8, "u8", ("compression-info", 4), ("compression-method", 4)), lambda r: r["compression-method"].eq(8))
    flags = C.bit_fields(C.u8, "u8", ("flevel", 2), ("fdict", 1), ("fcheck", 5))
    return C.record(("compression-method-info", method), ("flags", flags), ("dict-id", C.cond_maybe(V("flags")["fdict"], C.u32be)), ("data", N.Inflate()), ("adler32", C.u32be))


def png() -> N.Format:
    """Signature, IHDR, chunks in order, the IDAT payloads joined and inflated. Checksums are read, not verified."""
    ihdr = C.record(("width", C.u32be), ("height", C.u32be), ("bit-depth", C.u8), ("color-type", C.u8), ("compression-method", C.u8), ("filter-method", C.u8), ("interlace-method", C.u8))
    length = C.where(C.u32be, lambda n: n.lt(1 << 31))

    def chunk(name: N.Format, data: N.Format) -> N.Format:
        return C.record(("length", length), ("tag", name), ("data", C.slice_of(V("length"), data)), ("crc", C.u32be))

    def tagged(*tags: bytes) -> N.Format:
        return C.peek_not(N.Tuple((C.repeat_count(4, C.ANY), N.UnionNondet(tuple(map(C.is_bytes, tags))))))

    content = C.peek(C.slice_of(V("length"), by_tag(V("tag"), png_content(V("ihdr")["data"]["color-type"], zlib_stream()))))
    known = C.record(("length", length), ("tag", C.fixed_ascii(4)), ("content", content), ("data", C.slice_of(V("length"), C.opaque_bytes())), ("crc", C.u32be))
    other = C.monad_seq(tagged(b"IDAT", b"IEND"), known)
    idat = chunk(C.tag(b"IDAT"), C.opaque_bytes())
    many = lambda f: N.RepeatWhile(f)
    return C.record(
        ("__signature", C.is_bytes(b"\x89PNG\r\n\x1a\n")), ("ihdr", chunk(C.tag(b"IHDR"), ihdr)), ("chunks", many(other)), ("_idat", many(idat)),
        ("idat", C.decode_bytes(X.flat_map(lambda c: c["data"], V("_idat")), zlib_stream())), ("more-chunks", many(other)), ("iend", chunk(C.tag(b"IEND"), N.EndOfInput())),
    )


def gif() -> N.Format:
    """Header, logical screen and colour table; the blocks up to the trailer by their sub-blocks."""
    table = C.repeat_count(X.u16(2) << V("flags")["table-size"], C.record(("r", C.u8), ("g", C.u8), ("b", C.u8)))
    flags = C.bit_fields(C.u8, "u8", ("table-flag", 1), ("color-resolution", 3), ("sort-flag", 1), ("table-size", 3))
    screen = C.record(("screen-width", C.u16le), ("screen-height", C.u16le), ("flags", flags), ("bg-color-index", C.u8), ("pixel-aspect-ratio", C.u8), ("global-color-table", C.cond_maybe(V("flags")["table-flag"], table)))
    sub = C.record(("len", C.byte_in(range(1, 256))), ("data", C.repeat_count(V("len"), C.ANY)))
    subs = C.chain(N.Repeat(sub), "s", C.monad_seq(C.is_byte(0), C.compute(V("s"))))
    extension = C.record(("__intro", C.is_byte(0x21)), ("label", C.u8), ("subblocks", subs))
    local = C.bit_fields(C.u8, "u8", ("table-flag", 1), ("interlace-flag", 1), ("sort-flag", 1), (None, 2), ("table-size", 3))
    image = C.record(
        ("__intro", C.is_byte(0x2C)), ("left", C.u16le), ("top", C.u16le), ("width", C.u16le), ("height", C.u16le), ("flags", local), ("local-color-table", C.cond_maybe(V("flags")["table-flag"], table)), ("min-code-size", C.u8), ("subblocks", subs),
    )
    header = C.record(("signature", C.tag(b"GIF")), ("version", N.Union((C.tag(b"87a"), C.tag(b"89a")))))
    return C.record(("header", header), ("logical-screen", screen), ("blocks", N.Repeat(C.alts(extension=extension, image=image))), ("trailer", C.is_byte(0x3B)))


def tiff() -> N.Format:
    """Byte order, then the directory at its offset."""

    def body(order: str, mark: bytes) -> N.Format:
        u16, u32 = C.number("u16", order), C.number("u32", order)
        entry = C.record(("tag", u16), ("type", u16), ("length", u32), ("offset-or-data", u32))
        ifd = C.record(("num-fields", u16), ("fields", C.repeat_count(V("num-fields"), entry)), ("next-ifd-offset", u32))
        return C.record(("byte-order", C.tag(mark)), ("__magic", C.where(u16, lambda x: x.eq(42))), ("offset", u32), ("ifd", C.with_relative_offset(0, V("offset"), ifd)))

    return C.alts(le=body("little", b"II"), be=body("big", b"MM"))


def elf() -> N.Format:
    """Identification and header of either class and byte order, then the program and section headers at their offsets, and each section's contents."""

    def body(order: str, wide: bool) -> N.Format:
        half, word, addr = C.number("u16", order), C.number("u32", order), C.number("u64" if wide else "u32", order)
        ident = C.record(("__magic", C.is_bytes(b"\x7fELF")), ("class", C.is_byte(2 if wide else 1)), ("data", C.is_byte(1 if order == "little" else 2)), ("version", C.is_byte(1)), ("os-abi", C.u8), ("abi-version", C.u8), ("__pad", C.repeat_count(7, C.ANY)))
        header = [("ident", ident), ("type", half), ("machine", half), ("version", word), ("entry", addr), ("phoff", addr), ("shoff", addr), ("flags", word), *((k, half) for k in ("ehsize", "phentsize", "phnum", "shentsize", "shnum", "shstrndx"))]
        ph = [("type", word), ("flags", word), *((k, addr) for k in ("offset", "vaddr", "paddr", "filesz", "memsz", "align"))] if wide else [("type", word), *((k, addr) for k in ("offset", "vaddr", "paddr", "filesz", "memsz")), ("flags", word), ("align", addr)]
        sh = [("name", word), ("type", word), ("flags", addr), ("addr", addr), ("offset", addr), ("size", addr), ("link", word), ("info", word), ("addralign", addr), ("entsize", addr)]
        h, s = V("header"), V("_h")
        held = N.LiftedOption(C.with_relative_offset(0, s["offset"], C.slice_of(s["size"], C.opaque_bytes())))
        # sections without contents in the file: those of type 0 and 8
        contents = N.Match(X.either(s["type"].eq(0), s["type"].eq(8)), ((P.boolean(True), N.LiftedOption(None)), (P.boolean(False), held)))
        return C.record(
            ("header", C.record(*header)),
            ("program-headers", C.cond_maybe(h["phoff"].ne(0), C.with_relative_offset(0, h["phoff"], C.repeat_count(h["phnum"], C.record(*ph))))),
            ("section-headers", C.cond_maybe(h["shoff"].ne(0), C.with_relative_offset(0, h["shoff"], C.repeat_count(h["shnum"], C.record(*sh))))),
            ("sections", N.Match(V("section-headers"), ((P.absent(), C.compute(X.seq_of())), (P.present(P.binding("_headers")), C.for_each(V("_headers"), "_h", contents))))),
            ("__rest", N.SkipRemainder()),
        )

    return N.UnionNondet(tuple(body(o, w) for w in (False, True) for o in ("little", "big")))


def jpeg() -> N.Format:
    """SOI, segments with their lengths, then scans with stuffing removed, EOI."""
    segment = C.record(
        ("__ff", C.is_byte(0xFF)), ("marker", N.Byte(~C.ByteSet.of([0x00, 0xD8, 0xD9, 0xDA, 0xFF, *range(0xD0, 0xD8)]))), ("length", C.where(C.u16be, lambda n: n.gte(2))), ("content", C.peek(C.slice_of(V("length") - 2, jpeg_content(tiff())))),
        ("data", C.slice_of(V("length") - 2, C.opaque_bytes())),
    )
    raw = N.Union((C.map_format(C.not_byte(0xFF), lambda b: X.seq_of(b)), C.map_format(C.is_bytes(b"\xff\x00"), lambda s: X.seq_of(s.at(0))), C.map_format(N.Tuple((C.is_byte(0xFF), C.byte_in(range(0xD0, 0xD8)))), lambda t: X.enum_from_to(0, 0))))
    scan = C.record(("segments", N.Repeat(segment)), ("__ff", C.is_bytes(b"\xff\xda")), ("length", C.u16be), ("header", C.slice_of(V("length") - 2, N.UnionNondet((N.Variant("scan", jpeg_scan()), N.Variant("opaque", C.opaque_bytes()))))), ("data", C.map_format(N.Repeat(raw), lambda s: X.flat_map(lambda x: x, s))))
    return C.record(("__soi", C.is_bytes(b"\xff\xd8")), ("scans", N.RepeatWhile(scan)), ("__eoi", C.is_bytes(b"\xff\xd9")))


REGISTRY: dict[str, N.Format] = {
    "waldo": waldo(), "peano": peano(), "gif": gif(), "tgz": gzip(tar()), "gzip": gzip(), "jpeg": jpeg(), "mpeg4": mpeg4(), "png": png(), "riff": riff(), "tiff": tiff(), "tar": tar(), "elf": elf(),
    "opentype": opentype(), "numbers": numbers(), "rle": run_length(), "text": text(), "zlib": zlib_stream(), "deflate": deflate(), "gzip-blocks": gzip(blocks=True),
}
#: Formats that are tried in this order when none is named; text comes last, since nearly any ASCII is text.
SNIFFED = ("waldo", "peano", "gif", "tgz", "gzip", "jpeg", "mpeg4", "png", "riff", "tiff", "tar", "elf", "opentype", "numbers", "rle", "text")


def sniffer() -> N.Format:
    """The first format that fits; the whole input must be used up then."""
    return C.record(("data", N.UnionNondet(tuple(N.Variant(k, REGISTRY[k]) for k in SNIFFED))), ("__end", N.EndOfInput()))
