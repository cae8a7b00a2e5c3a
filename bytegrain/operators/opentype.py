"""OpenType fonts and collections, as the public specification lays their tables out.

The tables listed in this module are found by their tags in the directory and read in a slice at their offsets; a font without a table has
none in its place. `font-extra` names the tables that are not read. Layout and variation tables are in opentype_layout.py.
Offsets inside tables count from the table (or sub-table) that holds them; zero means that nothing is there.
"""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from . import combinators as C
from . import format as N
from . import opentype_layout as L

V = X.var
u8, u16, u32, i8, i16 = C.u8, C.u16be, C.u32be, C.i8, C.i16be


def fields(f: N.Format, *names: str) -> list[tuple[str, N.Format]]:
    return [(name, f) for name in names]


def counted(f: N.Format, count: str = "count", name: str = "items") -> N.Format:
    return C.record((count, u16), (name, C.repeat_count(V(count), f)))


def counted_u32(f: N.Format) -> N.Format:
    return C.record(("count", u32), ("items", C.repeat_count(V("count"), f)))


def when_present(option: str, name: str, f: N.Format) -> N.Format:
    """f with the option's value under a name; nothing where the option is empty. f gives an option itself."""
    return N.Match(V(option), ((P.absent(), N.LiftedOption(None)), (P.present(P.binding(name)), f)))


def table(tag: bytes, f: N.Format) -> N.Format:
    found = X.find_by_key(lambda t: t["table-id"], tag, V("tables"))
    there = N.LiftedOption(C.with_relative_offset(0, V("_t")["offset"], C.slice_of(V("_t")["length"], C.let_view("table", f))))
    return C.let("_found", found, when_present("_found", "_t", there))


def linked(offset: N.Format, view: str, f: N.Format) -> N.Format:
    """What an offset from a view leads to; zero leads nowhere."""
    there = N.LiftedOption(C.parse_from_view(view, f, V("_to")))
    return C.chain(offset, "_to", N.Match(V("_to").eq(0), ((P.boolean(True), N.LiftedOption(None)), (P.boolean(False), there))))


def metrics_header() -> N.Format:
    """hhea and vhea."""
    return C.record(
        ("major", u16), ("minor", u16), *fields(i16, "ascent", "descent", "line-gap"), ("advance-max", u16), *fields(i16, "min-first-bearing", "min-last-bearing", "max-extent", "caret-rise", "caret-run", "caret-offset"),
        ("__reserved", C.repeat_count(4, i16)), ("metric-data-format", i16), ("long-metrics", u16),
    )


def metrics(header: str) -> N.Format:
    """hmtx and vmtx: as many long metrics as the header says, then bearings of the other glyphs."""
    long = C.record(("advance", u16), ("bearing", i16))
    return C.record(("long-metrics", C.repeat_count(V(header)["long-metrics"], long)), ("bearings", C.repeat_count(V("_glyphs")["num-glyphs"] - V(header)["long-metrics"], i16)))


def head() -> N.Format:
    return C.record(
        ("major", u16), ("minor", u16), ("font-revision", u32), ("checksum-adjustment", u32), ("__magic", C.where(u32, lambda x: x.eq(0x5F0F3CF5))), ("flags", u16), ("units-per-em", C.where_between(u16, 16, 16384)), ("created", C.u64be), ("modified", C.u64be),
        *fields(i16, "x-min", "y-min", "x-max", "y-max"), ("mac-style", u16), ("lowest-ppem", u16), ("direction-hint", i16), ("index-to-loc-format", C.where_between(u16, 0, 1)), ("glyph-data-format", i16),
    )


def maxp() -> N.Format:
    names = ("max-points", "max-contours", "max-composite-points", "max-composite-contours", "max-zones", "max-twilight-points", "max-storage", "max-function-defs", "max-instruction-defs", "max-stack", "max-instruction-bytes", "max-component-elements", "max-component-depth")
    limits = N.Match(V("version"), ((P.integer(0x10000), N.LiftedOption(C.record(*fields(u16, *names)))), (P.wildcard(), N.LiftedOption(None))))
    return C.record(("version", u32), ("num-glyphs", u16), ("limits", limits))


def name_table() -> N.Format:
    """The bytes of every name; they are not decoded, as their encoding goes by platform."""

    def text() -> N.Format:
        return C.capture_bytes("table", V("length"), X.cast("u32", V("storage")) + X.cast("u32", V("offset")))

    entry = C.record(*fields(u16, "platform", "encoding", "language", "name-id", "length", "offset"), ("text", text()))
    language = C.record(("length", u16), ("offset", u16), ("text", text()))
    tags = N.Match(V("version"), ((P.integer(0), N.LiftedOption(None)), (P.wildcard(), N.LiftedOption(counted(language)))))
    return C.record(("version", u16), ("count", u16), ("storage", u16), ("names", C.repeat_count(V("count"), entry)), ("languages", tags))


def os2() -> N.Format:
    """Fields by version; version 0 may end before the typographic metrics."""

    def from_version(n: int, f: N.Format) -> N.Format:
        return C.cond_maybe(V("version").gte(n), f)

    typo = C.record(*fields(i16, "typo-ascender", "typo-descender", "typo-line-gap"), *fields(u16, "win-ascent", "win-descent"))
    scripts = ("subscript-x-size", "subscript-y-size", "subscript-x-offset", "subscript-y-offset", "superscript-x-size", "superscript-y-size", "superscript-x-offset", "superscript-y-offset", "strikeout-size", "strikeout-position", "family-class")
    return C.record(
        ("version", u16), ("average-width", i16), *fields(u16, "weight-class", "width-class", "type-flags"), *fields(i16, *scripts), ("panose", C.repeat_count(10, u8)), ("unicode-ranges", C.repeat_count(4, u32)), ("vendor", C.fixed_ascii(4)),
        *fields(u16, "selection", "first-char", "last-char"), ("typographic", C.cond_maybe(X.either(V("version").gte(1), V("_t")["length"].gte(78)), typo)),
        ("code-pages", from_version(1, C.repeat_count(2, u32))), ("heights", from_version(2, C.record(*fields(i16, "x-height", "cap-height"), *fields(u16, "default-char", "break-char", "max-context")))), ("sizes", from_version(5, C.record(*fields(u16, "lower-size", "upper-size")))),
    )


def post() -> N.Format:
    """Version 2 has an index for each glyph and the names beyond the 258 standard ones, which run to the table's end."""
    pascal = C.chain(u8, "_n", C.fixed_ascii(V("_n")))
    v2 = C.record(("count", u16), ("indices", C.repeat_count(V("count"), u16)), ("names", N.Repeat(pascal)))
    kinds = ((P.integer(0x20000), N.Variant("names", v2)), (P.integer(0x25000), N.Variant("offsets", counted(i8))), (P.wildcard(), N.Variant("none", C.compute(X.none()))))
    return C.record(("version", u32), ("italic-angle", C.i32be), *fields(i16, "underline-position", "underline-thickness"), *fields(u32, "fixed-pitch", "min-memory-42", "max-memory-42", "min-memory-1", "max-memory-1"), ("glyph-names", N.Match(V("version"), kinds)))


def cmap() -> N.Format:
    """Encoding records with their sub-tables, whose first number names the kind."""
    group = C.record(*fields(u32, "first-char", "last-char", "glyph"))
    wide = [("__reserved", u16), ("length", u32), ("language", u32)]
    half = V("segments-x2") // 2
    segments = [("end-codes", C.repeat_count(half, u16)), ("__pad", u16), ("start-codes", C.repeat_count(half, u16)), ("id-deltas", C.repeat_count(half, i16)), ("id-range-offsets", C.repeat_count(half, u16))]
    kinds = {
        0: [("length", u16), ("language", u16), ("glyphs", C.repeat_count(256, u8))],
        4: [("length", u16), ("language", u16), *fields(u16, "segments-x2", "search-range", "entry-selector", "range-shift"), *segments],
        6: [("length", u16), ("language", u16), ("first-char", u16), ("glyphs", counted(u16))],
        10: [*wide, ("first-char", u32), ("count", u32), ("glyphs", C.repeat_count(V("count"), u16))],
        12: [*wide, ("count", u32), ("groups", C.repeat_count(V("count"), group))],
        13: [*wide, ("count", u32), ("groups", C.repeat_count(V("count"), group))],
    }
    u24 = C.map_format(C.repeat_count(3, u8), lambda b: (X.cast("u32", b.at(0)) << 16) | (X.cast("u32", b.at(1)) << 8) | X.cast("u32", b.at(2)))
    header = C.record(*fields(u16, "first", "count"), ("delta", i16), ("range-offset", u16))
    plain = C.record(("ranges", counted_u32(C.record(("first", u24), ("more", u8)))))
    mapped = C.record(("mappings", counted_u32(C.record(("char", u24), ("glyph", u16)))))
    selector = C.record(("selector", u24), ("default", linked(u32, "sub", plain)), ("mapped", linked(u32, "sub", mapped)))
    kinds |= {
        2: [("length", u16), ("language", u16), ("keys", C.repeat_count(256, u16)), ("headers", C.repeat_count(X.left_fold(lambda most, k: X.if_else(k.gt(most), k, most), X.u16(0), V("keys")) // 8 + 1, header)), ("glyphs", C.slice_of(V("length") - 518 - X.cast("u16", X.seq_length(V("headers"))) * 8, N.Repeat(u16)))],
        8: [*wide, ("is-32", C.repeat_count(8192, u8)), ("count", u32), ("groups", C.repeat_count(V("count"), group))],
        14: [("length", u32), ("selectors", counted_u32(selector))],
    }
    cases = [(P.integer(n), N.Variant(f"format-{n}", C.record(*f))) for n, f in kinds.items()]
    subtable = C.chain(u16, "_kind", N.Match(V("_kind"), (*cases, (P.wildcard(), N.Variant("other", C.compute(V("_kind")))))))
    entry = C.record(("platform", u16), ("encoding", u16), ("subtable", linked(u32, "table", C.let_view("sub", subtable))))
    return C.record(("version", u16), ("records", counted(entry)))


def loca() -> N.Format:
    """Offsets of all glyphs and the end, in bytes for either form."""
    count = X.cast("u32", V("_glyphs")["num-glyphs"]) + 1
    short = C.map_format(C.repeat_count(count, u16), lambda s: X.map_seq(lambda o: X.cast("u32", o) * 2, s))
    return N.Match(V("_head")["index-to-loc-format"], ((P.integer(0), short), (P.wildcard(), C.repeat_count(count, u32))))


def coordinates(short: str, same: str) -> N.Format:
    """Steps from point to point: a byte with its sign in the other flag, nothing where the flag says the same, or 16 bits."""
    step, zero = X.cast("i16", V("_step")), X.lift(N.Int(0, "i16"))
    byte = C.chain(u8, "_step", C.compute(X.if_else(V("_flag")[same], step, zero - step)))
    rest = N.Match(V("_flag")[same], ((P.boolean(True), C.compute(zero)), (P.boolean(False), i16)))
    return C.for_each(V("_flags"), "_flag", N.Match(V("_flag")[short], ((P.boolean(True), byte), (P.boolean(False), rest))))


def glyph() -> N.Format:
    flags = C.bit_fields(u8, "u8", (None, 1), ("overlap", 1), ("y-same", 1), ("x-same", 1), ("repeat", 1), ("y-short", 1), ("x-short", 1), ("on-curve", 1))
    more = N.Match(V("flags")["repeat"], ((P.boolean(True), u8), (P.boolean(False), C.compute(X.u8(0)))))
    run = C.record(("flags", flags), ("repeats", more))
    points = X.cast("u32", V("ends").at(X.seq_length(V("ends")) - 1)) + 1
    runs = C.accum_until(lambda n, _: n.gte(points), lambda n, r: n + 1 + X.cast("u32", r["repeats"]), X.u32(0), run)
    simple = C.record(
        ("ends", C.repeat_count(V("contours"), u16)), ("instruction-length", u16), ("instructions", C.repeat_count(V("instruction-length"), u8)), ("_runs", runs),
        ("_flags", C.compute(X.flat_map(lambda r: X.dup(X.cast("u32", r["repeats"]) + 1, r["flags"]), V("_runs")[1]))), ("flags", C.compute(V("_flags"))), ("x", coordinates("x-short", "x-same")), ("y", coordinates("y-short", "y-same")),
    )
    bits = C.bit_fields(
        u16, "u16", (None, 3), ("unscaled-offset", 1), ("scaled-offset", 1), ("overlap", 1), ("use-my-metrics", 1), ("instructions", 1), ("two-by-two", 1), ("x-and-y-scale", 1), ("more-components", 1), (None, 1), ("scale", 1), ("round", 1), ("values", 1), ("words", 1),
    )
    narrow = N.Match(V("flags")["values"], ((P.boolean(True), C.repeat_count(2, i8)), (P.boolean(False), C.repeat_count(2, u8))))
    broad = N.Match(V("flags")["values"], ((P.boolean(True), C.repeat_count(2, i16)), (P.boolean(False), C.repeat_count(2, u16))))
    arguments = N.Match(V("flags")["words"], ((P.boolean(True), broad), (P.boolean(False), narrow)))
    scales = X.if_else(V("flags")["scale"], X.u8(1), X.if_else(V("flags")["x-and-y-scale"], X.u8(2), X.if_else(V("flags")["two-by-two"], X.u8(4), X.u8(0))))
    part = C.record(("flags", bits), ("glyph", u16), ("arguments", arguments), ("scale", C.repeat_count(scales, i16)))
    parts = C.repeat_until_last(lambda p: X.negate(p["flags"]["more-components"]), part)
    told = X.left_fold(lambda any_, p: X.either(any_, p["flags"]["instructions"]), False, V("components"))
    composite = C.record(("components", parts), ("instructions", C.cond_maybe(told, C.chain(u16, "_n", C.repeat_count(V("_n"), u8)))))
    zero = V("contours").eq(0)
    shape = N.Match(V("contours").gt(0), ((P.boolean(True), N.Variant("simple", simple)), (P.boolean(False), N.Match(zero, ((P.boolean(True), N.Variant("header-only", C.compute(X.none()))), (P.boolean(False), N.Variant("composite", composite)))))))
    return C.record(("contours", i16), *fields(i16, "x-min", "y-min", "x-max", "y-max"), ("shape", shape))


def glyf() -> N.Format:
    """A glyph between each two offsets that follow one another; equal ones hold none."""
    here, after = V("_loca").at(V("_i")), V("_loca").at(V("_i") + 1)
    one = N.Match(here.eq(after), ((P.boolean(True), N.LiftedOption(None)), (P.boolean(False), N.LiftedOption(C.parse_from_view("table", glyph(), here)))))
    return C.for_each(X.enum_from_to(X.u32(0), X.cast("u32", V("_glyphs")["num-glyphs"])), "_i", one)


def kern() -> N.Format:
    pair = C.record(("left", u16), ("right", u16), ("value", i16))
    pairs = C.record(*fields(u16, "count", "search-range", "entry-selector", "range-shift"), ("pairs", C.repeat_count(V("count"), pair)))
    form = V("coverage") >> 8
    body = N.Match(form, ((P.integer(0), N.Variant("pairs", pairs)), (P.wildcard(), N.Variant("opaque", C.slice_of(V("length") - 6, C.opaque_bytes())))))
    return C.record(("version", u16), ("subtables", counted(C.record(("version", u16), ("length", u16), ("coverage", u16), ("data", body)))))


def layout(kinds: dict[int, N.Format], extension: int) -> N.Format:
    """GSUB and GPOS: scripts, features and lookups with their sub-tables."""
    system = C.record(("lookup-order", u16), ("required-feature", u16), ("features", counted(u16)))
    script = C.let_view("script", C.record(("default", linked(u16, "script", system)), ("systems", counted(C.record(("tag", C.fixed_ascii(4)), ("system", linked(u16, "script", system)))))))
    scripts = C.let_view("list", counted(C.record(("tag", C.fixed_ascii(4)), ("script", linked(u16, "list", script)))))
    features = C.let_view("list", counted(C.record(("tag", C.fixed_ascii(4)), ("feature", linked(u16, "list", C.record(("parameters", u16), ("lookups", counted(u16))))))))
    lookups = C.let_view("list", counted(linked(u16, "list", L.lookup(kinds, extension))))
    return C.record(("major", u16), ("minor", u16), ("scripts", linked(u16, "table", scripts)), ("features", linked(u16, "table", features)), ("lookups", linked(u16, "table", lookups)), ("variations", C.cond_maybe(V("minor").gt(0), u32)))


def fvar() -> N.Format:
    axis = C.record(("tag", C.fixed_ascii(4)), *fields(C.i32be, "min", "default", "max"), ("flags", u16), ("name-id", u16))
    instance = C.record(("subfamily", u16), ("flags", u16), ("coordinates", C.repeat_count(V("axis-count"), C.i32be)), ("postscript", C.cond_maybe((V("instance-size") % 4).eq(2), u16)))
    names = ("major", "minor", "axes-offset", "reserved", "axis-count", "axis-size", "instance-count", "instance-size")
    return C.record(*fields(u16, *names), ("data", C.parse_from_view("table", C.record(("axes", C.repeat_count(V("axis-count"), axis)), ("instances", C.repeat_count(V("instance-count"), instance))), V("axes-offset"))))


def svg() -> N.Format:
    document = C.record(*fields(u16, "first-glyph", "last-glyph"), *fields(u32, "offset", "length"), ("document", C.capture_bytes("list", V("length"), V("offset"))))
    return C.record(("version", u16), ("documents", linked(u32, "table", C.let_view("list", counted(document)))), ("__reserved", u32))


def dsig() -> N.Format:
    block = C.record(("__reserved", C.repeat_count(2, u16)), ("length", u32), ("signature", C.repeat_count(V("length"), u8)))
    entry = C.record(("format", C.where(u32, lambda x: x.eq(1))), ("length", u32), ("block", linked(u32, "table", block)))
    return C.record(("version", u32), ("count", u16), ("flags", u16), ("signatures", C.repeat_count(V("count"), entry)))


def vdmx() -> N.Format:
    ratio = C.record(*fields(u8, "char-set", "x-ratio", "y-start", "y-end"))
    heights = C.record(("count", u16), ("first", u8), ("last", u8), ("entries", C.repeat_count(V("count"), C.record(("y-pel", u16), ("y-max", i16), ("y-min", i16)))))
    return C.record(*fields(u16, "version", "num-recs", "num-ratios"), ("ratios", C.repeat_count(V("num-ratios"), ratio)), ("groups", C.repeat_count(V("num-ratios"), linked(u16, "table", heights))))


#: Fixed: tags of the tables that are read.
KNOWN = [t.encode() for t in ("BASE", "DSIG", "GDEF", "GPOS", "GSUB", "HVAR", "MVAR", "OS/2", "STAT", "SVG ", "VDMX", "VVAR", "avar", "cmap", "cvt ", "fpgm", "fvar", "gasp", "glyf", "gvar", "hdmx", "head", "hhea", "hmtx", "kern", "loca", "maxp", "name", "post", "prep", "vhea", "vmtx")]


def font() -> N.Format:
    entry = C.record(("table-id", C.fixed_ascii(4)), ("checksum", u32), ("offset", u32), ("length", u32))
    magic = N.Union((C.is_bytes(b"\0\1\0\0"), C.is_bytes(b"OTTO"), C.is_bytes(b"true")))
    directory = [("magic", magic), *fields(u16, "num-tables", "search-range", "entry-selector", "range-shift"), ("tables", C.repeat_count(V("num-tables"), entry))]

    def with_glyphs(f: N.Format) -> N.Format:
        return when_present("maxp", "_glyphs", f)

    hdmx = C.record(("version", u16), ("count", u16), ("size", u32), ("records", C.repeat_count(V("count"), C.slice_of(V("size"), C.record(("ppem", u8), ("max-width", u8), ("widths", C.repeat_count(V("_glyphs")["num-glyphs"], u8)))))))
    avar = C.record(*fields(u16, "major", "minor", "reserved"), ("axes", counted(counted(C.record(("from", i16), ("to", i16))))))
    return C.record(
        *directory, ("head", table(b"head", head())), ("maxp", table(b"maxp", maxp())), ("hhea", table(b"hhea", metrics_header())), ("vhea", table(b"vhea", metrics_header())),
        ("hmtx", with_glyphs(when_present("hhea", "_metrics", table(b"hmtx", metrics("_metrics"))))), ("vmtx", with_glyphs(when_present("vhea", "_metrics", table(b"vmtx", metrics("_metrics"))))),
        ("cmap", table(b"cmap", cmap())), ("name", table(b"name", name_table())), ("os2", table(b"OS/2", os2())), ("post", table(b"post", post())), ("cvt", table(b"cvt ", N.Repeat(i16))), ("fpgm", table(b"fpgm", C.opaque_bytes())), ("prep", table(b"prep", C.opaque_bytes())),
        ("loca", with_glyphs(when_present("head", "_head", table(b"loca", loca())))), ("glyf", with_glyphs(when_present("loca", "_loca", table(b"glyf", glyf())))), ("gasp", table(b"gasp", C.record(("version", u16), ("ranges", counted(C.record(("max-ppem", u16), ("behavior", u16))))))),
        ("kern", table(b"kern", kern())), ("gsub", table(b"GSUB", layout(L.substitutions(), 7))), ("gpos", table(b"GPOS", layout(L.positions(), 9))), ("fvar", table(b"fvar", fvar())), ("avar", table(b"avar", avar)), ("hdmx", with_glyphs(table(b"hdmx", hdmx))), ("vdmx", table(b"VDMX", vdmx())), ("svg", table(b"SVG ", svg())),
        ("dsig", C.permit(table(b"DSIG", dsig()), X.none())), ("gdef", table(b"GDEF", L.gdef())), ("base", table(b"BASE", L.base())), ("gvar", table(b"gvar", L.gvar())), ("hvar", table(b"HVAR", L.metrics_variations("advances", "lsb", "rsb"))),
        ("vvar", table(b"VVAR", L.metrics_variations("advances", "tsb", "bsb", "v-origin"))), ("mvar", table(b"MVAR", L.mvar())), ("stat", table(b"STAT", L.stat())),
        ("font-extra", C.compute(X.flat_map(lambda t: X.match(X.find_by_key(lambda k: k, t["table-id"], X.lift(KNOWN)), (P.absent(), X.seq_of(t["table-id"])), (P.wildcard(), X.seq_of())), V("tables")))),
    )


def opentype() -> N.Format:
    """A font, or a collection of fonts that share tables."""
    fonts = C.for_each(V("offsets"), "_at", C.with_relative_offset(0, V("_at"), font()))
    collection = C.record(("__magic", C.is_bytes(b"ttcf")), ("major", u16), ("minor", u16), ("count", u32), ("offsets", C.repeat_count(V("count"), u32)), ("fonts", fonts))
    return C.chain(N.UnionNondet((N.Variant("collection", collection), N.Variant("font", font()))), "_font", C.monad_seq(N.SkipRemainder(), C.compute(V("_font"))))
