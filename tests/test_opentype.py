"""Fonts made by hand, read back."""

import struct

import pytest

from bytegrain.functions.values import Some
from bytegrain.operators import format as N
from bytegrain.operators import formats


def made(tables: dict[bytes, bytes], base: int = 0) -> bytes:
    at = base + 12 + 16 * len(tables)
    rows, data = b"", b""
    for tag, raw in tables.items():
        rows += tag + struct.pack(">3I", 0, at + len(data), len(raw))
        data += raw + b"\0" * (-len(raw) % 4)
    return b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0) + rows + data


#: Three points: a byte to the right, 16 bits to the left, the same; then y the same, a byte down, the same.
GLYPH = struct.pack(">5h", 1, -5, 0, 300, 9) + struct.pack(">2H", 2, 1) + b"\x55" + bytes([0x33, 0x05, 0x31]) + b"\x07" + struct.pack(">h", -300) + b"\x04"
COMPOSITE = struct.pack(">5h", -1, 0, 0, 0, 0) + struct.pack(">2H2b", 0x0002 | 0x0020, 0, -3, 4) + struct.pack(">2H2hh", 0x0001 | 0x0002 | 0x0008 | 0x0100, 1, 500, -500, 0x4000) + struct.pack(">H", 2) + b"ab"
HEAD = struct.pack(">2H3I2H2Q4h2Hh2H", 1, 0, 0x10000, 0, 0x5F0F3CF5, 0, 1000, 0, 0, -1, -2, 3, 4, 0, 8, 2, 1, 0)
HHEA = struct.pack(">2H3hH6h4hhH", 1, 0, 800, -200, 0, 600, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 2)
CMAP12 = struct.pack(">2H3I", 12, 0, 28, 0, 1) + struct.pack(">3I", 65, 67, 1)
CMAP4 = struct.pack(">7H", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">2HH2H2h2H", 67, 0xFFFF, 0, 65, 0xFFFF, -64, 1, 0, 0)
CMAP = struct.pack(">2H", 0, 2) + struct.pack(">2HI2HI", 0, 3, 20, 3, 10, 20 + len(CMAP4)) + CMAP4 + CMAP12
NAME = struct.pack(">3H", 0, 1, 18) + struct.pack(">6H", 3, 1, 0x409, 1, 4, 2) + b"..Font"
POST = struct.pack(">Ii2h5I", 0x20000, 0, -75, 50, 0, 0, 0, 0, 0) + struct.pack(">4H", 3, 0, 258, 259) + b"\x03foo\x02ba"
KERN = struct.pack(">2H", 0, 1) + struct.pack(">3H4H2Hh", 0, 20, 1, 1, 6, 0, 0, 1, 2, -40)
GLYPHS = GLYPH + b"\0" * (-len(GLYPH) % 2)
LOCA = struct.pack(">4I", 0, len(GLYPHS), len(GLYPHS), len(GLYPHS + COMPOSITE))
TABLES = {
    b"head": HEAD, b"maxp": struct.pack(">IH", 0x5000, 3), b"hhea": HHEA, b"hmtx": struct.pack(">HhHhh", 500, 1, 600, -2, 3), b"cmap": CMAP, b"name": NAME, b"post": POST, b"loca": LOCA, b"glyf": GLYPHS + COMPOSITE,
    b"kern": KERN, b"cvt ": struct.pack(">2h", -7, 7), b"gasp": struct.pack(">4H", 1, 1, 0xFFFF, 15), b"DSIG": b"\0\0\0\1\0\1\0\0\0\0\0\2" + b"\0" * 8,
}


def plain(x):
    return plain(x.value) if isinstance(x, Some) else x


@pytest.fixture(scope="module")
def font():
    value, warnings = N.decode(formats.REGISTRY["opentype"], made(TABLES))
    assert value.tag == "font" and len(warnings) == 1  # the signature's format is not 1, which is permitted
    return value.value


def test_metrics(font):
    assert plain(font["head"])["units-per-em"] == 1000 and plain(font["head"])["index-to-loc-format"] == 1
    hmtx = plain(font["hmtx"])
    assert hmtx["long-metrics"] == [{"advance": 500, "bearing": 1}, {"advance": 600, "bearing": -2}] and hmtx["bearings"] == [3]
    assert plain(font["cvt"]) == [-7, 7] and plain(font["vhea"]) is None and plain(font["vmtx"]) is None


def test_names(font):
    assert bytes(plain(font["name"])["names"][0]["text"]) == b"Font"
    assert [bytes(n) for n in plain(font["post"])["glyph-names"].value["names"]] == [b"foo", b"ba"]


def test_characters(font):
    a, b = [plain(r["subtable"]) for r in plain(font["cmap"])["records"]["items"]]
    assert (a.tag, b.tag) == ("format-4", "format-12")
    assert a.value["start-codes"] == [65, 0xFFFF] and a.value["id-deltas"] == [-64, 1]
    assert b.value["groups"] == [{"first-char": 65, "last-char": 67, "glyph": 1}]


def test_glyphs(font):
    simple, empty, composite = plain(font["glyf"])
    shape = plain(simple)["shape"]
    assert shape.tag == "simple" and shape.value["x"] == [7, -300, 0] and shape.value["y"] == [0, -4, 0]
    assert plain(empty) is None
    parts = plain(composite)["shape"].value
    assert [list(p["arguments"]) for p in parts["components"]] == [[-3, 4], [500, -500]] and parts["components"][1]["scale"] == [0x4000]
    assert bytes(plain(parts["instructions"])) == b"ab"
    assert plain(font["kern"])["subtables"]["items"][0]["data"].value["pairs"] == [{"left": 1, "right": 2, "value": -40}]


def test_layout_and_collection():
    raw = struct.pack(">5H", 1, 0, 10, 30, 44) + struct.pack(">H4sH", 1, b"latn", 8) + struct.pack(">2H", 4, 0) + struct.pack(">3HH", 0, 0xFFFF, 1, 0)
    raw += struct.pack(">H4sH", 1, b"liga", 8) + struct.pack(">3H", 0, 1, 0) + struct.pack(">2H", 1, 4) + struct.pack(">4H", 4, 0, 1, 8) + struct.pack(">4H", 1, 8, 1, 14) + struct.pack(">3H", 1, 1, 70) + struct.pack(">2H", 1, 4) + struct.pack(">4H", 99, 3, 71, 72)
    head = b"ttcf" + struct.pack(">2HI2I", 1, 0, 2, 20, 20)
    value, _ = N.decode(formats.REGISTRY["opentype"], head + made({b"GSUB": raw}, base=20))
    assert value.tag == "collection" and len(value.value["fonts"]) == 2
    gsub = plain(value.value["fonts"][1]["gsub"])
    system = plain(plain(plain(gsub["scripts"])["items"][0]["script"])["default"])
    assert system["required-feature"] == 0xFFFF and system["features"]["items"] == [0]
    assert plain(plain(gsub["features"])["items"][0]["feature"])["lookups"]["items"] == [0]
    lookup = plain(plain(gsub["lookups"])["items"][0])
    assert lookup["type"] == 4
    one = plain(lookup["subtables"]["items"][0])
    assert one.tag == "type-4" and one.value.tag == "format-1"
    assert plain(one.value.value["coverage"]).value["items"] == [70]
    assert plain(plain(one.value.value["sets"]["items"][0])["items"][0]) == {"glyph": 99, "count": 3, "components": [71, 72]}


def test_cut_short():
    with pytest.raises(N.DecodeError):
        N.decode(formats.REGISTRY["opentype"], made(TABLES)[:300])


def read(tag, raw, name):
    return plain(N.decode(formats.REGISTRY["opentype"], made({tag: raw}))[0].value[name])


def lookups(kind, *subtables):
    """A GPOS or GSUB table of one lookup."""
    at, offsets, body = 6 + 2 * len(subtables), [], b""
    for raw in subtables:
        offsets.append(at + len(body))
        body += raw
    return struct.pack(">5H", 1, 0, 0, 0, 10) + struct.pack(">2H", 1, 4) + struct.pack(f">3H{len(offsets)}H", kind, 0, len(offsets), *offsets) + body


def sub(tag, kind, raw):
    found = plain(plain(read(tag, lookups(kind, raw), tag.decode().lower())["lookups"])["items"][0])
    return plain(found["subtables"]["items"][0])


COVER = struct.pack(">3H", 1, 1, 5)


def test_positions():
    got = sub(b"GPOS", 1, struct.pack(">3Hhh", 1, 10, 0x0005, 7, -8) + COVER)
    assert got.tag == "type-1" and plain(got.value.value["value"]["x-advance"]) == -8 and got.value.value["value"]["y-advance"] is None
    got = sub(b"GPOS", 2, struct.pack(">5HH", 1, 12, 4, 0, 1, 18) + COVER + struct.pack(">2Hh", 1, 6, -30)).value.value
    pairs = plain(got["sets"]["items"][0])["items"]
    assert pairs[0]["second"] == 6 and plain(pairs[0]["first-value"]["x-advance"]) == -30
    classes = struct.pack(">4H", 1, 5, 1, 1)
    got = sub(b"GPOS", 2, struct.pack(">8H", 2, 24, 4, 0, 30, 30, 2, 2) + struct.pack(">4h", 0, 1, 2, 3) + COVER + classes).value.value
    assert [[plain(c["first-value"]["x-advance"]) for c in row] for row in got["rows"]] == [[0, 1], [2, 3]]
    anchor = struct.pack(">H2h", 1, 3, 4)
    got = sub(b"GPOS", 3, struct.pack(">5H", 1, 10, 1, 16, 0) + COVER + anchor).value.value
    assert plain(got["records"]["items"][0]["entry"]).value == {"x": 3, "y": 4} and plain(got["records"]["items"][0]["exit"]) is None
    got = sub(b"GPOS", 4, struct.pack(">6H", 1, 12, 12, 1, 18, 24) + COVER + struct.pack(">3H", 1, 0, 10) + struct.pack(">2H", 1, 4) + anchor).value.value
    assert plain(plain(got["bases"])["items"][0][0]).value["x"] == 3 and plain(got["marks"])["items"][0]["class"] == 0


def test_contexts_and_extensions():
    got = sub(b"GSUB", 5, struct.pack(">3H", 3, 1, 1) + struct.pack(">H", 12) + struct.pack(">2H", 0, 9) + COVER).value.value
    assert plain(got["input"][0]).value["items"] == [5] and got["actions"] == [{"sequence": 0, "lookup": 9}]
    got = sub(b"GSUB", 6, struct.pack(">4H", 1, 8, 1, 14) + COVER + struct.pack(">2H", 1, 4) + struct.pack(">9H", 1, 4, 2, 6, 1, 7, 1, 0, 3)).value.value
    rule = plain(plain(got["rules"]["items"][0])["items"][0])
    assert rule["before"]["items"] == [4] and rule["input"] == [6] and rule["after"]["items"] == [7] and rule["actions"]["items"] == [{"sequence": 0, "lookup": 3}]
    far = sub(b"GSUB", 7, struct.pack(">2HI", 1, 1, 8) + struct.pack(">2Hh", 1, 6, 3) + COVER)
    assert far.tag == "extension" and plain(far.value["subtable"]).value.value["delta"] == 3
    assert sub(b"GSUB", 12, b"\0\1").tag == "unknown"


STORE = struct.pack(">HIHI", 1, 12, 1, 28) + struct.pack(">2H6h", 1, 2, 0, 16384, 16384, -16384, -16384, 0) + struct.pack(">3H2H", 1, 1, 2, 0, 1) + struct.pack(">hb", 300, -5)


def test_variations():
    store = plain(read(b"HVAR", struct.pack(">2H4I", 1, 0, 20, 0, 0, 0) + STORE, "hvar")["store"])
    assert plain(store["regions"])["regions"][0] == [{"start": 0, "peak": 16384, "end": 16384}]
    assert plain(store["data"]["items"][0])["rows"] == [{"words": [300], "bytes": [-5]}]
    got = read(b"MVAR", struct.pack(">6H", 1, 0, 0, 8, 1, 20) + b"xhgt" + struct.pack(">2H", 0, 1) + STORE, "mvar")
    assert bytes(got["records"][0]["tag"]) == b"xhgt" and plain(got["store"]) is not None
    stat = struct.pack(">4HIHI", 1, 0, 8, 1, 18, 1, 26) + b"wght" + struct.pack(">2H", 256, 0) + struct.pack(">H", 2) + struct.pack(">4Hi", 1, 0, 0, 257, 400 << 16)
    got = read(b"STAT", stat, "stat")
    assert bytes(plain(got["axes"])[0]["tag"]) == b"wght" and plain(plain(got["values"])[0]).value["value"] == 400 << 16
    glyph = struct.pack(">2H", 1, 10) + struct.pack(">2Hh", 3, 0x8000, 16384) + b"\1\2\3" + b"\0"
    gvar = struct.pack(">4HI2HI", 1, 0, 1, 1, 26, 2, 0, 28) + struct.pack(">3H", 0, len(glyph) // 2, len(glyph) // 2) + struct.pack(">h", -16384) + glyph
    got = read(b"gvar", gvar, "gvar")
    assert plain(got["shared"]) == [[-16384]] and plain(got["glyphs"][1]) is None
    first = plain(got["glyphs"][0])
    assert plain(first["tuples"][0]["peak"]) == [16384] and bytes(first["data"]) == b"\1\2\3\0"


def test_definitions_and_baselines():
    got = read(b"GDEF", struct.pack(">6H", 1, 0, 12, 0, 20, 0) + struct.pack(">4H", 1, 5, 1, 2) + struct.pack(">3H", 6, 1, 12) + COVER + struct.pack(">2H", 1, 4) + struct.pack(">Hh", 1, 250), "gdef")
    assert plain(got["glyph-classes"]).value["classes"]["items"] == [2]
    assert plain(plain(plain(got["carets"])["ligatures"]["items"][0])["items"][0]).value == {"x": 250}
    raw = struct.pack(">4H", 1, 0, 8, 0) + struct.pack(">2H", 4, 10) + struct.pack(">H", 1) + b"romn" + struct.pack(">H", 1) + b"latn" + struct.pack(">H", 8) + struct.pack(">3H", 6, 0, 0) + struct.pack(">3H", 0, 1, 6) + struct.pack(">Hh", 1, -20)
    got = plain(read(b"BASE", raw, "base")["horizontal"])
    script = plain(plain(got["scripts"])["items"][0]["script"])
    assert bytes(plain(got["tags"])["items"][0]) == b"romn" and plain(plain(script["values"])["places"]["items"][0]).value == {"at": -20}


def test_other_character_maps_and_unknown_tables():
    two = struct.pack(">3H", 2, 518 + 8 + 4, 0) + b"\0" * 512 + struct.pack(">2HhH", 65, 2, 0, 2) + struct.pack(">2H", 7, 8)
    eight = struct.pack(">2H2I", 8, 0, 0, 0) + bytes(8192) + struct.pack(">4I", 1, 65, 66, 3)
    fourteen = struct.pack(">H2I", 14, 0, 1) + b"\0\xfe\x0f" + struct.pack(">2I", 21, 0) + struct.pack(">I", 1) + b"\0\x03\x41\2"
    head = 4 + 3 * 8
    raw = struct.pack(">2H", 0, 3) + struct.pack(">2HI2HI2HI", 1, 1, head, 3, 8, head + len(two), 0, 5, head + len(two) + len(eight)) + two + eight + fourteen
    a, b, c = [plain(x["subtable"]) for x in read(b"cmap", raw, "cmap")["records"]["items"]]
    assert a.value["headers"][0]["first"] == 65 and a.value["glyphs"] == [7, 8]
    assert b.value["groups"] == [{"first-char": 65, "last-char": 66, "glyph": 3}]
    assert c.value["selectors"]["items"][0]["selector"] == 0xFE0F and plain(c.value["selectors"]["items"][0]["default"])["ranges"]["items"] == [{"first": 0x341, "more": 2}]
    font = N.decode(formats.REGISTRY["opentype"], made({b"head": HEAD, b"zzzz": b"?"}))[0].value
    assert [bytes(x) for x in font["font-extra"]] == [b"zzzz"]
