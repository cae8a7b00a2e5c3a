"""Chunks, atoms and segments made by hand, read back."""

import struct
import zlib

from bytegrain.functions.values import Some
from bytegrain.operators import format as N
from bytegrain.operators import formats


def plain(x):
    return plain(x.value) if isinstance(x, Some) else x


def chunk(tag: bytes, raw: bytes) -> bytes:
    return struct.pack(">I", len(raw)) + tag + raw + b"crc!"


def atom(tag: bytes, raw: bytes) -> bytes:
    return struct.pack(">I", 8 + len(raw)) + tag + raw


def segment(marker: int, raw: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", 2 + len(raw)) + raw


def png(color: int, *chunks: bytes) -> dict:
    ihdr = chunk(b"IHDR", struct.pack(">2I5B", 1, 1, 8, color, 0, 0, 0))
    raw = b"\x89PNG\r\n\x1a\n" + ihdr + b"".join(chunks) + chunk(b"IDAT", zlib.compress(b"\0a")) + chunk(b"IEND", b"")
    value, _ = N.decode(formats.REGISTRY["png"], raw)
    return {bytes(c["tag"]): c["content"].value for c in value["chunks"]}


def test_png_chunks():
    found = png(
        2, chunk(b"PLTE", bytes(range(6))), chunk(b"tRNS", struct.pack(">3H", 1, 2, 3)), chunk(b"gAMA", struct.pack(">I", 45455)), chunk(b"tEXt", b"Title\0words"), chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"packed")), chunk(b"tIME", struct.pack(">H5B", 2024, 2, 3, 4, 5, 6)),
        chunk(b"iTXt", b"Key\0\1\0en\0Wort\0" + b"not deflated"), chunk(b"sBIT", b"\5\6\5"), chunk(b"pHYs", struct.pack(">2IB", 10, 20, 1)), chunk(b"abCd", b"?"),
    )
    assert [[int(p[k]) for k in "rgb"] for p in found[b"PLTE"]] == [[0, 1, 2], [3, 4, 5]]
    assert found[b"tRNS"].tag == "color-type-2" and found[b"tRNS"].value == {"red": 1, "green": 2, "blue": 3}
    assert found[b"gAMA"]["gamma"] == 45455 and bytes(found[b"tEXt"]["keyword"]) == b"Title" and bytes(found[b"tEXt"]["text"]) == b"words"
    assert bytes(found[b"zTXt"]["text"].value["data"]) == b"packed"
    assert found[b"iTXt"]["text"].tag == "bytes" and bytes(found[b"iTXt"]["text"].value) == b"not deflated"
    assert found[b"tIME"]["year"] == 2024 and found[b"sBIT"].value["green"] == 6 and found[b"pHYs"]["unit"] == 1 and bytes(found[b"abCd"]) == b"?"


def test_png_by_color():
    assert png(0, chunk(b"bKGD", b"\0\7"))[b"bKGD"].value == {"greyscale": 7}
    assert png(3, chunk(b"bKGD", b"\7"))[b"bKGD"].value == {"palette-index": 7}
    assert png(6, chunk(b"tRNS", b"xy"))[b"tRNS"].tag == "no-transparency"


def test_atoms():
    stts = atom(b"stts", struct.pack(">2I2I", 0, 1, 24, 512))
    co64 = atom(b"co64", struct.pack(">2IQ", 0, 1, 1 << 40))
    stsz = atom(b"stsz", struct.pack(">5I", 0, 0, 2, 100, 200))
    mdhd = atom(b"mdhd", struct.pack(">B3s4I2H", 0, b"\0\0\0", 1, 2, 600, 1200, 0, 0))
    minf = atom(b"minf", atom(b"stbl", stts + co64 + stsz))
    raw = atom(b"ftyp", b"isom\0\0\2\0mp41") + atom(b"moov", atom(b"trak", atom(b"mdia", mdhd + minf))) + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
    value, _ = N.decode(formats.sniffer(), raw)
    assert value["data"].tag == "mpeg4"
    ftyp, moov, mdat = value["data"].value["atoms"]
    assert [bytes(b) for b in ftyp["data"].value["compatible-brands"]] == [b"mp41"] and mdat["size"] == 4 and mdat["data"].value is None
    mdia = moov["data"].value["atoms"][0]["data"].value["atoms"][0]["data"].value["atoms"]
    assert mdia[0]["data"].value["timescale"] == 600 and mdia[0]["data"].value["duration"] == 1200
    tables = {bytes(t["type"]): t["data"].value for t in mdia[1]["data"].value["atoms"][0]["data"].value["atoms"]}
    assert tables[b"stts"]["table"]["entries"] == [{"sample-count": 24, "sample-delta": 512}]
    assert tables[b"co64"]["table"]["entries"] == [1 << 40] and tables[b"stsz"]["sizes"] == [100, 200]


def test_heic_items():
    infe = atom(b"infe", struct.pack(">B3s2H4s", 2, b"\0\0\0", 7, 0, b"hvc1") + b"main\0")
    meta = atom(b"meta", b"\0" * 4 + atom(b"pitm", struct.pack(">IH", 0, 7)) + atom(b"iinf", struct.pack(">IH", 0, 1) + infe))
    value, _ = N.decode(formats.REGISTRY["mpeg4"], atom(b"ftyp", b"heic\0\0\0\0") + meta)
    pitm, iinf = value["atoms"][1]["data"].value["atoms"]
    item = iinf["data"].value["items"][0]["data"].value
    assert pitm["data"].value["item-id"] == 7 and item["item-id"] == 7 and bytes(plain(item["item-type"])) == b"hvc1" and bytes(item["name"]) == b"main"


def test_jpeg_segments():
    tiff = b"II*\0\x08\0\0\0\1\0" + struct.pack("<2H2I", 274, 3, 1, 6) + b"\0" * 4
    parts = [
        segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0"), segment(0xE1, b"Exif\0\0" + tiff), segment(0xDB, b"\0" + bytes(range(64))), segment(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + b"\5\6"),
        segment(0xC0, struct.pack(">B2HB", 8, 4, 5, 1) + b"\1\x21\0"), segment(0xFE, b"hello"), segment(0xDD, b"\0\4"),
    ]
    raw = b"\xff\xd8" + b"".join(parts) + b"\xff\xda\0\x08\1\1\x12\0\x3f\0" + b"x\xff\0y\xff\xd9"
    value, _ = N.decode(formats.REGISTRY["jpeg"], raw)
    scan = value["scans"][0]
    found = {s["content"].tag: s["content"].value for s in scan["segments"]}
    assert list(found) == ["jfif", "exif", "dqt", "dht", "sof", "com", "dri"]
    assert found["sof"]["lines"] == 4 and found["sof"]["components"]["entries"][0]["sampling"] == {"horizontal": 2, "vertical": 1}
    assert [list(v) for v in found["dht"][0]["values"]][:2] == [[], [5, 6]] and found["dri"] == 4 and bytes(found["com"]) == b"hello"
    assert scan["header"].tag == "scan" and scan["header"].value["components"]["entries"][0]["tables"] == {"dc-table": 1, "ac-table": 2}
    assert bytes(scan["data"]) == b"x\xffy"
