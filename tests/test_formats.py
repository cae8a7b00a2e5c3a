"""One operator at a time: what it accepts, what it leaves, what it refuses."""

import gzip
import io
import struct
import tarfile
import zlib

import pytest

from bytegrain.functions import expr as X
from bytegrain.functions import numeric as M
from bytegrain.functions import pattern as P
from bytegrain.functions.sets import Bounds, ByteSet
from bytegrain.functions.values import DecodeError, EvalError, Int, Some, Tagged, plain
from bytegrain.operators import combinators as C
from bytegrain.operators import format as N
from bytegrain.operators import formats

V = X.var


def run(f, raw, **env):
    s = N.State(bytes(raw), len(raw))
    value, pos = f.parse(s, 0, env)
    return plain(value), bytes(raw[pos:])


def refused(f, raw, kind=None):
    with pytest.raises(DecodeError) as e:
        run(f, raw)
    assert kind is None or e.value.kind == kind


def test_bytes_and_choices():
    refused(N.Fail(), b"", "Fail")
    assert run(C.EMPTY, b"\0") == ([], b"\0")
    assert run(C.is_byte(0), b"\0\xff") == (0, b"\xff")
    refused(C.is_byte(0), b"\xff", "Unexpected")
    refused(C.is_byte(0), b"", "Overbyte")
    two = C.alts(a=C.is_byte(0), b=C.is_byte(255))
    assert run(two, b"\xff") == ({"tag": "b", "data": 255}, b"")
    refused(two, b"\x11", "NoValidBranch")
    with pytest.raises(N.AmbiguousChoice):
        C.alts(a=C.is_byte(0), b=C.is_byte(0))
    assert run(C.union_nondet(C.is_bytes(b"ab"), C.is_bytes(b"ac")), b"acx") == ([97, 99], b"x")


def test_repetition():
    zeros = C.repeat(C.is_byte(0))
    assert run(zeros, b"\0\0") == ([0, 0], b"") and run(zeros, b"\xff") == ([], b"\xff")
    with pytest.raises(ValueError):
        C.repeat(zeros)
    refused(C.repeat1(C.is_byte(0)), b"\xff")
    assert run(C.repeat_count(2, C.ANY), b"abc") == ([97, 98], b"c")
    assert run(C.repeat_between(0, 2, C.is_byte(0)), b"\0\0\0") == ([0, 0], b"\0")
    assert run(C.repeat_until_last(lambda x: x.eq(3), C.ANY), b"\1\3\2") == ([1, 3], b"\2")
    assert run(C.repeat_until_seq(lambda s: X.seq_length(s).gte(2), C.ANY), b"abc") == ([97, 98], b"c")
    upto = C.accum_until(lambda acc, seq: acc.gte(5), lambda acc, x: acc + x, Int(0, "u8"), C.ANY)
    assert run(upto, b"\2\3\4") == ([5, [2, 3]], b"\4")
    assert run(C.for_each(X.seq_of(1, 2), "n", C.repeat_count(V("n"), C.ANY)), b"abcd") == ([[97], [98, 99]], b"d")
    words = C.repeat(C.tuple_of(C.byte_in(b"#*"), C.repeat(C.byte_in(b"abc")), C.is_byte(10)))
    assert run(words, b"#\n*cab\n#a\n") == ([[35, [], 10], [42, [99, 97, 98], 10], [35, [97], 10]], b"")
    assert run(words, b"#ab\n+") == ([[35, [97, 98], 10]], b"+")
    refused(words, b"#ab\n*ad\n", "Unexpected")
    refused(C.repeat_count(-1, C.ANY), b"ab", "eval")
    assert run(C.repeat_until_last(lambda x: x.gt(96), C.byte_in(range(65, 123))), b"ABcD") == ([65, 66, 99], b"D")
    refused(C.repeat_until_last(lambda x: x.eq(10), C.ANY), b"abc", "Overbyte")
    refused(C.repeat_until_last(lambda x: x.eq(66), C.byte_in(b"AB")), b"AACB", "Unexpected")
    with pytest.raises(DecodeError) as e:
        run(C.repeat_count(4, C.byte_in(b"01")), b"012")
    assert (e.value.kind, e.value.offset) == ("Unexpected", 2)
    with pytest.raises(DecodeError) as e:
        run(C.repeat_count(4, C.byte_in(b"01")), b"01")
    assert (e.value.kind, e.value.offset) == ("Overbyte", 2)


def test_choices_look_as_far_as_needed():
    deep = C.alts(a=C.is_bytes(b"x" * 60 + b"a"), b=C.is_bytes(b"x" * 60 + b"b"))
    assert run(deep, b"x" * 60 + b"b")[0]["tag"] == "b"
    with pytest.raises(N.AmbiguousChoice):
        C.alts(a=C.is_bytes(b"x" * 90 + b"a"), b=C.is_bytes(b"x" * 90 + b"b"))


def test_modules():
    """Calls have scopes of their own, may call themselves, and know what they can know before."""
    import pickle

    m = N.Module()
    m.define("pair", C.record(("a", C.u8), ("rest", C.repeat_count(V("n"), C.u8))), params=("n",))
    assert run(C.record(("n", C.u8), ("p", m.call("pair", V("n") + 1))), b"\1abcd") == ({"n": 1, "p": {"a": 97, "rest": [98, 99]}}, b"d")
    tail = C.record(("x", C.u8), ("more", C.cond_maybe(V("x").gt(0), m.call("list"))), ("after", C.compute(V("x"))))
    m.define("list", tail)
    value = pickle.loads(pickle.dumps(m.call("list")))
    assert run(value, b"\3\2\0!")[0] == {"x": 3, "more": {"x": 2, "more": {"x": 0, "more": None, "after": 0}, "after": 2}, "after": 3}
    refused(m.call("pair"), b"ab", "eval")
    refused(m.call("nothing"), b"ab", "eval")
    with pytest.raises(ValueError):
        m.define("pair", C.u8)
    m.define("two", C.u16be)
    assert m.call("two").size() == Bounds(2, 2) and m.call("list").size().high is None
    m.define("seen", C.capture_bytes("w", 2), views=("w",))
    assert run(C.let_view("v", C.monad_seq(C.u8, m.call("seen", views=("v",)))), b"ab") == ([97, 98], b"b")


def test_names_do_not_leak():
    """An inner record's field hides an outer one of the same name inside it only, also where the inner one fails and is gone back on."""
    inner = C.record(("n", C.u8), ("m", C.where(C.u8, lambda x: x.eq(9))))
    outer = C.record(("n", C.u8), ("in", C.union_nondet(inner, C.u8)), ("rest", C.repeat_count(V("n"), C.ANY)))
    assert run(outer, b"\2\5\7ab")[0] == {"n": 2, "in": 5, "rest": [7, 97]}
    assert run(outer, b"\1\5\x09ab")[0] == {"n": 1, "in": {"n": 5, "m": 9}, "rest": [97]}
    # a slice that failed inside a choice does not shorten what comes after it
    cut = C.union_nondet(C.slice_of(1, C.u16be), C.u16be)
    assert run(C.tuple_of(cut, C.u16be), b"\0\1\0\2") == ([1, 2], b"")


def test_single_bytes_as_runs():
    """Bytes that a function maps, alone or among longer ways, are taken in runs with the same result."""
    lower = C.map_format(C.byte_in(range(65, 91)), lambda b: X.as_char(b + 32))
    pair = C.map_format(C.tuple_of(C.is_byte(33), C.ANY), lambda t: X.as_char(t[1]))
    assert run(C.repeat(C.union(lower, pair)), b"AB!zC!!D?") == (list("abzc!d"), b"?")
    assert run(C.repeat(lower), b"abc") == ([], b"abc")


def test_windows_and_places():
    for at, to in ((0, 0), (1, 4), (3, 4), (4, 4), (5, 8)):  # from a multiple it does not move
        assert run(C.tuple_of(C.repeat_count(at, C.ANY), N.Align(4), N.Pos()), b"abcdefgh")[0][2] == to
    refused(C.tuple_of(C.repeat_count(5, C.ANY), N.Align(4)), b"abcdefg", "Overrun")
    no = C.tuple_of(C.peek_not(C.is_bytes(b"\xff\xff")), C.ANY, C.ANY)
    assert run(no, b"\0\xff")[1] == b""
    refused(no, b"\xff\xff")
    with pytest.raises(ValueError):
        C.peek_not(C.repeat1(C.is_byte(0)))
    assert run(C.slice_of(3, C.ANY), b"abcd") == (97, b"d")
    refused(C.slice_of(9, C.ANY), b"abcd", "Overrun")
    assert run(C.with_relative_offset(1, 1, C.ANY), b"abc") == (99, b"abc")
    refused(C.with_relative_offset(1, 9, C.ANY), b"abc", "SeekPastEnd")
    assert run(C.bits(C.repeat_count(8, C.ANY)), b"\xd6") == ([0, 1, 1, 0, 1, 0, 1, 1], b"")
    assert run(C.let_view("v", C.tuple_of(C.ANY, C.capture_bytes("v", 2))), b"abc") == ([97, [97, 98]], b"bc")
    assert run(C.let_view("v", C.read_array("v", 2, "u16")), b"\0\1\0\2") == ([1, 2], b"\0\1\0\2")
    assert run(C.let_view("v", C.tuple_of(C.ANY, C.parse_from_view("v", C.u16be, 1))), b"a\0\7") == ([97, 7], b"\0\7")
    refused(N.EndOfInput(), b"x", "Trailing")
    assert run(C.tuple_of(N.Pos(), C.ANY, N.Pos(), N.SkipRemainder()), b"abc") == ([0, 97, 1, None], b"")


def test_validation_and_fallback():
    even = C.where(C.u8, lambda x: (x % 2).eq(0))
    refused(even, b"\3", "BadWhere")
    value, warned = N.decode(C.expect(C.u8, lambda x: (x % 2).eq(0)), b"\3")
    assert value == 3 and warned[0]["kind"] == "BadWhere"
    refused(C.enforce(C.expect(C.u8, lambda x: (x % 2).eq(0))), b"\3", "BadWhere")
    dated = C.permit(N.LiftedOption(C.tuple_of(C.repeat_count(2, C.byte_in(range(48, 58))), C.is_byte(45), C.where(C.u8, lambda x: x.gt(48)))), None)
    for raw in (b"12-", b"12-0", b"1x-5", b""):  # what was taken before the failure is given back
        assert run(dated, raw) == (None, raw)
    assert run(dated, b"12-5x")[1] == b"x"
    _, warned = N.decode(dated, b"12-0")
    assert [(w["kind"], w["offset"]) for w in warned] == [("BadWhere", 0)]
    value, warned = N.decode(C.decode_bytes(X.lift(b"ab"), C.ANY), b"")
    assert value == 97 and warned[0]["kind"] == "Trailing"
    good = C.chain(dated, "h", N.Match(V("h"), ((P.present(P.wildcard()), C.compute(True)), (P.absent(), C.compute(False)))))
    assert run(good, b"")[0] is False


def test_prefix_code():
    code = N.PrefixCode([2, 1, 3, 3])
    assert code.table == {(1, 0): 1, (2, 2): 0, (3, 6): 2, (3, 7): 3}


@pytest.mark.parametrize("level, strategy", [(0, zlib.Z_DEFAULT_STRATEGY), (1, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_FIXED), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_RLE)])
def test_deflate_agrees_with_zlib(level, strategy):
    import random

    draw = random.Random(level)
    texts = [b"", b"a", b"abcabcabcabc" * 40, bytes(draw.randrange(256) for _ in range(3000)), b"x" * 70_000, " ".join(draw.choice(["one", "two", "three", "fünf"]) for _ in range(4000)).encode()]
    for text in texts:
        press = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
        raw = press.compress(text) + press.flush()
        value, _ = N.decode(formats.REGISTRY["deflate"], raw)
        assert bytes(value["inflate"]) == text
        with pytest.raises(DecodeError):
            N.decode(formats.REGISTRY["deflate"], raw[: len(raw) // 2])


def test_records_and_numbers():
    r = C.record(("n", C.u8), ("_skip", C.ANY), ("__gone", C.ANY), ("data", C.repeat_count(V("n"), C.ANY)))
    assert run(r, b"\2xyab!") == ({"n": 2, "data": [97, 98]}, b"!")
    assert run(C.i8, b"\xff")[0] == -1 and run(C.i16be, b"\xff\xfe")[0] == -2 and run(C.u32le, b"\1\0\0\0")[0] == 1
    flags = C.bit_fields(C.u8, "u8", ("a", 1), (None, 3), ("b", 4))
    assert run(flags, b"\x85")[0] == {"a": True, "b": 5}
    assert run(C.cond_maybe(X.lift(True), C.u8), b"\1")[0] == 1 and run(C.cond_maybe(X.lift(False), C.u8), b"\1") == (None, b"\1")
    assert run(C.asciiz(), b"hi\0x") == ([104, 105], b"x")


def test_expressions():
    go = lambda e, **env: X.value(X.lift(e), env)
    with pytest.raises(EvalError):
        go(X.u8(200) + X.u8(100))
    with pytest.raises(EvalError):
        go(X.u8(1) + X.u16(1))
    with pytest.raises(EvalError):
        go(X.cast("u8", 256))
    assert go(X.u8(0xFF) << 4) == 0xF0
    assert go(X.as_char(0xD800)) == "�" and go(X.as_char(0x1F980)) == "🦀"
    assert go(X.sub_seq_inflate(X.lift(list("abc")), 1, 5)) == list("bcbcb")
    assert go(X.flat_map_accum(lambda acc, x: X.tuple_of(acc + x, X.seq_of(acc + x)), 0, X.lift([1, 2, 3]))) == [1, 3, 6]
    assert go(X.left_fold(lambda a, x: a + x, 0, X.enum_from_to(0, 5))) == 10
    pairs = X.lift([(1, "a"), (2, "b"), (2, "c"), (5, "d")])
    assert go(X.find_by_key(lambda t: t[0], 2, pairs)) == Some((2, "b"))
    assert go(X.find_by_key(lambda t: t[0], 5, pairs, is_sorted=True)) == Some((5, "d")) and go(X.find_by_key(lambda t: t[0], 4, pairs, True)) is None
    with pytest.raises(EvalError):
        go(X.lift([1]).at(1))
    with pytest.raises(EvalError):
        go(X.match(X.lift(3), (P.integer(1), "one")))
    assert go(X.match(X.lift(Tagged("t", 4)), (P.variant("t", P.binding("x")), V("x") + 1))) == 5
    assert go(X.dup(3, X.u8(65))) == b"AAA" and go(X.append(b"a", b"b")) == b"ab"


def test_numeric_model():
    assert M.evaluate(M.cast_bits(M.const(255), "i8"), {}) == -1
    assert M.evaluate(M.binary("div", M.const(-7), M.const(2)), {}) == -3 and M.evaluate(M.binary("rem", M.const(-7), M.const(3)), {}) == -1
    with pytest.raises(EvalError):
        M.evaluate(M.binary("add", M.const(1, "u8"), M.const(1, "u16")), {})
    wide = M.cast(M.binary("sub", M.const(300, "u8"), M.const(100, "u8")), "u8")
    assert M.evaluate(wide, {}) == 200
    with pytest.raises(EvalError):
        M.evaluate(wide, {}, strict=True)


def test_sets_and_bounds():
    a, b = ByteSet.of([1, 2, 3]), ByteSet.of([3, 4])
    assert list(a | b) == [1, 2, 3, 4] and list(a & b) == [3] and list(a - b) == [1, 2] and len(~a) == 253
    assert (a.min(), b.max()) == (1, 4)
    assert Bounds(1, 3) + Bounds(2, None) == Bounds(3, None) and Bounds(1, 9).clamp(Bounds(4, 6)) == Bounds(4, 6)
    assert (Bounds(3, 3) * Bounds(0, 2)).high == 6 and Bounds(9, 17).bytes_of_bits() == Bounds(2, 3)
    assert C.record(("a", C.u16be), ("b", C.u32le)).size() == Bounds(6, 6)


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + t + d + zlib.crc32(t + d).to_bytes(4, "big") for t, d in ((b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)), (b"tEXt", b"k\0v"), (b"IDAT", zlib.compress(b"\0ab\0cd")), (b"IEND", b"")))


def tarred():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name in ("a", "bb"):
            info = tarfile.TarInfo(name)
            info.size = 700
            t.addfile(info, io.BytesIO(name[0].encode() * 700))
    return out.getvalue()


WALDO = (40).to_bytes(8, "big") + b"\xff" * 31 + b"\0" + b"Waldo" + b"rest"
ELF = b"\x7fELF\2\1\1\0" + b"\0" * 8 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0) + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 0, 0, 4096)


@pytest.mark.parametrize(
    "name, raw",
    [
        ("png", PNG), ("tar", tarred()), ("tgz", gzip.compress(tarred())), ("gzip", gzip.compress(b"no archive")), ("waldo", WALDO), ("elf", ELF), ("rle", b"\1\5A\4B"), ("rle", b"\0\5A"), ("peano", b"SSZZSZ"),
        ("numbers", b"NUMS\0\xff\1\xff"), ("riff", b"RIFF\x10\0\0\0WEBPVP8 \3\0\0\0abc\0"), ("tiff", b"II*\0\x08\0\0\0\1\0" + b"\0" * 12 + b"\0" * 4), ("text", "GIF89a is popular 🦀".encode()),
        ("mpeg4", b"\0\0\0\x14ftypisom\0\0\0\1mp41\0\0\0\x0cmdatabcd"), ("gif", b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2L\1\0;"), ("jpeg", b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xy\xff\0z\xff\xd0w\xff\xd9"),
    ],
)
def test_sniffed_formats(name, raw):
    if name == "tiff":
        value, _ = N.decode(formats.REGISTRY["tiff"], raw)
        assert value["ifd"]["num-fields"] == 1 if isinstance(value, dict) else value.value["ifd"]["num-fields"] == 1
        return
    value, _ = N.decode(formats.sniffer(), raw)
    assert value["data"].tag == name


def test_contents():
    assert bytes(N.decode(formats.REGISTRY["png"], PNG)[0]["idat"]["data"]) == b"\0ab\0cd"
    assert [(bytes(e["header"]["name"]).rstrip(b"\0"), e["header"]["size"]) for e in N.decode(formats.REGISTRY["tar"], tarred())[0]["contents"]] == [(b"a", 700), (b"bb", 700)]
    assert bytes(N.decode(formats.REGISTRY["waldo"], WALDO)[0]["waldo"]) == b"Waldo"
    jpeg = N.decode(formats.REGISTRY["jpeg"], b"\xff\xd8\xff\xda\0\2xy\xff\0z\xff\xd0w\xff\xd9")[0]
    assert bytes(jpeg["scans"][0]["data"]) == b"xy\xffzw"
    for raw in (PNG[:-3], PNG[:30], gzip.compress(b"abc")[:-9], b"\xff\xfe"):
        refused(formats.sniffer(), raw)
