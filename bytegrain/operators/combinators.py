"""Ready-made formats from the nodes: literals, integers, bit fields, records, strings, validation."""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from ..functions.sets import ByteSet
from . import format as N
from .format import Format

ANY = N.Byte(ByteSet.full())
EMPTY = N.Tuple(())


def is_byte(b: int) -> Format: return N.Byte(ByteSet.of([b]))
def not_byte(b: int) -> Format: return N.Byte(~ByteSet.of([b]))
def byte_in(members) -> Format: return N.Byte(ByteSet.of(members))
def is_bytes(raw: bytes) -> Format: return N.Tuple(tuple(is_byte(b) for b in raw), as_list=True)
def union(*branches: Format) -> Format: return N.Union(branches)
def union_nondet(*branches: Format) -> Format: return N.UnionNondet(branches)
def alts(**branches: Format) -> Format: return N.Union(tuple(N.Variant(k, f) for k, f in branches.items()))
def alts_nondet(**branches: Format) -> Format: return N.UnionNondet(tuple(N.Variant(k, f) for k, f in branches.items()))
def tuple_of(*items: Format) -> Format: return N.Tuple(items)
def sequence(*items: Format) -> Format: return N.Tuple(items, as_list=True)
def repeat(f: Format) -> Format: return N.Repeat(f)
def repeat1(f: Format) -> Format: return N.Repeat(f, 1)
def repeat_count(n, f: Format) -> Format: return N.Repeat(f, count=X.lift(n))
def repeat_between(low: int, high: int, f: Format) -> Format: return N.Repeat(f, low, high)
def repeat_until_last(test, f: Format) -> Format: return N.RepeatUntil(X.lam(test), f)
def repeat_until_seq(test, f: Format) -> Format: return N.RepeatUntil(X.lam(test), f, whole=True)
def accum_until(done, update, start, f: Format) -> Format: return N.AccumUntil(X.lam(done), X.lam(update), X.lift(start), f)
def for_each(items, name: str, f: Format) -> Format: return N.ForEach(X.lift(items), name, f)
def cond_maybe(test, f: Format) -> Format: return N.Maybe(X.lift(test), f)
def optional(f: Format) -> Format: return N.UnionNondet((N.LiftedOption(f), N.LiftedOption(None)))
def map_format(f: Format, g) -> Format: return N.Map(f, X.lam(g))
def where(f: Format, test) -> Format: return N.Where(f, X.lam(test))
def expect(f: Format, test) -> Format: return N.Where(f, X.lam(test), hard=False)
def where_between(f: Format, low: int, high: int) -> Format: return where(f, lambda x: X.both(x.gte(low), x.lte(high)))
def expect_between(f: Format, low: int, high: int) -> Format: return expect(f, lambda x: X.both(x.gte(low), x.lte(high)))
def where_nonzero(f: Format) -> Format: return where(f, lambda x: x.ne(0))
def expect_eq(f: Format, n) -> Format: return expect(f, lambda x: x.eq(n))
def compute(e) -> Format: return N.Compute(X.lift(e))
def let(name: str, e, f: Format) -> Format: return N.Let(name, X.lift(e), f)
def chain(first: Format, name: str, rest: Format) -> Format: return N.LetFormat(first, name, rest)
def monad_seq(first: Format, rest: Format) -> Format: return N.LetFormat(first, None, rest)
def peek(f: Format) -> Format: return N.Peek(f)
def peek_not(f: Format) -> Format: return N.Peek(f, negative=True)
def excluding(no: Format, f: Format) -> Format: return monad_seq(peek_not(no), f)
def slice_of(n, f: Format) -> Format: return N.Slice(X.lift(n), f)
def bits(f: Format) -> Format: return N.OfBits(f)
def match(e, *cases) -> Format: return N.Match(X.lift(e), cases)
def permit(f: Format, fallback) -> Format: return N.Permit(f, X.lift(fallback))
def enforce(f: Format) -> Format: return N.Enforce(f)
def align_then(n: int, f: Format) -> Format: return monad_seq(N.Align(n), f)
def then_align(f: Format, n: int) -> Format: return chain(f, "_then", monad_seq(N.Align(n), compute(X.var("_then"))))
def opaque_bytes() -> Format: return N.Repeat(ANY)
def with_relative_offset(base, offset, f: Format) -> Format: return N.WithRelativeOffset(X.lift(base), X.lift(offset), f)
def let_view(name: str, f: Format) -> Format: return N.LetView(name, f)
def capture_bytes(view: str, n, offset=None) -> Format: return N.WithView(view, "capture", X.lift(n), offset=None if offset is None else X.lift(offset))
def read_array(view: str, n, kind: str) -> Format: return N.WithView(view, "array", X.lift(n), kind)
def reify_view(view: str) -> Format: return N.WithView(view, "reify")
def parse_from_view(view: str, f: Format, offset=None) -> Format: return N.ParseFromView(view, f, None if offset is None else X.lift(offset))
def decode_bytes(e, f: Format) -> Format: return N.DecodeBytes(X.lift(e), f)


def number(kind: str, order: str = "big") -> Format:
    """An integer of a representation; signed ones are read as two's complement."""
    n = int(kind[1:]) // 8
    raw = map_format(N.Tuple((ANY,) * n), lambda t: X.endian("u" + kind[1:], order, t))
    if kind[0] == "u":
        return raw
    from ..functions import numeric

    return map_format(raw, lambda x: X.number(numeric.cast_bits(numeric.var(x.args[0]), kind)))


u8, u16be, u16le, u32be, u32le, u64be, u64le = ANY, number("u16"), number("u16", "little"), number("u32"), number("u32", "little"), number("u64"), number("u64", "little")
i8, i16be, i32be, i64be = (number(k) for k in ("i8", "i16", "i32", "i64"))


def bit_fields(f: Format, kind: str, *fields: tuple[str | None, int]) -> Format:
    """A record of fields from the highest bit down; one bit is a flag, no name is reserved and not checked."""

    def split(x: X.Expr) -> X.Expr:
        out, at = {}, int(kind[1:])
        for name, n in fields:
            at -= n
            if name:
                part = (x >> at) & ((1 << n) - 1)
                out[name] = part.ne(0) if n == 1 else part
        return X.record_of(**out)

    return map_format(f, split)


def record(*fields: tuple[str, Format]) -> Format:
    """Fields one after another, each in scope for those after it. `__x` is dropped; `_x` is in scope but not kept."""
    kept = [k for k, _ in fields if not k.startswith("_")]
    out: Format = compute(X.record_of(**{k: X.var(k) for k in kept}))
    for name, f in reversed(fields):
        out = monad_seq(f, out) if name.startswith("__") else chain(f, name, out)
    return out


def ascii_string(f: Format) -> Format: return N.Hint("ascii", f)
def asciiz() -> Format: return ascii_string(map_format(N.Tuple((N.Repeat(not_byte(0)), is_byte(0))), lambda t: t[0]))
def fixed_ascii(n) -> Format: return ascii_string(repeat_count(n, ANY))
def tag(raw: bytes) -> Format: return ascii_string(is_bytes(raw))


def digits(base: int) -> frozenset[int]:
    """Byte values of the digits of a base up to 16, both cases."""
    return frozenset(b for b in range(128) if chr(b).lower() in "0123456789abcdef"[:base])


def present_else(test: X.Expr, f: Format, other: Format) -> Format:
    return N.Match(test, ((P.boolean(True), f), (P.boolean(False), other)))
