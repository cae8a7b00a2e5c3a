"""Deflate as RFC 1951 lays it out: blocks, their codes and symbols, and the bytes that they stand for.

`Inflate` in format.py is the fast way to the bytes alone; this format also shows what a stream is made of.
"""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from . import combinators as C
from . import format as N

V = X.var
#: Fixed: the order in which lengths of the code for code lengths come.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def bit_number(n: int, kind: str = "u16") -> N.Format:
    """n bits, the lowest first."""
    if not n:
        return C.compute(X.cast(kind, 0))

    def joined(t: X.Expr) -> X.Expr:
        out = X.cast(kind, t[0])
        for k in range(1, n):
            out = out | (X.cast(kind, t[k]) << k)
        return out

    return N.BitNumber(N.Tuple((C.ANY,) * n), X.lam(joined), kind)


def steps(first: int, alone: int, group: int, count: int) -> list[tuple[int, int]]:
    """(least value, extra bits) of codes: `alone` codes without extra bits, then `group` codes for each number of them."""
    out, base = [], first
    for k in range(count):
        extra = max(0, (k - alone) // group + 1) if k >= alone else 0
        out.append((base, extra))
        base += 1 << extra
    return out


LENGTHS = [*steps(3, 8, 4, 28), (258, 0)]
DISTANCES = steps(1, 4, 2, 30)


def ranged(code: X.Expr, first: int, table: list[tuple[int, int]]) -> N.Format:
    """The value of a code: its least value and extra bits."""

    def value(base: int, extra: int) -> N.Format:
        return C.map_format(bit_number(extra, "u32"), lambda n: n + base) if extra else C.compute(X.u32(base))

    return N.Match(code, tuple((P.integer(first + k), value(*x)) for k, x in enumerate(table)))


def symbols() -> N.Format:
    """Literals and references up to the end of the block, by the codes `literal` and `distance`."""
    reference = C.record(("length", ranged(V("code"), 257, LENGTHS)), ("_far", N.Apply("distance")), ("distance", ranged(V("_far"), 0, DISTANCES)))
    cases = [(P.integer(256), N.Variant("end", C.compute(X.none())))]
    cases += [(P.integer(257 + k), N.Variant("reference", reference)) for k in range(len(LENGTHS))]
    cases += [(P.between(0, 255), N.Variant("literal", C.compute(X.cast("u8", V("code")))))]
    one = C.chain(N.Apply("literal"), "code", N.Match(V("code"), tuple(cases)))
    return C.repeat_until_last(lambda s: X.match(s, (P.variant("end", P.wildcard()), True), (P.wildcard(), False)), one)


def stored() -> N.Format:
    check = C.where(bit_number(16), lambda n: (n + V("len")).eq(0xFFFF))
    return C.record(("__align", N.Align(8)), ("len", bit_number(16)), ("__check", check), ("bytes", C.repeat_count(V("len"), bit_number(8, "u8"))))


def fixed() -> N.Format:
    lengths = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
    return C.record(("symbols", N.Dynamic("literal", X.lift(lengths), N.Dynamic("distance", X.lift([5] * 32), symbols()))))


def dynamic() -> N.Format:
    """The code for code lengths, the lengths of both codes by it (runs written out), the symbols."""
    order = [LENGTH_ORDER.index(s) for s in range(19)]
    small = X.seq_of(*(X.if_else(V("n-small").gt(i - 4), X.if_else(X.seq_length(V("small")).gt(i), X.sub_seq(V("small"), i, 1).at(0), 0), 0) for i in order))
    times = N.Match(V("code"), ((P.integer(16), C.map_format(bit_number(2), lambda n: n + 3)), (P.integer(17), C.map_format(bit_number(3), lambda n: n + 3)), (P.integer(18), C.map_format(bit_number(7), lambda n: n + 11)), (P.wildcard(), C.compute(X.u16(1)))))
    run = C.record(("code", N.Apply("small-code")), ("times", times))
    total = V("n-literal") + V("n-distance") + 258
    runs = C.where(C.accum_until(lambda n, _: n.gte(total), lambda n, r: n + r["times"], X.u16(0), run), lambda r: r[0].eq(total))
    written = X.flat_map_list(
        lambda out, r: X.match(r["code"], (P.integer(16), X.dup(r["times"], out.at(X.seq_length(out) - 1))), (P.between(17, 18), X.dup(r["times"], X.u16(0))), (P.wildcard(), X.dup(r["times"], r["code"]))), V("_runs")[1],
    )
    literal = X.sub_seq(V("lengths"), 0, V("n-literal") + 257)
    distance = X.sub_seq(V("lengths"), V("n-literal") + 257, V("n-distance") + 1)
    return C.record(
        ("n-literal", bit_number(5)), ("n-distance", bit_number(5)), ("n-small", bit_number(4)), ("small", C.repeat_count(V("n-small") + 4, bit_number(3))),
        ("_runs", N.Dynamic("small-code", small, runs)), ("lengths", C.compute(written)), ("symbols", N.Dynamic("literal", literal, N.Dynamic("distance", distance, symbols()))),
    )


def deflate() -> N.Format:
    """blocks (final, kind, data) and `inflate`: the bytes, as references copy them from what came before, from earlier blocks too."""
    data = N.Match(V("kind"), ((P.integer(0), N.Variant("stored", stored())), (P.integer(1), N.Variant("fixed", fixed())), (P.integer(2), N.Variant("dynamic", dynamic()))))
    block = C.record(("final", bit_number(1)), ("kind", bit_number(2)), ("data", data))
    blocks = C.repeat_until_last(lambda b: b["final"].eq(1), block)
    all_symbols = X.flat_map(
        lambda b: X.match(b["data"], (P.variant("stored", P.binding("s")), X.seq_of(X.tagged("stored", V("s")["bytes"]))), (P.variant("fixed", P.binding("s")), V("s")["symbols"]), (P.variant("dynamic", P.binding("s")), V("s")["symbols"])), V("blocks"),
    )
    written = X.flat_map_list(
        lambda out, s: X.match(
            s,
            (P.variant("literal", P.binding("b")), X.seq_of(V("b"))), (P.variant("reference", P.binding("r")), X.sub_seq_inflate(out, X.seq_length(out) - V("r")["distance"], V("r")["length"])),
            (P.variant("stored", P.binding("x")), V("x")), (P.wildcard(), X.seq_of()),
        ), V("_symbols"),
    )
    return C.bits(C.record(("blocks", blocks), ("_symbols", C.compute(all_symbols)), ("inflate", C.compute(written))))
