"""Expressions and formats made of others: extremes, sums, membership, options, passes over the same bytes, records with other fields."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..operators import combinators as C
from ..operators import format as N
from . import expr as X
from . import pattern as P

V = X.var


# Of sequences


def maximum_by(key: Callable[[X.Expr], X.Expr], s: Any) -> X.Expr:
    """The first element of the largest key; an error of an empty sequence."""
    s = X.lift(s)
    return X.left_fold(lambda best, x: X.if_else(key(x).gt(key(best)), x, best), s.at(0), s)


def maximum(s: Any) -> X.Expr:
    return maximum_by(lambda x: x, s)


def max_key(key: Callable[[X.Expr], X.Expr], s: Any) -> X.Expr:
    """The largest key itself."""
    return maximum(X.map_seq(key, s))


def total(s: Any, kind: str | None = "u64") -> X.Expr:
    """The sum, in a representation, or of plain integers."""
    return X.left_fold(lambda a, x: a + (X.cast(kind, x) if kind else x), X.cast(kind, 0) if kind else 0, s)


def is_elem(x: Any, s: Any) -> X.Expr:
    return X.match(X.find_by_key(lambda y: y, x, s), (P.absent(), False), (P.wildcard(), True))


def unique(s: Any, element: str = "bigint") -> X.Expr:
    """Each value once, where it comes first."""
    return X.flat_map_list(lambda out, x: X.if_else(is_elem(x, out), X.sub_seq(X.seq_of(x), 0, 0), X.seq_of(x)), s, element)


def filtered(test: Callable[[X.Expr], X.Expr], s: Any) -> X.Expr:
    return X.flat_map(lambda x: X.if_else(test(x), X.seq_of(x), X.sub_seq(X.seq_of(x), 0, 0)), s)


def enumerated(s: Any) -> X.Expr:
    """Pairs of place and element."""
    return X.flat_map_accum(lambda i, x: X.tuple_of(i + 1, X.seq_of(X.tuple_of(i, x))), 0, s)


# Of options


def unwrap_or(option: Any, other: Any) -> X.Expr:
    return X.match(option, (P.absent(), other), (P.present(P.binding("_held")), V("_held")))


def seq_to_option(s: Any) -> X.Expr:
    """The first element, if there is one."""
    return X.find_by_key(lambda _: X.lift(1), 1, s)


# Of formats


def unwrapped(f: N.Format) -> N.Format:
    """What an option holds; nothing is an error."""
    return C.chain(f, "_option", C.match(V("_option"), (P.present(P.binding("_held")), C.compute(V("_held"))), (P.absent(), N.Fail())))


def void(f: N.Format) -> N.Format:
    return C.monad_seq(f, C.compute(X.tuple_of()))


def keep_first(f: N.Format, g: N.Format) -> N.Format:
    return C.chain(f, "_kept", C.monad_seq(g, C.compute(V("_kept"))))


def keep_last(f: N.Format, g: N.Format) -> N.Format:
    return C.monad_seq(f, g)


def discard_suffix(f: N.Format, suffix: bytes) -> N.Format:
    return keep_first(f, C.is_bytes(suffix))


def two_pass(name: str, first: N.Format, second: N.Format) -> N.Format:
    """The same bytes by two formats, one after the other; the second sees the first's result by a name, and says how far they reach."""
    return C.chain(C.peek(first), name, second)


def binary_fallback(f: N.Format) -> N.Format:
    return C.alts_nondet(valid=f, invalid=C.opaque_bytes())


def with_pos(f: N.Format) -> N.Format:
    """The value and where it begins and ends."""
    return C.record(("start", N.Pos()), ("value", f), ("stop", N.Pos()))


def try_index(s: Any, i: Any) -> N.Format:
    """An element, or an error where there is none."""
    s, i = X.lift(s), X.lift(i)
    return C.match(X.both(i.gte(0), i.lt(X.seq_length(s))), (P.boolean(True), C.compute(s.at(i))), (P.boolean(False), N.Fail()))


# Of records


def subset_fields(f: N.Format, *names: str) -> N.Format:
    return C.map_format(f, lambda r: X.record_of(**{k: r[k] for k in names}))


def remap_field(f: N.Format, names: tuple[str, ...], old: str, new: str, g: Callable[[X.Expr], X.Expr] = lambda x: x) -> N.Format:
    """The record of `names` with a field under another name, changed by g."""
    return C.map_format(f, lambda r: X.record_of(**{new if k == old else k: g(r[k]) if k == old else r[k] for k in names}))


def prepend_field(name: str, field: N.Format, f: N.Format, names: tuple[str, ...]) -> N.Format:
    """A field before those of the record that f makes, and in scope of it."""
    return C.chain(field, name, C.map_format(f, lambda r: X.record_of(**{name: V(name), **{k: r[k] for k in names}})))


def merged(f: N.Format, g: N.Format, first: tuple[str, ...], second: tuple[str, ...]) -> N.Format:
    """One record of some fields of two that come one after the other."""
    body = X.record_of(**{k: V("_one")[k] for k in first}, **{k: V("_two")[k] for k in second})
    return C.chain(f, "_one", C.chain(g, "_two", C.compute(body)))
