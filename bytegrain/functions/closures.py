"""Expressions as Python closures over a frame: the same values as `expr.value`, without walking the tree for each of them.

A frame is a list; every variable has a place in it that is known when the closure is made. Operators that are rare fall back on `value`.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from operator import itemgetter
from typing import Any

from . import expr as X
from . import numeric
from .pattern import Pattern
from .values import CLASSES, EvalError, Int, Some, Tagged

Closure = Callable[[list], Any]
MISSING = object()


def free(e: Any) -> set[str]:
    """Names of all variables in a tree (bound ones too)."""
    if isinstance(e, X.Expr):
        return {e.args[0]} if e.op == "var" else set().union(*map(free, e.args))
    if isinstance(e, numeric.Tree):
        return {e.args[0]} if e.op == "var" else set().union(*map(free, e.args))
    if isinstance(e, X.Lambda):
        return free(e.body)
    return set().union(*map(free, e)) if isinstance(e, tuple) else set()


def bound(p: Pattern) -> list[str]:
    """Names that a pattern binds."""
    if p.kind == "binding":
        return [p.args[0]]
    return [n for a in p.args if isinstance(a, Pattern) for n in bound(a)]


def as_kind(value: int, x: Any, y: Any) -> int:
    """The value in the operands' common representation; plain ints take on that of the other."""
    a, b = x.__class__, y.__class__
    if a is b or b not in KINDS:
        kind = a
    elif a not in KINDS:
        kind = b
    else:
        raise EvalError(f"mixed representations {sorted((a.kind, b.kind))}")
    if kind not in KINDS:
        return value
    if kind.low <= value <= kind.high:
        return int.__new__(kind, value)
    raise EvalError(f"{value} is no {kind.kind}")


KINDS = frozenset(CLASSES.values())


def _shifted(x: Any, y: Any) -> int:
    """To the left, unchecked: what goes beyond the width is lost."""
    if y < 0:
        raise EvalError(f"shift by {y}")
    kind = x.__class__
    return int.__new__(kind, (int(x) << int(y)) & kind.high) if kind in KINDS else x << y


def _lowered(x: Any, y: Any) -> int:
    if y < 0:
        raise EvalError(f"shift by {y}")
    return as_kind(int(x) >> int(y), x, x)


def _checked(f: Callable[[int, int], int]) -> Callable[[Any, Any], int]:
    return lambda x, y: as_kind(f(int(x), int(y)), x, y)


ARITH = {op: _checked(f) for op, f in X._ARITH.items()} | {"<<": _shifted, ">>": _lowered}
REL = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class Scope:
    """Names and their places; `inner` adds names without touching the outer scope. All scopes of a program share one counter."""

    def __init__(self, places: dict[str, int] | None = None, counter: list[int] | None = None):
        self.places, self.counter = places or {}, [0] if counter is None else counter

    def new(self) -> int:
        self.counter[0] += 1
        return self.counter[0] - 1

    def inner(self, *names: str) -> tuple[Scope, list[int]]:
        at = [self.new() for _ in names]
        return Scope({**self.places, **dict(zip(names, at))}, self.counter), at

    def only(self, places: dict[str, int]) -> Scope:
        return Scope(places, self.counter)


def function(f: X.Lambda, scope: Scope) -> Callable[..., Any]:
    """The lambda as a function of the frame and its arguments."""
    own, at = scope.inner(*f.names)
    body = build(f.body, own)
    if len(at) == 1:
        one = at[0]

        def run(fr: list, x: Any) -> Any:
            fr[one] = x
            return body(fr)
    else:
        one, two = at

        def run(fr: list, x: Any, y: Any) -> Any:
            fr[one], fr[two] = x, y
            return body(fr)

    return run


def matcher(p: Pattern, scope: Scope) -> tuple[Callable[[list, Any], bool], Scope]:
    """Tests a value and puts what the pattern binds into the frame."""
    names = bound(p)
    own, at = scope.inner(*names)
    if p.kind == "wildcard":
        return lambda fr, x: True, own
    if p.kind == "binding":
        one = at[0]

        def run(fr: list, x: Any) -> bool:
            fr[one] = x
            return True
    else:
        places, match = list(zip(names, at)), p.match

        def run(fr: list, x: Any) -> bool:
            found = match(x)
            if found is None:
                return False
            for name, place in places:
                fr[place] = found[name]
            return True

    return run, own


def constant(p: Pattern) -> Any:
    """What a pattern without bindings equals, if that is bytes, a plain number or a truth value; else MISSING."""
    if p.kind == "bool" or p.kind == "int" and p.args[1] is None:
        return p.args[0]
    if p.kind == "seq" and p.args and all(a.kind == "int" and a.args[1] is None for a in p.args):
        return bytes(a.args[0] for a in p.args)
    return MISSING


def chooser(patterns: list[Pattern], scope: Scope) -> tuple[Callable[[list, Any], int], list[Scope]]:
    """The number of the first pattern that matches, -1 for none."""
    made = [matcher(p, scope) for p in patterns]
    tests = [t for t, _ in made]
    known = [constant(p) for p in patterns]
    fixed = 0
    while fixed < len(known) and known[fixed] is not MISSING:
        fixed += 1
    kinds = {type(k) for k in known[:fixed]}
    table = {k: i for i, k in reversed(list(enumerate(known[:fixed])))} if len(kinds) == 1 else None
    whole = kinds.pop() if table is not None else None

    def choose(fr: list, x: Any) -> int:
        low = 0
        if whole is not None and isinstance(x, whole) and (whole is not int or x is not True and x is not False):
            if (i := table.get(x, -1)) >= 0:
                return i
            low = fixed
        for i in range(low, len(tests)):
            if tests[i](fr, x):
                return i
        return -1

    return choose, [s for _, s in made]


def build(e: X.Expr, scope: Scope) -> Closure:
    op, a = e.op, e.args
    if op == "const":
        x = a[0]
        return lambda fr: x
    if op == "var":
        place = scope.places.get(a[0])
        if place is None:
            return _raising(f"no variable {a[0]}")
        return itemgetter(place)
    if op == "arith":
        f, x, y = ARITH[a[0]], build(a[1], scope), build(a[2], scope)
        if a[2].op == "const":
            k = a[2].args[0]
            return lambda fr: f(x(fr), k)
        return lambda fr: f(x(fr), y(fr))
    if op == "rel":
        f, x, y = REL[a[0]], build(a[1], scope), build(a[2], scope)
        return lambda fr: f(x(fr), y(fr))
    if op in ("and", "or"):  # both sides are evaluated
        x, y = build(a[0], scope), build(a[1], scope)
        if op == "and":
            return lambda fr: bool(x(fr)) & bool(y(fr))
        return lambda fr: bool(x(fr)) | bool(y(fr))
    if op == "not":
        x = build(a[0], scope)
        return lambda fr: not x(fr)
    if op in ("succ", "pred"):
        x, step = build(a[0], scope), 1 if op == "succ" else -1
        return lambda fr: as_kind(int(v := x(fr)) + step, v, v)
    if op in ("tuple", "seq"):
        parts = [build(x, scope) for x in a]
        return (lambda fr: tuple([p(fr) for p in parts])) if op == "tuple" else (lambda fr: [p(fr) for p in parts])
    if op == "record":
        names = [k for k, _ in a]
        if all(x.op == "var" and x.args[0] in scope.places for _, x in a):
            places = [scope.places[x.args[0]] for _, x in a]
            if len(places) == 1:
                name, place = names[0], places[0]
                return lambda fr: {name: fr[place]}
            get = itemgetter(*places) if places else lambda fr: ()
            return lambda fr: dict(zip(names, get(fr)))
        parts = [(k, build(x, scope)) for k, x in a]
        return lambda fr: {k: p(fr) for k, p in parts}
    if op == "field":
        x, name = build(a[0], scope), a[1]

        def field(fr: list) -> Any:
            v = x(fr)
            v = v.value if v.__class__ is Some else v
            try:
                return v[name]
            except (KeyError, IndexError, TypeError) as error:
                raise EvalError(f"no field {name}") from error

        return field
    if op == "variant":
        tag, x = a[0], build(a[1], scope)
        return lambda fr: Tagged(tag, x(fr))
    if op == "some":
        x = build(a[0], scope)
        return lambda fr: Some(x(fr))
    if op == "none":
        return lambda fr: None
    if op == "if":
        c, x, y = (build(v, scope) for v in a)
        return lambda fr: x(fr) if c(fr) else y(fr)
    if op == "match":
        x = build(a[0], scope)
        choose, scopes = chooser([p for p, _ in a[1]], scope)
        bodies = [build(body, s) for (_, body), s in zip(a[1], scopes)]

        def match(fr: list) -> Any:
            i = choose(fr, x(fr))
            if i < 0:
                raise EvalError("no case matches")
            return bodies[i](fr)

        return match
    if op == "cast":
        kind, x = a[0], build(a[1], scope)
        return lambda fr: Int(int(x(fr)), kind)
    if op == "as_char":
        x = build(a[0], scope)
        return lambda fr: chr(v) if (v := x(fr)) < 0xD800 or 0xE000 <= v < 0x110000 else "�"
    if op == "endian":
        kind, order, x = CLASSES[a[0]], a[1], build(a[2], scope)
        return lambda fr: int.__new__(kind, int.from_bytes(bytes(x(fr)), order))
    if op == "numeric" and a[0].op == "bits" and a[0].args[0].op == "var" and a[0].args[0].args[0] in scope.places:
        kind, place = CLASSES[a[0].rep], scope.places[a[0].args[0].args[0]]
        low, span = kind.low, kind.high - kind.low + 1
        return lambda fr: int.__new__(kind, (fr[place] - low) % span + low)
    if op == "seq_length":
        x, kind = build(a[0], scope), CLASSES["u32"]
        return lambda fr: int.__new__(kind, len(X._items(x(fr))) & 0xFFFFFFFF)
    if op == "seq_ix":
        x, at = build(a[0], scope), build(a[1], scope)

        def seq_ix(fr: list) -> Any:
            s, i = X._items(x(fr)), int(at(fr))
            if not 0 <= i < len(s):
                raise EvalError(f"index {i} of {len(s)}")
            return s[i]

        return seq_ix
    if op == "flat_map":
        x = build(a[1], scope)
        if a[0].body.op == "seq" and len(a[0].body.args) == 1:
            one = function(X.Lambda(a[0].names, a[0].body.args[0]), scope)
            return lambda fr: [one(fr, v) for v in X._items(x(fr))]
        f = function(a[0], scope)
        return lambda fr: [y for v in X._items(x(fr)) for y in f(fr, v)]
    if op == "flat_map_accum":
        f, start, x = function(a[0], scope), build(a[1], scope), build(a[2], scope)

        def accum(fr: list) -> list:
            acc, out = start(fr), []
            for v in X._items(x(fr)):
                acc, more = f(fr, acc, v)
                out.extend(more)
            return out

        return accum
    if op == "flat_map_list":
        f, x = function(a[0], scope), build(a[1], scope)

        def so_far(fr: list) -> list:
            out: list = []
            for v in X._items(x(fr)):
                out.extend(f(fr, out, v))
            return out

        return so_far
    if op == "left_fold":
        f, start, x = function(a[0], scope), build(a[1], scope), build(a[2], scope)

        def fold(fr: list) -> Any:
            acc = start(fr)
            for v in X._items(x(fr)):
                acc = f(fr, acc, v)
            return acc

        return fold
    if op == "find_by_key":
        is_sorted, f, wanted, x = a[0], function(a[1], scope), build(a[2], scope), build(a[3], scope)
        return lambda fr: X._found(is_sorted, lambda v: f(fr, v), wanted(fr), X._items(x(fr)))
    places = [(k, scope.places[k]) for k in sorted(free(e)) if k in scope.places]
    return lambda fr: X.value(e, {k: fr[i] for k, i in places})


def _raising(message: str) -> Closure:
    def run(fr: list) -> Any:
        raise EvalError(message)

    return run
