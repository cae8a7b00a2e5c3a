"""Patterns: tests with bindings, on Python values and on columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Some, Tagged, kind_of


@dataclass(frozen=True)
class Pattern:
    """kind: binding, wildcard, bool, int (with a representation or none), between, char, tuple, variant, seq, option."""

    kind: str
    args: tuple = ()

    def match(self, x: Any) -> dict | None:
        """Bindings, or None."""
        k, a = self.kind, self.args
        if k == "binding":
            return {a[0]: x}
        if k == "wildcard":
            return {}
        if k in ("bool", "char"):
            return {} if type(x) is type(a[0]) and x == a[0] else None
        if k == "int":
            return {} if isinstance(x, int) and not isinstance(x, bool) and x == a[0] and a[1] in (None, kind_of(x)) else None
        if k == "between":
            return {} if isinstance(x, int) and a[0] <= x and (a[1] is None or x <= a[1]) else None
        if k in ("tuple", "seq"):
            if not isinstance(x, (tuple, list, bytes, range)) or len(x) != len(a):
                return None
            out: dict = {}
            for p, y in zip(a, x):
                if (found := p.match(y)) is None:
                    return None
                out |= found
            return out
        if k == "variant":
            return a[1].match(x.value) if isinstance(x, Tagged) and x.tag == a[0] else None
        if k == "option":
            return ({} if x is None else None) if a[0] is None else a[0].match(x.value) if isinstance(x, Some) else None
        raise ValueError(k)

    def column(self, x: Column, kind: str | None = None) -> tuple[Column, dict[str, Column]]:
        """The test, and the bindings as columns. kind: the representation of x, where it is known; a literal of another does not match."""
        k, a = self.kind, self.args
        if k == "int" and a[1] is not None and kind is not None and a[1] != kind:
            return F.lit(False), {}
        if k == "binding":
            return F.lit(True), {a[0]: x}
        if k == "wildcard":
            return F.lit(True), {}
        if k in ("bool", "char", "int"):
            return x == F.lit(a[0]), {}
        if k == "between":
            return (x >= a[0]) if a[1] is None else x.between(a[0], a[1]), {}
        if k in ("tuple", "seq"):
            test, bound = (F.size(x) == len(a)) if k == "seq" else F.lit(True), {}
            for i, p in enumerate(a):
                t, more = p.column(F.get(x, F.lit(i)) if k == "seq" else x.getField(f"_{i}"))
                test, bound = test & t, bound | more
            return test, bound
        if k == "variant":
            t, bound = a[1].column(x.getField(a[0]))
            return (x.getField("tag") == a[0]) & t, bound
        if a[0] is None:
            return x.isNull(), {}
        t, bound = a[0].column(x)
        return x.isNotNull() & t, bound


def binding(name: str) -> Pattern: return Pattern("binding", (name,))
def wildcard() -> Pattern: return Pattern("wildcard")
def boolean(b: bool) -> Pattern: return Pattern("bool", (b,))
def integer(n: int, kind: str | None = None) -> Pattern: return Pattern("int", (n, kind))
def between(low: int, high: int | None = None) -> Pattern: return Pattern("between", (low, high))
def char(c: str) -> Pattern: return Pattern("char", (c,))
def tuple_of(*parts: Pattern) -> Pattern: return Pattern("tuple", parts)
def variant(tag: str, part: Pattern) -> Pattern: return Pattern("variant", (tag, part))
def seq(*parts: Pattern) -> Pattern: return Pattern("seq", parts)
def byte_string(raw: bytes) -> Pattern: return Pattern("seq", tuple(integer(b) for b in raw))
def absent() -> Pattern: return Pattern("option", (None,))
def present(part: Pattern) -> Pattern: return Pattern("option", (part,))
