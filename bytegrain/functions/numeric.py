"""Arbitrary-precision integer trees with representations that are given, agreed or solved."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import RANGES, EvalError, Int

AUTO = "auto"


@dataclass(frozen=True)
class Tree:
    """op: const, var, add, sub, mul, div, rem, neg, abs, succ, pred, cast, bits. rep: the result's representation, or auto."""

    op: str
    args: tuple
    rep: str = AUTO


def const(n: int, rep: str = AUTO) -> Tree: return Tree("const", (n,), rep)
def var(name: str, rep: str = AUTO) -> Tree: return Tree("var", (name,), rep)
def binary(op: str, a: Tree, b: Tree, rep: str = AUTO) -> Tree: return Tree(op, (a, b), rep)
def unary(op: str, a: Tree, rep: str = AUTO) -> Tree: return Tree(op, (a,), rep)
def cast(a: Tree, rep: str) -> Tree: return Tree("cast", (a,), rep)
def cast_bits(a: Tree, rep: str) -> Tree: return Tree("bits", (a,), rep)


def representation(t: Tree) -> str:
    """Given, or common to the parts; auto gives way. Parts that disagree are ambiguous."""
    if t.rep != AUTO:
        return t.rep
    kinds = {representation(x) for x in t.args if isinstance(x, Tree)} - {AUTO}
    if len(kinds) > 1:
        raise EvalError(f"ambiguous: {sorted(kinds)}")
    return kinds.pop() if kinds else AUTO


def exact(t: Tree, env: dict[str, Any], seen: list | None = None) -> int:
    """The mathematical value; seen gets (value, representation) of every part."""
    parts = [exact(x, env, seen) if isinstance(x, Tree) else x for x in t.args]
    rep = representation(t)
    if t.op == "const":
        out = parts[0]
    elif t.op == "var":
        out = int(env[parts[0]])
    elif t.op in ("div", "rem"):
        a, b = parts
        if b == 0 or t.op == "rem" and b < 0:
            raise EvalError("division by zero" if b == 0 else "remainder by a negative divisor")
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        out = q if t.op == "div" else a - q * b
    elif t.op == "bits":
        low, high = RANGES[rep]
        out = (parts[0] - low) % (high - low + 1) + low
    else:
        out = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "neg": lambda a: -a, "abs": abs, "succ": lambda a: a + 1, "pred": lambda a: a - 1, "cast": lambda a: a}[t.op](*parts)
    if seen is not None:
        seen.append((out, rep))
    return out


def evaluate(t: Tree, env: dict[str, Any], strict: bool = False) -> int:
    """The value in its representation. strict: every part must fit its own too."""
    seen: list[tuple[int, str]] = []
    out, rep = exact(t, env, seen), representation(t)
    if strict:
        for x, kind in seen:
            if kind != AUTO and not RANGES[kind][0] <= x <= RANGES[kind][1]:
                raise EvalError(f"{x} is no {kind}")
    return out if rep == AUTO else Int(out, rep)


def column(t: Tree, env: dict[str, Column]) -> Column:
    """The same over DECIMAL(38,0); null where the value does not fit its representation."""
    wide = "decimal(38,0)"
    parts = [column(x, env) if isinstance(x, Tree) else x for x in t.args]
    if t.op == "const":
        out = F.lit(str(parts[0])).cast(wide)
    elif t.op == "var":
        out = (env[parts[0]] if parts[0] in env else F.col(parts[0])).cast(wide)
    elif t.op == "bits":
        low, high = RANGES[t.rep]
        span, base = F.lit(str(high - low + 1)).cast(wide), F.lit(str(low)).cast(wide)
        out = F.pmod(parts[0] - base, span) + base
    elif t.op == "div":
        out = F.when(parts[1] != 0, F.try_divide(parts[0] - parts[0] % parts[1], parts[1]))
    elif t.op == "rem":
        out = F.when(parts[1] > 0, parts[0] % parts[1])
    else:
        make = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply, "neg": lambda a: -a, "abs": F.abs, "succ": lambda a: a + 1, "pred": lambda a: a - 1, "cast": lambda a: a}
        out = make[t.op](*parts)
    out = out.cast(wide)
    rep = representation(t)
    if rep == AUTO:
        return out
    low, high = RANGES[rep]
    return F.when((out >= F.lit(str(low)).cast(wide)) & (out <= F.lit(str(high)).cast(wide)), out)
