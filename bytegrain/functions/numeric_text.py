"""The numeric model as text, and what is known of a tree before it is evaluated.

    x + 1u8        names, numbers with or without a representation; + - * / %, `abs`, `~` (negation), parentheses
    (a * b) as u16     checked cast;   a as? i8     the low bits alone
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from . import numeric as M
from .values import RANGES, EvalError, Int

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+)(?P<rep>[ui](?:8|16|32|64))?|(?P<word>[A-Za-z_]\w*)|(?P<sign>as\?|[-+*/%~()?]))")
_LEVELS = ({"+": "add", "-": "sub"}, {"*": "mul", "/": "div", "%": "rem"})


@dataclass
class _Reader:
    text: str
    at: int = 0

    def peek(self) -> re.Match | None:
        found = _TOKEN.match(self.text, self.at)
        if found is None and self.text[self.at :].strip():
            raise ValueError(f"unexpected {self.text[self.at:].strip()[:10]!r} at {self.at}")
        return found

    def take(self, wanted: str | None = None) -> re.Match:
        found = self.peek()
        if found is None or wanted is not None and found[0].strip() != wanted:
            raise ValueError(f"expected {wanted or 'more'} at {self.at}")
        self.at = found.end()
        return found

    def next_is(self, *signs: str) -> str | None:
        found = self.peek()
        return found[0].strip() if found and found[0].strip() in signs else None


def parse(text: str) -> M.Tree:
    r = _Reader(text)
    out = _sum(r, 0)
    if r.peek() is not None:
        raise ValueError(f"unexpected {r.peek()[0].strip()!r} at {r.at}")
    return out


def _sum(r: _Reader, level: int) -> M.Tree:
    if level == len(_LEVELS):
        return _cast(r)
    out = _sum(r, level + 1)
    while sign := r.next_is(*_LEVELS[level]):
        r.take()
        out = M.binary(_LEVELS[level][sign], out, _sum(r, level + 1))
    return out


def _cast(r: _Reader) -> M.Tree:
    out = _unary(r)
    while r.next_is("as"):
        r.take()
        bits = r.next_is("?") is not None
        if bits:
            r.take()
        rep = r.take()[0].strip()
        if rep not in RANGES:
            raise ValueError(f"no representation {rep}")
        out = M.cast_bits(out, rep) if bits else M.cast(out, rep)
    return out


def _unary(r: _Reader) -> M.Tree:
    if r.next_is("~"):
        r.take()
        return M.unary("neg", _unary(r))
    if r.next_is("abs"):
        r.take()
        return M.unary("abs", _unary(r))
    if r.next_is("("):
        r.take()
        out = _sum(r, 0)
        r.take(")")
        return out
    found = r.take()
    if found["number"]:
        return M.const(int(found["number"]), found["rep"] or M.AUTO)
    if found["word"] and found["word"] != "as":
        return M.var(found["word"])
    raise ValueError(f"unexpected {found[0].strip()!r} at {found.start()}")


def shown(t: M.Tree) -> str:
    """The text of a tree; parsed again it is the same."""
    parts = [shown(x) if isinstance(x, M.Tree) else str(x) for x in t.args]
    signs = {name: sign for level in _LEVELS for sign, name in level.items()}
    if t.op in signs:
        return f"({parts[0]} {signs[t.op]} {parts[1]})"
    if t.op in ("cast", "bits"):
        return f"({parts[0]} as{'?' if t.op == 'bits' else ''} {t.rep})"
    if t.op in ("neg", "abs"):
        return f"{'~' if t.op == 'neg' else 'abs '}{parts[0]}"
    return parts[0] + (t.rep if t.op == "const" and t.rep != M.AUTO else "")


def elaborated(t: M.Tree, kinds: dict[str, str], default: str | None = None) -> M.Tree:
    """The tree with a representation at every part: those of variables, those that parts agree on, and for parts that are free that of
    what they stand in (default: at the top). Parts that disagree, or that nothing decides, are an error."""

    def up(x: M.Tree) -> M.Tree:
        parts = tuple(up(p) if isinstance(p, M.Tree) else p for p in x.args)
        rep = x.rep
        if x.op == "var" and rep == M.AUTO:
            rep = kinds.get(x.args[0], M.AUTO)
        elif rep == M.AUTO:
            found = {p.rep for p in parts if isinstance(p, M.Tree)} - {M.AUTO}
            if len(found) > 1:
                raise EvalError(f"ambiguous: {sorted(found)}")
            rep = found.pop() if found else M.AUTO
        return replace(x, args=parts, rep=rep)

    def down(x: M.Tree, wanted: str | None) -> M.Tree:
        rep = x.rep if x.rep != M.AUTO else wanted
        if rep is None:
            raise EvalError(f"nothing decides the representation of {shown(x)}")
        inner = None if x.op in ("cast", "bits") else rep
        return replace(x, args=tuple(down(p, inner or (p.rep if p.rep != M.AUTO else rep)) if isinstance(p, M.Tree) else p for p in x.args), rep=rep)

    return down(up(t), default)


def primitives(t: M.Tree) -> list[str]:
    """The names of the typed operations of an elaborated tree, innermost first, such as add_u8 or cast_u16_i8."""
    out = [name for p in t.args if isinstance(p, M.Tree) for name in primitives(p)]
    if t.op in ("const", "var"):
        return out
    return [*out, f"{t.op}_{t.args[0].rep}_{t.rep}" if t.op in ("cast", "bits") else f"{t.op}_{t.rep}"]


def evaluate_within(t: M.Tree, env: dict[str, Any]) -> tuple[int, bool]:
    """The value of an elaborated tree, and whether every part fitted its width; as long as parts do, they are numbers of their widths,
    and only beyond are they unbounded."""
    parts, narrow = [], True
    for p in t.args:
        value, fits = evaluate_within(p, env) if isinstance(p, M.Tree) else (p, True)
        parts.append(value)
        narrow &= fits
    if t.op == "var":
        out = int(env[parts[0]])
    elif t.op == "const":
        out = parts[0]
    else:
        made = tuple(M.const(int(v)) if isinstance(p, M.Tree) else p for p, v in zip(t.args, parts))
        out = M.exact(replace(t, args=made), {})
    low, high = RANGES[t.rep]
    return (Int(out, t.rep), narrow) if low <= out <= high else (out, False)
