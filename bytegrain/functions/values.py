"""Values of decoded data: sized integers, tagged variants, options, and the errors of decoding."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Fixed: the integer representations and their inclusive ranges.
RANGES = {f"{'u' if unsigned else 'i'}{bits}": (0, 2**bits - 1) if unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) for unsigned in (True, False) for bits in (8, 16, 32, 64)}


class DecodeError(Exception):
    """A hard error: kind is one of Fail, BadWhere, Trailing, Overrun, Overbyte, SeekPastEnd, Unexpected, NoValidBranch, eval."""

    def __init__(self, kind: str, offset: int | None = None, message: str = ""):
        super().__init__(f"{kind} at {offset}: {message}")
        self.kind, self.offset, self.message = kind, offset, message


class EvalError(DecodeError):
    """An expression without a value: overflow, a failed cast, an index out of range, a match without a case."""

    def __init__(self, message: str):
        super().__init__("eval", None, message)


class Int(int):
    """An integer with a representation; plain ints take on that of the other operand. Each representation has a class of its own."""

    kind: str
    low: int
    high: int

    def __new__(cls, value: int, kind: str):
        own = CLASSES[kind]
        if own.low <= value <= own.high:
            return int.__new__(own, value)
        raise EvalError(f"{value} is no {kind}")

    def __reduce__(self):
        return (Int, (int(self), self.kind))


CLASSES: dict[str, type[Int]] = {kind: type(kind.upper(), (Int,), {"kind": kind, "low": low, "high": high}) for kind, (low, high) in RANGES.items()}
#: The 256 values of a byte.
BYTES = [Int(b, "u8") for b in range(256)]


def kind_of(x: Any) -> str | None:
    return x.kind if isinstance(x, Int) else None


def sized(value: int, *operands: Any) -> int:
    """The value in the operands' common representation; no widening is implied."""
    kinds = {k for k in map(kind_of, operands) if k}
    if len(kinds) > 1:
        raise EvalError(f"mixed representations {sorted(kinds)}")
    return Int(value, kinds.pop()) if kinds else value


class Tagged:
    """A value of a sum type."""

    __slots__ = ("tag", "value")

    def __init__(self, tag: str, value: Any):
        self.tag, self.value = tag, value

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Tagged) and self.tag == other.tag and self.value == other.value

    def __hash__(self) -> int:
        return hash((self.tag, self.value))

    def __repr__(self) -> str:
        return f"Tagged({self.tag!r}, {self.value!r})"


class Some:
    """A value that is there."""

    __slots__ = ("value",)

    def __init__(self, value: Any):
        self.value = value

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Some) and self.value == other.value

    def __hash__(self) -> int:
        return hash(("some", self.value))

    def __repr__(self) -> str:
        return f"Some({self.value!r})"


@dataclass(frozen=True)
class View:
    """A place in a buffer, for reads relative to it."""

    data: Any
    offset: int
    limit: int


def plain(value: Any) -> Any:
    """The value as Python data that JSON can hold: {tag, data} for variants, null or the value for options, lists for sequences of bytes."""
    if isinstance(value, Tagged):
        return {"tag": value.tag, "data": plain(value.value)}
    if isinstance(value, Some):
        return plain(value.value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, bytes):
        return list(value)
    if isinstance(value, (list, tuple, range)):
        return [plain(v) for v in value]
    if isinstance(value, View):
        return {"offset": value.offset}
    return int(value) if isinstance(value, Int) else value
