"""Byte sets and size intervals, the planner's arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

FULL = (1 << 256) - 1


@dataclass(frozen=True)
class ByteSet:
    """A set of byte values, as 256 bits of an integer."""

    bits: int = 0

    @classmethod
    def of(cls, members: Iterable[int]) -> ByteSet:
        bits = 0
        for b in members:
            if not 0 <= b < 256:
                raise ValueError(f"{b} is no byte")
            bits |= 1 << b
        return cls(bits)

    @classmethod
    def full(cls) -> ByteSet:
        return cls(FULL)

    def __contains__(self, b: int) -> bool:
        return bool(self.bits >> b & 1)

    def __or__(self, other: ByteSet) -> ByteSet:
        return ByteSet(self.bits | other.bits)

    def __and__(self, other: ByteSet) -> ByteSet:
        return ByteSet(self.bits & other.bits)

    def __sub__(self, other: ByteSet) -> ByteSet:
        return ByteSet(self.bits & ~other.bits)

    def __invert__(self) -> ByteSet:
        return ByteSet(self.bits ^ FULL)

    def __len__(self) -> int:
        return self.bits.bit_count()

    def __iter__(self) -> Iterator[int]:
        return (b for b in range(256) if self.bits >> b & 1)

    def min(self) -> int | None:
        return (self.bits & -self.bits).bit_length() - 1 if self.bits else None

    def max(self) -> int | None:
        return self.bits.bit_length() - 1 if self.bits else None

    def regex(self) -> str:
        """A character class over ISO 8859-1 text, for Spark's rlike and regexp functions."""
        out, low = [], None
        for b in range(257):
            here = b < 256 and b in self
            if here and low is None:
                low = b
            elif not here and low is not None:
                out.append(f"\\x{{{low:x}}}" if low == b - 1 else f"\\x{{{low:x}}}-\\x{{{b - 1:x}}}")
                low = None
        return f"[{''.join(out)}]" if out else "(?!)"


@dataclass(frozen=True)
class Bounds:
    """Sizes or unsigned values from `low` to `high`; no high: no upper bound."""

    low: int = 0
    high: int | None = None

    @classmethod
    def exactly(cls, n: int) -> Bounds:
        return cls(n, n)

    @property
    def exact(self) -> int | None:
        return self.low if self.low == self.high else None

    def __contains__(self, n: int) -> bool:
        return self.low <= n and (self.high is None or n <= self.high)

    def __add__(self, other: Bounds) -> Bounds:
        return Bounds(self.low + other.low, None if None in (self.high, other.high) else self.high + other.high)

    def __sub__(self, other: Bounds) -> Bounds:
        return Bounds(0 if other.high is None else max(0, self.low - other.high), None if self.high is None else max(0, self.high - other.low))

    def __mul__(self, other: Bounds) -> Bounds:
        high = 0 if 0 in (self.high, other.high) else None if None in (self.high, other.high) else self.high * other.high
        return Bounds(self.low * other.low, high)

    def __floordiv__(self, other: Bounds) -> Bounds:
        return Bounds(0 if other.high is None else self.low // max(1, other.high), None if self.high is None else self.high // max(1, other.low))

    def __mod__(self, other: Bounds) -> Bounds:
        if self.exact is not None and other.exact:
            return Bounds.exactly(self.low % other.low)
        tops = [x for x in (self.high, None if other.high is None else max(0, other.high - 1)) if x is not None]
        return Bounds(0, min(tops, default=None))

    def __lshift__(self, other: Bounds) -> Bounds:
        return Bounds(self.low << other.low, None if None in (self.high, other.high) else self.high << other.high)

    def __rshift__(self, other: Bounds) -> Bounds:
        return Bounds(0 if other.high is None else self.low >> other.high, None if self.high is None else self.high >> other.low)

    def __and__(self, other: Bounds) -> Bounds:
        tops = [x for x in (self.high, other.high) if x is not None]
        return Bounds.exactly(self.low & other.low) if None not in (self.exact, other.exact) else Bounds(0, min(tops, default=None))

    def __or__(self, other: Bounds) -> Bounds:
        """Of bitwise or."""
        high = None if None in (self.high, other.high) else (1 << max(self.high.bit_length(), other.high.bit_length())) - 1
        return Bounds.exactly(self.low | other.low) if None not in (self.exact, other.exact) else Bounds(max(self.low, other.low), high)

    def union(self, other: Bounds) -> Bounds:
        return Bounds(min(self.low, other.low), None if None in (self.high, other.high) else max(self.high, other.high))

    def clamp(self, other: Bounds) -> Bounds:
        low = max(self.low, other.low)
        tops = [x for x in (self.high, other.high) if x is not None]
        return Bounds(low, None if not tops else max(low, min(tops)))

    def bytes_of_bits(self) -> Bounds:
        return Bounds(-(-self.low // 8), None if self.high is None else -(-self.high // 8))
