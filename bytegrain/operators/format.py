"""Formats: descriptions of binary data, and the program that decodes a buffer by one.

A format is a tree of nodes. `decode(fmt, data)` gives the value and the warnings or raises a DecodeError. What can be known without data is
known before: how many bytes a format takes, whether it can take none, and which bytes it can begin with, so that a choice that no
byte ahead can decide is refused when it is made.

A tree is built once into closures over a frame, a list in which every name has its place. Runs of single bytes, literals and numbers are
taken from the buffer in one step instead of byte by byte.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions import expr as X
from ..functions.closures import MISSING, Scope, build, chooser, free, function
from ..functions.sets import FULL, Bounds, ByteSet
from ..functions.values import BYTES, CLASSES, DecodeError, Int, Some, Tagged, View

#: Bytes that a repetition looks ahead; those that a deterministic choice tries, shortest first; sequences of byte sets that are told apart
#: (beyond, a branch counts as beginning with anything); bytes of a negative look-ahead.
AHEAD_BYTES, AHEAD_STEPS, AHEAD_WAYS, NOT_AHEAD_BYTES = 12, (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 80), 256, 1024
ANYTHING = frozenset({((), False)})


class Bits:
    """The bits of bytes from a place on, lowest first, read one by one."""

    def __init__(self, data: bytes, start: int, limit: int):
        self.data, self.start, self.size = data, start, 8 * (limit - start)

    def __len__(self) -> int:
        return self.size

    def window(self, pos: int) -> int:
        """16 bits or more from a place on; zeros beyond the end."""
        at = self.start + (pos >> 3)
        return int.from_bytes(self.data[at : at + 4], "little") >> (pos & 7)

    def number(self, pos: int, n: int) -> int:
        """n bits, the lowest first."""
        at = self.start + (pos >> 3)
        return int.from_bytes(self.data[at : at + (n + 14 >> 3)], "little") >> (pos & 7) & ((1 << n) - 1)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return bytes(self[k] for k in range(*i.indices(self.size)))
        return self.data[self.start + (i >> 3)] >> (i & 7) & 1


@dataclass
class State:
    """What a decode shares: the buffer, its end, and the warnings so far. spans: gets (path, start, stop) of every named field of the buffer,
    where it is a list; path: the names that lead to the field that is being read."""

    data: Any
    limit: int
    warnings: list = field(default_factory=list)
    spans: list | None = None
    path: list = field(default_factory=list)


#: A built format: of the state, a place and the frame it makes the value and the place after it.
Step = Callable[[State, int, list], tuple[Any, int]]


class Format:
    """A node. Subclasses say how they are built, how many bytes they take and what they can begin with."""

    parts: tuple[Format, ...] = ()

    def build(self, scope: Scope, bits: bool) -> Step:
        """bits: the buffer is one of single bits, of which no bytes can be taken at once."""
        raise NotImplementedError

    def parse(self, s: State, pos: int, env: dict) -> tuple[Any, int]:
        """The value and the place after it, where the names of env have its values."""
        made = self.__dict__.setdefault("_programs", {})
        names = tuple(env)
        if names not in made:
            scope, at = Scope().inner(*names)
            made[names] = self.build(scope, isinstance(s.data, Bits)), at, scope.counter
        step, at, counter = made[names]
        frame = [MISSING] * (counter[0] + 1)
        for place, v in zip(at, env.values()):
            frame[place] = v
        return step(s, pos, frame)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_programs"}

    def size(self) -> Bounds:
        return Bounds()

    def ahead(self, n: int) -> frozenset:
        """Pairs of byte sets (as bits) that the next bytes lie in, and whether the format may go on after them; n bytes at most."""
        return ANYTHING

    def census(self) -> set[str]:
        return {type(self).__name__}.union(*(p.census() for p in self.parts))


def _joined(first: frozenset, rest: Callable[[int], frozenset], n: int) -> frozenset:
    out = set()
    for seq, more in first:
        if more or len(seq) >= n:
            out.add((seq[:n], True))
        else:
            for tail, goes_on in rest(n - len(seq)):
                out.add(((seq + tail)[:n], goes_on))
    return frozenset(out) if len(out) <= AHEAD_WAYS else ANYTHING_MORE


ANYTHING_MORE = frozenset({((), True)})


def overlap(a: frozenset, b: frozenset) -> bool:
    return any(all(x & y for x, y in zip(p, q)) for p, _ in a for q, _ in b)


@dataclass
class Fail(Format):
    def build(self, scope, bits):
        def run(s, pos, fr):
            raise DecodeError("Fail", pos)

        return run

    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset()


@dataclass
class EndOfInput(Format):
    def build(self, scope, bits):
        def run(s, pos, fr):
            if pos < s.limit:
                raise DecodeError("Trailing", pos, f"{s.limit - pos} bytes left")
            return None, pos

        return run

    def size(self): return Bounds.exactly(0)


@dataclass
class Byte(Format):
    members: ByteSet

    def build(self, scope, bits):
        table = [BYTES[b] if b in self.members else None for b in range(256)]

        def run(s, pos, fr):
            if pos >= s.limit:
                raise DecodeError("Overbyte", pos, "no byte left")
            b = table[s.data[pos]]
            if b is None:
                raise unexpected(s, pos)
            return b, pos + 1

        return run

    def size(self): return Bounds.exactly(1)
    def ahead(self, n): return frozenset({((self.members.bits,), False)}) if n else ANYTHING_MORE


@dataclass
class Align(Format):
    n: int

    def build(self, scope, bits):
        n = self.n

        def run(s, pos, fr):
            to = pos + -pos % n
            if to > s.limit:
                raise DecodeError("Overrun", pos, f"align {n}")
            return None, to

        return run

    def size(self): return Bounds(0, self.n - 1)
    def ahead(self, n): return frozenset({((), False)}) if self.n == 1 else ANYTHING_MORE


@dataclass
class Variant(Format):
    tag: str
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        tag, part = self.tag, self.part.build(scope, bits)

        def run(s, pos, fr):
            v, pos = part(s, pos, fr)
            return Tagged(tag, v), pos

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


class AmbiguousChoice(ValueError):
    """No byte ahead tells two branches of a deterministic choice apart."""


@dataclass
class Union(Format):
    branches: tuple[Format, ...]

    def __post_init__(self):
        self.parts = tuple(self.branches)
        for n in AHEAD_STEPS:  # no further than needed
            self.known = [b.ahead(n) for b in self.parts]
            clash = next(((j, i) for i, a in enumerate(self.known) for j in range(i) if overlap(a, self.known[j])), None)
            if clash is None:
                return
        raise AmbiguousChoice("branches {} and {}".format(*clash))

    def build(self, scope, bits):
        parts = [p.build(scope, bits) for p in self.parts]
        known = [(i, q) for i, ways in enumerate(self.known) for q, _ in ways]
        empty = next((i for i, q in known if not q), None)
        table = [[(i, q[1:]) for i, q in known if q and q[0] >> b & 1] for b in range(256)]
        #: the branch where one byte decides, else what must be looked at further
        first = [(x[0][0] if len(x) == 1 and not x[0][1] else -1) for x in table]

        def run(s, pos, fr):
            if pos < s.limit:
                b = s.data[pos]
                i = first[b]
                if i >= 0:
                    return parts[i](s, pos, fr)
                left, data, at = s.limit - pos - 1, s.data, pos + 1
                for i, q in table[b]:
                    if len(q) <= left and fits(data, at, q):
                        return parts[i](s, pos, fr)
            if empty is None:
                raise DecodeError("NoValidBranch", pos)
            return parts[empty](s, pos, fr)

        return run

    def size(self):
        sizes = [p.size() for p in self.parts]
        out = sizes[0] if sizes else Bounds.exactly(0)
        for x in sizes[1:]:
            out = out.union(x)
        return out

    def ahead(self, n):
        out = frozenset().union(*(p.ahead(n) for p in self.parts))
        return out if len(out) <= AHEAD_WAYS else ANYTHING_MORE


@dataclass
class UnionNondet(Format):
    """Branches in order; the first that succeeds counts, and is not gone back on."""

    branches: tuple[Format, ...]

    def __post_init__(self): self.parts = tuple(self.branches)
    def build(self, scope, bits):
        parts = [p.build(scope, bits) for p in self.parts]

        def run(s, pos, fr):
            kept, limit = len(s.warnings), s.limit
            for p in parts:
                try:
                    return p(s, pos, fr)
                except DecodeError:
                    del s.warnings[kept:]
                    s.limit = limit
            raise DecodeError("NoValidBranch", pos)

        return run

    def size(self): return Union.size(self)
    def ahead(self, n): return Union.ahead(self, n)


@dataclass
class Tuple(Format):
    items: tuple[Format, ...]
    as_list: bool = False

    def __post_init__(self): self.parts = tuple(self.items)
    def literal(self) -> bytes | None:
        """The only bytes that the items can be, where each of them is a byte of one value."""
        one = self.as_list and self.parts and all(isinstance(p, Byte) and len(p.members) == 1 for p in self.parts)
        return bytes(p.members.min() for p in self.parts) if one else None

    def build(self, scope, bits):
        parts, raw, as_list = [p.build(scope, bits) for p in self.parts], None if bits else self.literal(), self.as_list
        n = len(parts)

        def run(s, pos, fr):
            out = []
            for p in parts:
                v, pos = p(s, pos, fr)
                out.append(v)
            return (_collapsed(out) if as_list else tuple(out)), pos

        def whole(s, pos, fr):
            if s.data.startswith(raw, pos, s.limit):
                return raw, pos + n
            return run(s, pos, fr)  # finds the byte that differs

        return run if raw is None else whole

    def size(self): return sum((p.size() for p in self.parts), Bounds.exactly(0))
    def ahead(self, n):
        out = frozenset({((), False)})
        for p in self.parts:
            out = _joined(out, p.ahead, n)
        return out


def _collapsed(items: list) -> Any:
    """A sequence of u8 is bytes."""
    return bytes(items) if items and all(isinstance(x, Int) and x.kind == "u8" for x in items) else items


@dataclass
class Repeat(Format):
    """low to high times, greedy: goes on while the bytes ahead fit the part. count: a number from an expression instead."""

    part: Format
    low: int = 0
    high: int | None = None
    count: X.Expr | None = None

    def __post_init__(self):
        self.parts = (self.part,)
        self.known = self.part.ahead(AHEAD_BYTES)
        if self.count is None and self.high is None and self.part.size().low == 0 and not isinstance(self.part, Fail):
            raise ValueError("a repeated format must take a byte at least")

    def build(self, scope, bits):
        if self.count is not None:
            return self._counted(scope, bits)
        part, low, high = self.part.build(scope, bits), self.low, self.high
        ways = [q for q, _ in self.known]
        short = [any(len(q) < 2 and (not q or q[0] >> b & 1) for q in ways) for b in range(256)]
        long = [[q[1:] for q in ways if len(q) > 1 and q[0] >> b & 1] for b in range(256)]
        table = None if bits else singles(self.part)
        run_of = None if table is None else re.compile(pattern_of(table) + (b"*" if high is None else b"{0,%d}" % high))
        if isinstance(self.part, Byte) and not bits:

            def raw(s, pos, fr):
                end = run_of.match(s.data, pos, s.limit).end()
                if end - pos < low:
                    raise DecodeError("Overbyte", end, "no byte left") if end >= s.limit else unexpected(s, end)
                return (s.data[pos:end] if end > pos else []), end

            return raw
        bulk = run_of is not None and high is None

        def run(s, pos, fr):
            out: list = []
            data, limit = s.data, s.limit
            while high is None or len(out) < high:
                if bulk:
                    end = run_of.match(data, pos, limit).end()
                    if end > pos:
                        out += [table[b] for b in data[pos:end]]
                        pos = end
                if len(out) >= low:
                    if pos >= limit:
                        break
                    b = data[pos]
                    if not short[b] and not any(len(q) < limit - pos and fits(data, pos + 1, q) for q in long[b]):
                        break
                v, pos = part(s, pos, fr)
                out.append(v)
            return _collapsed(out), pos

        return run

    def _counted(self, scope: Scope, bits: bool) -> Step:
        count, part = build(self.count, scope), self.part.build(scope, bits)
        members = self.part.members if isinstance(self.part, Byte) and not bits else None
        others = None if members is None or members.bits == FULL else bytes(members)

        def number(fr, pos):
            n = int(count(fr))
            if n < 0:
                raise DecodeError("eval", pos, f"{n} times")
            return n

        def run(s, pos, fr):
            out: list = []
            for _ in range(number(fr, pos)):
                v, pos = part(s, pos, fr)
                out.append(v)
            return _collapsed(out), pos

        def raw(s, pos, fr):
            n = number(fr, pos)
            end = pos + n
            if others is None:
                if end > s.limit:
                    raise DecodeError("Overrun", pos, f"{n} bytes of {s.limit - pos}")
                return s.data[pos:end], end
            found = s.data[pos : min(end, s.limit)]
            if len(found) == n and not found.translate(None, others):
                return found or [], end
            bad = next((k for k, b in enumerate(found) if b not in members), None)
            raise DecodeError("Overbyte", s.limit, "no byte left") if bad is None else unexpected(s, pos + bad)

        def same(s, pos, fr):  # of what takes no bytes and depends on no place
            n = number(fr, pos)
            return (_collapsed([part(s, pos, fr)[0]] * n) if n else []), pos

        return raw if members is not None else same if isinstance(self.part, Compute) else run

    def size(self):
        if self.count is not None:
            n = X.value(self.count, {}) if self.count.op == "const" else None
            return self.part.size() * (Bounds.exactly(int(n)) if n is not None else Bounds())
        return self.part.size() * Bounds(self.low, self.high)

    def ahead(self, n):
        if self.count is not None and self.count.op != "const":
            return ANYTHING_MORE
        low = int(self.count.args[0]) if self.count is not None else self.low
        out = frozenset({((), False)})
        for _ in range(min(low, n)):
            out = _joined(out, self.part.ahead, n)
        return out if self.count is not None or self.high == low else frozenset((q, True) for q, _ in out)


@dataclass
class RepeatWhile(Format):
    """As often as the part succeeds and moves on."""

    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part = self.part.build(scope, bits)

        def run(s, pos, fr):
            out: list = []
            limit = s.limit
            while pos < limit:
                kept = len(s.warnings)
                try:
                    v, to = part(s, pos, fr)
                except DecodeError:
                    del s.warnings[kept:]
                    s.limit = limit
                    break
                if to == pos:
                    break
                out.append(v)
                pos = to
            return _collapsed(out), pos

        return run

    def ahead(self, n): return ANYTHING_MORE


@dataclass
class RepeatUntil(Format):
    """Appends, then stops when the test holds: of the last element, or (whole) of all so far."""

    test: X.Lambda
    part: Format
    whole: bool = False

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part, test, whole = self.part.build(scope, bits), function(self.test, scope), self.whole
        if isinstance(self.part, Byte) and not whole and not bits and free(self.test) <= set(self.test.names):
            try:
                stops = bytes(b for b in self.part.members if X.apply(self.test, {}, BYTES[b]))
                return self._bytes(stops)
            except DecodeError:
                pass

        def run(s, pos, fr):
            out: list = []
            while True:
                v, pos = part(s, pos, fr)
                out.append(v)
                if test(fr, _collapsed(out) if whole else v):
                    return _collapsed(out), pos

        return run

    def _bytes(self, stops: bytes) -> Step:
        """Of single bytes, where the test says of each alone whether it is the last."""
        members = self.part.members
        goes_on = re.compile(pattern_of([b in members and b not in stops or MISSING for b in range(256)]) + b"*")

        def run(s, pos, fr):
            end = goes_on.match(s.data, pos, s.limit).end()
            if end >= s.limit:
                raise DecodeError("Overbyte", end, "no byte left")
            if s.data[end] not in members:
                raise unexpected(s, end)
            return s.data[pos : end + 1], end + 1

        return run

    def size(self): return Bounds(self.part.size().low, None)


@dataclass
class AccumUntil(Format):
    """Tests the accumulator before each element; gives (accumulator, elements)."""

    done: X.Lambda
    update: X.Lambda
    start: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        start, part, done, update = build(self.start, scope), self.part.build(scope, bits), function(self.done, scope), function(self.update, scope)
        looks = self.done.names[1] in free(self.done)  # else the elements so far need not be gathered for the test

        def run(s, pos, fr):
            acc, out = start(fr), []
            while not done(fr, acc, _collapsed(out) if looks else out):
                v, pos = part(s, pos, fr)
                out.append(v)
                acc = update(fr, acc, v)
            return (acc, _collapsed(out)), pos

        return run


@dataclass
class ForEach(Format):
    items: X.Expr
    name: str
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        items = build(self.items, scope)
        own, (at,) = scope.inner(self.name)
        part = self.part.build(own, bits)

        def run(s, pos, fr):
            out = []
            for x in items(fr):
                fr[at] = x
                v, pos = part(s, pos, fr)
                out.append(v)
            return _collapsed(out), pos

        return run


@dataclass
class Maybe(Format):
    test: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        test, part = build(self.test, scope), self.part.build(scope, bits)

        def run(s, pos, fr):
            if not test(fr):
                return None, pos
            v, pos = part(s, pos, fr)
            return Some(v), pos

        return run

    def size(self): return self.part.size().union(Bounds.exactly(0))


@dataclass
class Peek(Format):
    part: Format
    negative: bool = False

    def __post_init__(self):
        self.parts = (self.part,)
        high = self.part.size().high
        if self.negative and (high is None or high > NOT_AHEAD_BYTES):
            raise ValueError("a negative look-ahead must be bounded")

    def build(self, scope, bits):
        part = self.part.build(scope, bits)

        def without(s, pos, fr):
            kept, limit = len(s.warnings), s.limit
            try:
                part(s, pos, fr)
            except DecodeError:
                del s.warnings[kept:]
                s.limit = limit
                return None, pos
            raise DecodeError("Unexpected", pos, "excluded")

        return without if self.negative else lambda s, pos, fr: (part(s, pos, fr)[0], pos)

    def size(self): return Bounds.exactly(0)


@dataclass
class Slice(Format):
    n: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        size, part = build(self.n, scope), self.part.build(scope, bits)

        def run(s, pos, fr):
            limit, end = s.limit, pos + int(size(fr))
            if not pos <= end <= limit:
                raise DecodeError("Overrun", pos, f"slice to {end} of {limit}")
            s.limit = end  # who catches an error puts it back
            v = part(s, pos, fr)[0]
            s.limit = limit
            return v, end

        return run

    def size(self): return Bounds.exactly(int(self.n.args[0])) if self.n.op == "const" else Bounds()
    def ahead(self, n): return frozenset((q, True) for q, _ in self.part.ahead(n))


@dataclass
class OfBits(Format):
    """The part runs over single bits, lowest of each byte first; the rest of the last byte is skipped."""

    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part = self.part.build(scope, True)

        def run(s, pos, fr):
            data = Bits(s.data, pos, s.limit)
            v, n = part(State(data, len(data), s.warnings), 0, fr)
            return v, pos + -(-n // 8)

        return run

    def size(self): return self.part.size().bytes_of_bits()


@dataclass
class WithRelativeOffset(Format):
    base: X.Expr
    offset: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        base, offset, part = build(self.base, scope), build(self.offset, scope), self.part.build(scope, bits)

        def run(s, pos, fr):
            at = int(base(fr)) + int(offset(fr))
            if not 0 <= at <= s.limit:
                raise DecodeError("SeekPastEnd", pos, f"to {at} of {s.limit}")
            return part(s, at, fr)[0], pos

        return run

    def size(self): return Bounds.exactly(0)


@dataclass
class Map(Format):
    part: Format
    f: X.Lambda

    def __post_init__(self): self.parts = (self.part,)
    def number(self) -> tuple[str, str, int] | None:
        """Representation, order and width, where this is a number made of any bytes."""
        p, e = self.part, self.f.body
        whole = isinstance(p, Tuple) and not p.as_list and all(isinstance(x, Byte) and x.members.bits == FULL for x in p.parts)
        return (e.args[0], e.args[1], len(p.parts)) if whole and e.op == "endian" and e.args[2] == X.var(self.f.names[0]) else None

    def build(self, scope, bits):
        if (found := self.number()) and not bits:
            kind, order, n = CLASSES[found[0]], found[1], found[2]
            read, make = int.from_bytes, int.__new__

            def taken(s, pos, fr):
                end = pos + n
                if end > s.limit:
                    raise DecodeError("Overbyte", s.limit, "no byte left")
                return make(kind, read(s.data[pos:end], order)), end

            return taken
        part, f = self.part.build(scope, bits), function(self.f, scope)

        def run(s, pos, fr):
            v, pos = part(s, pos, fr)
            return f(fr, v), pos

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


@dataclass
class BitNumber(Map):
    """A number made of single bits, the lowest first: of a buffer of bits, all are taken at once."""

    kind: str = "u16"

    def build(self, scope, bits):
        step, n, kind = super().build(scope, bits), len(self.part.parts), CLASSES[self.kind]

        def run(s, pos, fr):
            if pos + n > s.limit or not isinstance(s.data, Bits):
                return step(s, pos, fr)
            return int.__new__(kind, s.data.number(pos, n)), pos + n

        return run


@dataclass
class Where(Format):
    """A test of the result; hard, or soft: a warning."""

    part: Format
    test: X.Lambda
    hard: bool = True

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part, test, hard = self.part.build(scope, bits), function(self.test, scope), self.hard

        def run(s, pos, fr):
            v, to = part(s, pos, fr)
            if not test(fr, v):
                if hard:
                    raise DecodeError("BadWhere", pos, repr(v)[:80])
                s.warnings.append({"kind": "BadWhere", "offset": pos, "message": repr(v)[:80]})
            return v, to

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


@dataclass
class Compute(Format):
    e: X.Expr

    def build(self, scope, bits):
        e = build(self.e, scope)
        return lambda s, pos, fr: (e(fr), pos)

    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset({((), False)})


@dataclass
class Let(Format):
    name: str
    e: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        e = build(self.e, scope)
        own, (at,) = scope.inner(self.name)
        part = self.part.build(own, bits)

        def run(s, pos, fr):
            fr[at] = e(fr)
            return part(s, pos, fr)

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


@dataclass
class Match(Format):
    e: X.Expr
    cases: tuple

    def __post_init__(self): self.parts = tuple(f for _, f in self.cases)
    def build(self, scope, bits):
        e = build(self.e, scope)
        choose, scopes = chooser([p for p, _ in self.cases], scope)
        parts = [f.build(own, bits) for f, own in zip(self.parts, scopes)]

        def run(s, pos, fr):
            i = choose(fr, e(fr))
            if i < 0:
                raise DecodeError("eval", pos, "no case matches")
            return parts[i](s, pos, fr)

        return run

    def size(self): return Union.size(self)
    def ahead(self, n): return Union.ahead(self, n)


@functools.lru_cache(64)
def prefix_code(lengths: tuple[int, ...], symbols: tuple[int, ...] | None) -> PrefixCode:
    return PrefixCode(list(lengths), None if symbols is None else list(symbols))


class PrefixCode:
    """A canonical prefix code by the lengths of its symbols."""

    def __init__(self, lengths: list[int], symbols: list[int] | None = None):
        self.table: dict[tuple[int, int], Int] = {}
        code = 0
        for n in range(1, max(lengths, default=0) + 1):
            for i, x in enumerate(lengths):
                if x == n:
                    self.table[n, code] = Int(symbols[i] if symbols else i, "u16")
                    code += 1
            code <<= 1

    def read(self, s: State, pos: int) -> tuple[Int, int]:
        code, table, data, limit = 0, self.table, s.data, s.limit
        raw = data.window(pos) if isinstance(data, Bits) else None  # the next bits, lowest first
        for n in range(1, 16 if raw is not None else 33):
            if pos >= limit:
                raise DecodeError("Overbyte", pos, "code cut short")
            if raw is None:
                bit = data[pos]
            else:
                bit, raw = raw & 1, raw >> 1
            code, pos = code << 1 | bit, pos + 1
            if (found := table.get((n, code))) is not None:
                return found, pos
        raise DecodeError("NoValidBranch", pos, "no such code")


@dataclass
class Dynamic(Format):
    name: str
    lengths: X.Expr
    part: Format
    symbols: X.Expr | None = None

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        lengths, symbols = build(self.lengths, scope), None if self.symbols is None else build(self.symbols, scope)
        own, (at,) = scope.inner(self.name)
        part = self.part.build(own, bits)

        def run(s, pos, fr):
            fr[at] = prefix_code(tuple(map(int, lengths(fr))), None if symbols is None else tuple(map(int, symbols(fr))))
            return part(s, pos, fr)

        return run


@dataclass
class Apply(Format):
    name: str

    def build(self, scope, bits):
        at = scope.places[self.name]
        return lambda s, pos, fr: fr[at].read(s, pos)

    def size(self): return Bounds(1, None)


@dataclass
class Pos(Format):
    def build(self, scope, bits): return lambda s, pos, fr: (Int(pos, "u64"), pos)
    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset({((), False)})


@dataclass
class SkipRemainder(Format):
    def build(self, scope, bits): return lambda s, pos, fr: (None, s.limit)
    def ahead(self, n): return ANYTHING_MORE


@dataclass
class DecodeBytes(Format):
    e: X.Expr
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        e, part = build(self.e, scope), self.part.build(scope, False)

        def run(s, pos, fr):
            data = bytes(e(fr))
            v, at = part(State(data, len(data), s.warnings), 0, fr)
            if at < len(data):
                s.warnings.append({"kind": "Trailing", "offset": at, "message": f"{len(data) - at} bytes left"})
            return v, pos

        return run

    def size(self): return Bounds.exactly(0)


@dataclass
class LetFormat(Format):
    """Parses, binds the result, goes on. Without a name the first result is dropped."""

    first: Format
    name: str | None
    rest: Format

    def __post_init__(self): self.parts = (self.first, self.rest)
    def build(self, scope, bits):
        steps, last = [], self
        while isinstance(last, LetFormat):  # a record's fields make one loop
            first = last.first.build(scope, bits)
            if last.name is None:
                at = scope.new()
            else:
                scope, (at,) = scope.inner(last.name)
            steps.append((first, at, last.name))
            last = last.rest
        end = last.build(scope, bits)

        def traced(s, pos, fr):
            for step, at, name in steps:
                shown, start = name is not None and not name.startswith("_"), pos
                if shown:
                    s.path.append(name)
                fr[at], pos = step(s, pos, fr)
                if shown:
                    s.spans.append((".".join(s.path), start, pos))
                    s.path.pop()
            return end(s, pos, fr)

        def run(s, pos, fr):
            if s.spans is not None:
                return traced(s, pos, fr)
            for step, at, _ in steps:
                fr[at], pos = step(s, pos, fr)
            return end(s, pos, fr)

        return run

    def size(self): return self.first.size() + self.rest.size()
    def ahead(self, n): return _joined(self.first.ahead(n), self.rest.ahead, n)


@dataclass
class Hint(Format):
    style: str
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits): return self.part.build(scope, bits)
    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


@dataclass
class LiftedOption(Format):
    part: Format | None

    def __post_init__(self): self.parts = (self.part,) if self.part else ()
    def build(self, scope, bits):
        if self.part is None:
            return lambda s, pos, fr: (None, pos)
        part = self.part.build(scope, bits)

        def run(s, pos, fr):
            v, pos = part(s, pos, fr)
            return Some(v), pos

        return run

    def size(self): return self.part.size() if self.part else Bounds.exactly(0)
    def ahead(self, n): return self.part.ahead(n) if self.part else frozenset({((), False)})


@dataclass
class LetView(Format):
    name: str
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        own, (at,) = scope.inner(self.name)
        part = self.part.build(own, bits)

        def run(s, pos, fr):
            fr[at] = View(s.data, pos, s.limit)
            return part(s, pos, fr)

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


def _view(name: str, offset: X.Expr | None, scope: Scope) -> Callable[[list, int], View]:
    if name not in scope.places:
        raise ValueError(f"no view {name}")
    at, ahead = scope.places[name], None if offset is None else build(offset, scope)

    def run(fr, pos):
        v = fr[at]
        if ahead is None:
            return v
        to = v.offset + int(ahead(fr))
        if not v.offset <= to <= v.limit:
            raise DecodeError("Overrun", pos, f"view at {to} of {v.limit}")
        return View(v.data, to, v.limit)

    return run


@dataclass
class WithView(Format):
    """Reads at a view without moving: capture (n bytes), array (n numbers of a kind, big-endian), or the view itself."""

    view: str
    what: str
    n: X.Expr | None = None
    kind: str = "u8"
    offset: X.Expr | None = None

    def build(self, scope, bits):
        view = _view(self.view, self.offset, scope)
        if self.what == "reify":
            return lambda s, pos, fr: (view(fr, pos), pos)
        count, capture, kind, signed = build(self.n, scope), self.what == "capture", CLASSES[self.kind], self.kind[0] == "i"
        width, make, read = 1 if capture else int(self.kind[1:]) // 8, int.__new__, int.from_bytes

        def run(s, pos, fr):
            v, n = view(fr, pos), int(count(fr)) * width
            if not 0 <= n <= v.limit - v.offset:
                raise DecodeError("Overrun", pos, f"{n} bytes at {v.offset} of {v.limit}")
            raw = bytes(v.data[v.offset : v.offset + n])
            return (raw if capture else [make(kind, read(raw[i : i + width], "big", signed=signed)) for i in range(0, n, width)]), pos

        return run

    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset({((), False)})


@dataclass
class ParseFromView(Format):
    view: str
    part: Format
    offset: X.Expr | None = None

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        # a view of bytes or of bits is not known before; each way is built when it is first needed, at places of its own
        view, made = _view(self.view, self.offset, scope), {}

        def run(s, pos, fr):
            v = view(fr, pos)
            single = v.data.__class__ is Bits
            part = made.get(single)
            if part is None:
                part = made[single] = self.part.build(scope, single)
            if len(fr) <= scope.counter[0]:
                fr.extend([MISSING] * (scope.counter[0] + 1 - len(fr)))
            return part(State(v.data, v.limit, s.warnings, s.spans if v.data is s.data else None, s.path), v.offset, fr)[0], pos

        return run

    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset({((), False)})


@dataclass
class Phantom(Format):
    """Takes nothing and makes nothing; its part is there for what can be known of it."""

    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits): return lambda s, pos, fr: (None, pos)
    def size(self): return Bounds.exactly(0)
    def ahead(self, n): return frozenset({((), False)})


@dataclass
class Enforce(Format):
    part: Format

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part = self.part.build(scope, bits)

        def run(s, pos, fr):
            kept = len(s.warnings)
            v, to = part(s, pos, fr)
            if len(s.warnings) > kept:
                w = s.warnings[kept]
                raise DecodeError(w["kind"], w["offset"], w["message"])
            return v, to

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


@dataclass
class Permit(Format):
    """On a hard error: the fallback, nothing consumed, a warning."""

    part: Format
    fallback: X.Expr

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        part, fallback = self.part.build(scope, bits), build(self.fallback, scope)

        def run(s, pos, fr):
            kept, limit = len(s.warnings), s.limit
            try:
                return part(s, pos, fr)
            except DecodeError as error:
                del s.warnings[kept:]
                s.limit = limit
                s.warnings.append({"kind": error.kind, "offset": pos, "message": f"permitted: {error.message}"})
                return fallback(fr), pos

        return run

    def size(self): return self.part.size().union(Bounds.exactly(0))
    def ahead(self, n): return ANYTHING_MORE


@dataclass
class Call(Format):
    """A named format with arguments; its scope holds these only."""

    name: str
    part: Format
    args: tuple = ()
    views: tuple = ()

    def __post_init__(self): self.parts = (self.part,)
    def build(self, scope, bits):
        args = [(build(e, scope), scope.new()) for _, e in self.args]
        places = {k: at for (k, _), (_, at) in zip(self.args, args)} | {k: scope.places[v] for k, v in self.views}
        part = self.part.build(scope.only(places), bits)

        def run(s, pos, fr):
            for e, at in args:
                fr[at] = e(fr)
            return part(s, pos, fr)

        return run

    def size(self): return self.part.size()
    def ahead(self, n): return self.part.ahead(n)


class Module:
    """Formats by name, with parameters and views that they are called with. A format may call others of the module, itself included."""

    def __init__(self):
        self.items: dict[str, tuple[tuple[str, ...], tuple[str, ...], Format]] = {}
        self.steps: dict[tuple[str, bool], tuple[Step, list[int], list[int]]] = {}
        self.asked: set[str] = set()

    def __getstate__(self) -> dict:
        return {"items": self.items, "steps": {}, "asked": set()}

    def define(self, name: str, part: Format, params: tuple[str, ...] = (), views: tuple[str, ...] = ()) -> None:
        if name in self.items:
            raise ValueError(f"{name} is defined already")
        self.items[name] = tuple(params), tuple(views), part

    def call(self, name: str, *args: Any, views: tuple[str, ...] = ()) -> Format:
        return ItemVar(self, name, tuple(map(X.lift, args)), tuple(views))

    def built(self, name: str, bits: bool) -> tuple[Step, list[int], list[int]]:
        """The step, the places of its arguments and views, and the counter of its frame's places."""
        if (name, bits) not in self.steps:
            params, views, part = self.items[name]
            scope, at = Scope().inner(*params, *views)
            self.steps[name, bits] = part.build(scope, bits), at, scope.counter
        return self.steps[name, bits]


@dataclass
class ItemVar(Format):
    """A format of a module, called. Each call has a frame of its own, which holds its arguments and views only."""

    module: Module
    name: str
    args: tuple = ()
    views: tuple = ()

    def build(self, scope, bits):
        args, views = [build(e, scope) for e in self.args], [scope.places[v] for v in self.views]
        module, name = self.module, self.name

        def run(s, pos, fr):
            if name not in module.items:
                raise DecodeError("eval", pos, f"no format {name}")
            if len(args) != len(module.items[name][0]) or len(views) != len(module.items[name][1]):
                raise DecodeError("eval", pos, f"{name} takes {len(module.items[name][0])} arguments and {len(module.items[name][1])} views")
            step, at, counter = module.built(name, bits)
            own = [MISSING] * (counter[0] + 1)
            for place, v in zip(at, [*(e(fr) for e in args), *(fr[p] for p in views)]):
                own[place] = v
            return step(s, pos, own)

        return run

    def _of_part(self, ask: Callable[[Format], Any], unknown: Any) -> Any:
        """What is known of the called format; of one that calls itself, or is not there yet, nothing."""
        if self.name in self.module.asked or self.name not in self.module.items:
            return unknown
        self.module.asked.add(self.name)
        try:
            return ask(self.module.items[self.name][2])
        finally:
            self.module.asked.discard(self.name)

    def size(self): return self._of_part(lambda f: f.size(), Bounds())
    def ahead(self, n): return self._of_part(lambda f: f.ahead(n), ANYTHING_MORE)
    def census(self): return {"ItemVar"} | self._of_part(lambda f: f.census(), set())


@dataclass
class Inflate(Format):
    """A deflate stream, by the platform's own inflater: the bytes, `most` of them at most, and the cursor after the stream."""

    most: int = 1 << 30

    def build(self, scope, bits):
        most = self.most

        def run(s, pos, fr):
            press = zlib.decompressobj(-15)
            try:
                out = press.decompress(s.data[pos : s.limit], most)
            except zlib.error as error:
                raise DecodeError("Unexpected", pos, str(error)) from error
            if not press.eof:
                raise DecodeError("Overrun", s.limit, f"more than {most} bytes" if press.unconsumed_tail else "the stream is cut short")
            return out, s.limit - len(press.unused_data)

        return run

    def size(self): return Bounds(1, None)
    def ahead(self, n): return ANYTHING_MORE


def decode(fmt: Format, data: bytes, env: dict | None = None) -> tuple[Any, list[dict]]:
    """The value of a whole buffer and the warnings; bytes may be left."""
    s = State(data, len(data))
    return fmt.parse(s, 0, env or {})[0], s.warnings


def located(fmt: Format, data: bytes) -> list[tuple[str, int, int]]:
    """(path, start, stop) of every named field, in the order in which they end; those of derived buffers have no place in this one."""
    s = State(data, len(data), spans=[])
    fmt.parse(s, 0, {})
    return s.spans


def fits(data: Any, at: int, sets: tuple[int, ...]) -> bool:
    """Whether the bytes from a place on lie in the sets."""
    return all(m >> data[at + k] & 1 for k, m in enumerate(sets))


def unexpected(s: State, pos: int) -> DecodeError:
    return DecodeError("Unexpected", pos, f"byte {s.data[pos]:#04x}")


def singles(f: Format) -> list | None:
    """The value of each byte that alone makes one of the format (a byte, what a function makes of it, or a choice of these); else None."""
    if isinstance(f, Byte):
        return [BYTES[b] if b in f.members else MISSING for b in range(256)]
    if isinstance(f, Hint):
        return singles(f.part)
    if isinstance(f, Map) and isinstance(f.part, Byte) and free(f.f) <= set(f.f.names):
        try:
            return [X.apply(f.f, {}, BYTES[b]) if b in f.part.members else MISSING for b in range(256)]
        except DecodeError:
            return None
    if isinstance(f, Union):
        found = [x for x in map(singles, f.parts) if x is not None]
        return [next((x[b] for x in found if x[b] is not MISSING), MISSING) for b in range(256)] if found else None
    return None


def pattern_of(table: list) -> bytes:
    """A class of the bytes that a table has values for."""
    members = b"".join(b"\\x%02x" % b for b in range(256) if table[b] is not MISSING)
    return b"[" + members + b"]" if members else b"[^\\x00-\\xff]"
