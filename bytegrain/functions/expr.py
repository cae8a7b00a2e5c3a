"""Expressions: one tree, evaluated on Python values inside a decode program or turned into a Catalyst column.

A tree is made with the functions below; `value(tree, env)` evaluates it, `column(tree, env)` gives the Spark column in which variables are
the columns of `env`. Lambdas are Python functions from trees to trees, applied to fresh variables. Both forms check the width of every
result whose representation is known, and give the same values; where one has none, `column` raises an error in the query, or gives null.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric
from .values import RANGES, EvalError, Int, Some, Tagged, sized

_FRESH = itertools.count()


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()

    def __add__(self, other): return arith("+", self, other)
    def __sub__(self, other): return arith("-", self, other)
    def __mul__(self, other): return arith("*", self, other)
    def __floordiv__(self, other): return arith("div", self, other)
    def __mod__(self, other): return arith("rem", self, other)
    def __and__(self, other): return arith("&", self, other)
    def __or__(self, other): return arith("|", self, other)
    def __lshift__(self, other): return arith("<<", self, other)
    def __rshift__(self, other): return arith(">>", self, other)
    def eq(self, other): return rel("=", self, other)
    def ne(self, other): return rel("<>", self, other)
    def lt(self, other): return rel("<", self, other)
    def gt(self, other): return rel(">", self, other)
    def lte(self, other): return rel("<=", self, other)
    def gte(self, other): return rel(">=", self, other)
    def __getitem__(self, key): return Expr("field", (self, key))
    def at(self, index): return Expr("seq_ix", (self, lift(index)))


def lift(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", (x,))


@dataclass(frozen=True)
class Lambda:
    names: tuple[str, ...]
    body: Expr


def lam(f: Callable[..., Any] | Lambda) -> Lambda:
    if isinstance(f, Lambda):
        return f
    names = tuple(f"{n}_{next(_FRESH)}" for n in inspect.signature(f).parameters)
    return Lambda(names, lift(f(*(var(n) for n in names))))


def var(name: str) -> Expr: return Expr("var", (name,))
def arith(op: str, a, b) -> Expr: return Expr("arith", (op, lift(a), lift(b)))
def rel(op: str, a, b) -> Expr: return Expr("rel", (op, lift(a), lift(b)))
def u8(n: int) -> Expr: return lift(Int(n, "u8"))
def u16(n: int) -> Expr: return lift(Int(n, "u16"))
def u32(n: int) -> Expr: return lift(Int(n, "u32"))
def u64(n: int) -> Expr: return lift(Int(n, "u64"))
def both(a, b) -> Expr: return Expr("and", (lift(a), lift(b)))
def either(a, b) -> Expr: return Expr("or", (lift(a), lift(b)))
def negate(a) -> Expr: return Expr("not", (lift(a),))
def succ(a) -> Expr: return Expr("succ", (lift(a),))
def pred(a) -> Expr: return Expr("pred", (lift(a),))
def tuple_of(*items) -> Expr: return Expr("tuple", tuple(map(lift, items)))
def record_of(**fields) -> Expr: return Expr("record", tuple((k, lift(v)) for k, v in fields.items()))
def tagged(tag: str, e) -> Expr: return Expr("variant", (tag, lift(e)))
def seq_of(*items) -> Expr: return Expr("seq", tuple(map(lift, items)))
def number(tree: numeric.Tree) -> Expr: return Expr("numeric", (tree,))
def match(e, *cases) -> Expr: return Expr("match", (lift(e), tuple((p, lift(x)) for p, x in cases)))
def destructure(e, pattern, body) -> Expr: return Expr("destructure", (lift(e), pattern, lift(body)))
def cast(kind: str, e) -> Expr: return Expr("cast", (kind, lift(e)))
def as_char(e) -> Expr: return Expr("as_char", (lift(e),))
def endian(kind: str, order: str, e) -> Expr: return Expr("endian", (kind, order, lift(e)))
def seq_length(s) -> Expr: return Expr("seq_length", (lift(s),))
def sub_seq(s, start, n) -> Expr: return Expr("sub_seq", (lift(s), lift(start), lift(n)))
def sub_seq_inflate(s, start, n) -> Expr: return Expr("sub_seq_inflate", (lift(s), lift(start), lift(n)))
def append(a, b) -> Expr: return Expr("append", (lift(a), lift(b)))
def flat_map(f, s) -> Expr: return Expr("flat_map", (lam(f), lift(s)))
def flat_map_accum(f, start, s) -> Expr: return Expr("flat_map_accum", (lam(f), lift(start), lift(s)))
def flat_map_list(f, s, element: str = "bigint") -> Expr:
    """f sees the list so far and the next element. element: the Spark type of what it makes, for columns."""
    return Expr("flat_map_list", (lam(f), lift(s), element))

def left_fold(f, start, s) -> Expr: return Expr("left_fold", (lam(f), lift(start), lift(s)))
def find_by_key(f, key, s, is_sorted: bool = False) -> Expr: return Expr("find_by_key", (is_sorted, lam(f), lift(key), lift(s)))
def enum_from_to(a, b) -> Expr: return Expr("range", (lift(a), lift(b)))
def dup(n, e) -> Expr: return Expr("dup", (lift(n), lift(e)))
def some(e) -> Expr: return Expr("some", (lift(e),))
def none() -> Expr: return Expr("none")
def if_else(c, a, b) -> Expr: return Expr("if", (lift(c), lift(a), lift(b)))
def map_seq(f, s) -> Expr:
    g = lam(f)
    return flat_map(Lambda(g.names, seq_of(g.body)), s)


_REL = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _divided(a: int, b: int, rest: bool) -> int:
    if b == 0:
        raise EvalError("division by zero")
    q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    return a - q * b if rest else q


_ARITH = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "div": lambda a, b: _divided(a, b, False), "rem": lambda a, b: _divided(a, b, True),
    "&": lambda a, b: a & b, "|": lambda a, b: a | b, ">>": lambda a, b: a >> b,
}


def apply(f: Lambda, env: dict, *args) -> Any:
    return value(f.body, {**env, **dict(zip(f.names, args))})


def _items(s: Any) -> Any:
    if isinstance(s, (bytes, list, tuple, range)):
        return s
    raise EvalError(f"{type(s).__name__} is no sequence")


def value(e: Expr, env: dict) -> Any:
    """The tree's value where variables have the values of env."""
    op, a = e.op, e.args
    if op == "const":
        return a[0]
    if op == "var":
        if a[0] not in env:
            raise EvalError(f"no variable {a[0]}")
        return env[a[0]]
    if op == "arith":
        x, y = int(left := value(a[1], env)), int(right := value(a[2], env))
        if a[0] in ("<<", ">>") and y < 0:
            raise EvalError(f"shift by {y}")
        if a[0] == "<<":  # unchecked: what goes beyond the width is lost
            kind = getattr(left, "kind", None)
            return Int((x << y) & RANGES[kind][1], kind) if kind else x << y
        return sized(_ARITH[a[0]](x, y), left, *([right] if a[0] != ">>" else []))
    if op == "rel":
        return _REL[a[0]](value(a[1], env), value(a[2], env))
    if op in ("and", "or"):  # both sides are evaluated
        x, y = value(a[0], env), value(a[1], env)
        return bool(x and y) if op == "and" else bool(x or y)
    if op == "not":
        return not value(a[0], env)
    if op in ("succ", "pred"):
        x = value(a[0], env)
        return sized(int(x) + (1 if op == "succ" else -1), x)
    if op in ("tuple", "seq"):
        out = [value(x, env) for x in a]
        return tuple(out) if op == "tuple" else out
    if op == "record":
        return {k: value(x, env) for k, x in a}
    if op == "field":
        x = value(a[0], env)
        x = x.value if isinstance(x, Some) else x
        try:
            return x[a[1]]
        except (KeyError, IndexError, TypeError) as error:
            raise EvalError(f"no field {a[1]}") from error
    if op == "variant":
        return Tagged(a[0], value(a[1], env))
    if op == "numeric":
        return numeric.evaluate(a[0], env)
    if op == "match":
        x = value(a[0], env)
        for pattern, body in a[1]:
            found = pattern.match(x)
            if found is not None:
                return value(body, {**env, **found})
        raise EvalError("no case matches")
    if op == "destructure":
        found = a[1].match(value(a[0], env))
        if found is None:
            raise EvalError("the pattern does not match")
        return value(a[2], {**env, **found})
    if op == "cast":
        return Int(int(value(a[1], env)), a[0])
    if op == "as_char":
        x = int(value(a[0], env))
        return chr(x) if x < 0xD800 or 0xE000 <= x < 0x110000 else "�"
    if op == "endian":
        return Int(int.from_bytes(bytes(value(a[2], env)), a[1]), a[0])
    if op == "seq_length":
        return Int(len(_items(value(a[0], env))) & 0xFFFFFFFF, "u32")
    if op == "seq_ix":
        s, i = _items(value(a[0], env)), int(value(a[1], env))
        if not 0 <= i < len(s):
            raise EvalError(f"index {i} of {len(s)}")
        return s[i]
    if op == "sub_seq":
        s, start, n = _items(value(a[0], env)), int(value(a[1], env)), int(value(a[2], env))
        if start < 0 or n < 0 or start + n > len(s):
            raise EvalError(f"part [{start}, {start + n}) of {len(s)}")
        return s[start : start + n]
    if op == "sub_seq_inflate":
        s, start, n = _items(value(a[0], env)), int(value(a[1], env)), int(value(a[2], env))
        span = len(s) - start
        if start < 0 or (span <= 0 < n):
            raise EvalError(f"copy from {start} of {len(s)}")
        if isinstance(s, bytes):
            return (s[start:] * (n // max(1, span) + 1))[:n]
        return [s[start + i % span] for i in range(n)]
    if op == "append":
        x, y = value(a[0], env), value(a[1], env)
        return x + y if isinstance(x, bytes) and isinstance(y, bytes) else [*x, *y]
    if op == "flat_map":
        return [y for x in _items(value(a[1], env)) for y in apply(a[0], env, x)]
    if op == "flat_map_accum":
        acc, out = value(a[1], env), []
        for x in _items(value(a[2], env)):
            acc, more = apply(a[0], env, acc, x)
            out.extend(more)
        return out
    if op == "flat_map_list":
        out = []
        for x in _items(value(a[1], env)):
            out.extend(apply(a[0], env, out, x))
        return out
    if op == "left_fold":
        acc = value(a[1], env)
        for x in _items(value(a[2], env)):
            acc = apply(a[0], env, acc, x)
        return acc
    if op == "find_by_key":
        return _found(a[0], lambda x: apply(a[1], env, x), value(a[2], env), _items(value(a[3], env)))
    if op == "range":
        return range(int(value(a[0], env)), int(value(a[1], env)))
    if op == "dup":
        n, x = int(value(a[0], env)), value(a[1], env)
        return bytes([x]) * n if isinstance(x, Int) and x.kind == "u8" else [x] * n
    if op == "some":
        return Some(value(a[0], env))
    if op == "none":
        return None
    if op == "if":
        return value(a[1] if value(a[0], env) else a[2], env)
    raise EvalError(f"unknown operator {op}")


def _found(is_sorted: bool, key: Callable, wanted: Any, s: Any) -> Any:
    """The first element with the key; in a sorted sequence by halving."""
    if not is_sorted:
        return next((Some(x) for x in s if key(x) == wanted), None)
    low, high = 0, len(s)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if key(s[mid]) < wanted else (low, mid)
    return Some(s[low]) if low < len(s) and key(s[low]) == wanted else None


#: Spark types that hold the representations.
SPARK_TYPES = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint"}


def checked(x: Column, kind: str, lenient: bool = False) -> Column:
    """x as the type of its representation; an error (lenient: null) where it does not fit."""
    low, high = RANGES[kind]
    wide = "decimal(38,0)" if kind in ("u64", "i64") else "bigint"
    w = x.try_cast(wide)
    fits = (w >= F.lit(str(low)).cast(wide)) & (w <= F.lit(str(high)).cast(wide))
    return F.when(fits, w.cast(SPARK_TYPES[kind])).when(x.isNotNull(), _failed(f"no {kind}", lenient).cast(SPARK_TYPES[kind]))


def _failed(message: str, lenient: bool) -> Column:
    return F.lit(None) if lenient else F.raise_error(F.lit(message))


def kind_in(e: Expr, kinds: dict[str, str]) -> str | None:
    """The representation of a tree's value as far as it is known without data; kinds: of variables. Mixed ones are an error."""
    op, a = e.op, e.args
    if op == "const":
        return a[0].kind if isinstance(a[0], Int) else None
    if op == "var":
        return kinds.get(a[0])
    if op in ("cast", "endian"):
        return a[0]
    if op == "seq_length":
        return "u32"
    if op == "numeric":
        return None if (rep := numeric.representation(a[0])) == numeric.AUTO else rep
    if op in ("succ", "pred"):
        return kind_in(a[0], kinds)
    if op == "if":
        return kind_in(a[1], kinds)
    if op == "match":
        return kind_in(a[1][0][1], kinds)
    if op == "arith":
        found = {k for k in (kind_in(x, kinds) for x in (a[1:2] if a[0] in ("<<", ">>") else a[1:])) if k}
        if len(found) > 1:
            raise EvalError(f"mixed representations {sorted(found)}")
        return found.pop() if found else None
    return None


_WIDE = "decimal(38,0)"


def _as_bits(x: Column) -> Column:
    """A u64 as the signed long of the same bits."""
    x = x.cast(_WIDE)
    return F.when(x >= F.lit(str(1 << 63)).cast(_WIDE), x - F.lit(str(1 << 64)).cast(_WIDE)).otherwise(x).cast("bigint")


def _from_bits(x: Column) -> Column:
    return F.when(x < 0, x.cast(_WIDE) + F.lit(str(1 << 64)).cast(_WIDE)).otherwise(x.cast(_WIDE))


def _arith(op: str, x: Column, y: Column, kind: str | None, lenient: bool) -> Column:
    """Plain integers are longs; a result with a representation is checked against it, but for <<, which drops what goes beyond the width."""
    if op in ("<<", ">>"):
        n = F.least(y.cast("bigint"), F.lit(63)).cast("int")
        bits = _as_bits(x) if kind == "u64" else x.cast("bigint")
        if op == ">>":
            out = F.call_function("shiftrightunsigned" if kind == "u64" else "shiftright", bits, n)
            out = F.when((y > 63) & F.lit(kind == "u64"), F.lit(0)).otherwise(out)
            out = _from_bits(out).cast(SPARK_TYPES["u64"]) if kind == "u64" else out.cast(SPARK_TYPES[kind]) if kind else out
        else:
            out = F.when(y <= 63, F.call_function("shiftleft", bits, n)).otherwise(F.lit(0).cast("bigint"))
            if kind == "u64":
                out = _from_bits(out).cast(SPARK_TYPES["u64"])
            elif kind:
                out = out.bitwiseAND(F.lit(RANGES[kind][1]).cast("bigint")).cast(SPARK_TYPES[kind])
            else:
                whole = (y <= 63) & (F.call_function("shiftright", out, n) == bits)
                out = F.when(whole | (bits == 0), out).otherwise(_failed("the shift loses bits", lenient).cast("bigint"))
        return F.when(y >= 0, out).otherwise(_failed("a negative shift", lenient))
    if op in ("&", "|"):
        both = [_as_bits(v) if kind == "u64" else v.cast("bigint") for v in (x, y)]
        out = both[0].bitwiseAND(both[1]) if op == "&" else both[0].bitwiseOR(both[1])
        return _from_bits(out).cast(SPARK_TYPES["u64"]) if kind == "u64" else checked(out, kind, lenient) if kind else out
    wide = _WIDE if kind in ("u64", "i64") else "bigint"
    x, y = x.cast(wide), y.cast(wide)
    if op in ("div", "rem"):
        if wide == _WIDE:
            rest = x % F.when(y != 0, y)
            out = rest if op == "rem" else ((x - rest) / F.when(y != 0, y)).cast(_WIDE)
        else:
            out = x % F.when(y != 0, y) if op == "rem" else F.call_function("div", x, F.when(y != 0, y))
        out = F.when(y != 0, out).otherwise(_failed("division by zero", lenient))
    elif lenient:
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    else:
        out = x + y if op == "+" else x - y if op == "-" else x * y
    return checked(out, kind, lenient) if kind else out


def column(e: Expr, env: dict[str, Column], kinds: dict[str, str] | None = None, lenient: bool = False) -> Column:
    """The tree as a Spark column; it stays in whole-stage code as far as Spark's own functions do.

    kinds: representations of variables, which a column's type does not tell. lenient: null instead of an error.
    """
    kinds = kinds or {}
    op, a = e.op, e.args

    def go(x: Expr, more: dict[str, Column] | None = None) -> Column:
        return column(x, {**env, **more} if more else env, kinds, lenient)

    def function(f: Lambda) -> Callable[..., Column]:
        """For Spark's higher-order functions, with the right number of named parameters."""
        if len(f.names) == 1:
            return lambda x: go(f.body, {f.names[0]: x})
        return lambda x, y: go(f.body, {f.names[0]: x, f.names[1]: y})

    if op == "const":
        x = a[0]
        if isinstance(x, Int):
            return F.lit(str(int(x))).cast(SPARK_TYPES[x.kind])
        if isinstance(x, (list, tuple)):
            return F.array(*map(F.lit, x))
        return F.lit(x)
    if op == "var":
        return env[a[0]] if a[0] in env else F.col(a[0])
    if op == "arith":
        return _arith(a[0], go(a[1]), go(a[2]), kind_in(e, kinds), lenient)
    if op == "rel":
        x, y = go(a[1]), go(a[2])
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[a[0]]
    if op in ("and", "or"):
        return go(a[0]) & go(a[1]) if op == "and" else go(a[0]) | go(a[1])
    if op == "not":
        return ~go(a[0])
    if op in ("succ", "pred"):
        return _arith("+", go(a[0]), F.lit(1 if op == "succ" else -1), kind_in(e, kinds), lenient)
    if op == "tuple":
        return F.struct(*(go(x).alias(f"_{i}") for i, x in enumerate(a)))
    if op == "record":
        return F.struct(*(go(x).alias(k) for k, x in a))
    if op == "seq":
        return F.array(*map(go, a))
    if op == "field":
        return go(a[0]).getField(a[1] if isinstance(a[1], str) else f"_{a[1]}")
    if op == "variant":
        return F.struct(F.lit(a[0]).alias("tag"), go(a[1]).alias(a[0]))
    if op == "numeric":
        return numeric.column(a[0], env)
    if op == "match":
        x, kind, out = go(a[0]), kind_in(a[0], kinds), _failed("no case matches", lenient)
        for pattern, body in reversed(a[1]):
            test, names = pattern.column(x, kind)
            out = F.when(test, go(body, names)).otherwise(out)
        return out
    if op == "destructure":
        test, names = a[1].column(go(a[0]), kind_in(a[0], kinds))
        return F.when(test, go(a[2], names)).otherwise(_failed("the pattern does not match", lenient))
    if op == "cast":
        return checked(go(a[1]), a[0], lenient)
    if op == "as_char":
        x = go(a[0]).cast("bigint")
        ok = (x < 0xD800) | ((x >= 0xE000) & (x < 0x110000))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(ok & (x >= 0), x).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    if op == "endian":  # of BINARY
        x = go(a[2])
        digits = F.hex(x) if a[1] == "big" else F.array_join(F.reverse(F.regexp_extract_all(F.hex(x), F.lit("(..)"), 1)), "")
        return F.conv(digits, 16, 10).cast(SPARK_TYPES[a[0]])
    if op == "seq_length":
        return F.size(go(a[0])).cast("bigint")
    if op == "seq_ix":
        s, i = go(a[0]), go(a[1]).cast("bigint")
        return F.when((i >= 0) & (i < F.size(s)), F.get(s, i.cast("int"))).otherwise(_failed("index out of range", lenient))
    if op == "sub_seq":
        s, start, n = map(go, a)
        return F.when((start >= 0) & (n >= 0) & (start + n <= F.size(s)), F.slice(s, (start + 1).cast("int"), n.cast("int"))).otherwise(_failed("part out of range", lenient))
    if op == "sub_seq_inflate":
        s, start, n = map(go, a)
        out = F.transform(_range(F.lit(0), n), lambda i: F.get(s, (start + i % (F.size(s) - start)).cast("int")))
        return F.when((start >= 0) & ((start < F.size(s)) | (n <= 0)), out).otherwise(_failed("copy out of range", lenient))
    if op == "append":
        return F.concat(go(a[0]), go(a[1]))
    if op == "flat_map":
        return F.flatten(F.transform(go(a[1]), function(a[0])))
    if op == "flat_map_accum":
        f, start, s = function(a[0]), go(a[1]), go(a[2])
        first, never = f(start, F.get(s, F.lit(0))), F.lit(False)  # tells the types that a step makes; is not evaluated
        begin = F.struct(F.when(never, first.getField("_0")).otherwise(start).alias("acc"), F.when(never, first.getField("_1")).otherwise(F.array()).alias("out"))

        def step(state: Column, x: Column) -> Column:
            got = f(state.getField("acc"), x)
            return F.struct(got.getField("_0").alias("acc"), F.concat(state.getField("out"), got.getField("_1")).alias("out"))

        return F.aggregate(s, begin, step, lambda z: z.getField("out"))
    if op == "flat_map_list":
        f, s = function(a[0]), go(a[1])
        return F.aggregate(s, F.array().cast(f"array<{a[2]}>"), lambda out, x: F.concat(out, f(out, x)))
    if op == "left_fold":
        f, start, s = function(a[0]), go(a[1]), go(a[2])
        return F.aggregate(s, F.when(F.lit(False), f(start, F.get(s, F.lit(0)))).otherwise(start), f)
    if op == "find_by_key":  # the first, sorted or not
        key, wanted = function(a[1]), go(a[2])
        return F.get(F.filter(go(a[3]), lambda x: key(x) == wanted), F.lit(0))
    if op == "range":
        return _range(go(a[0]), go(a[1]))
    if op == "dup":
        return F.array_repeat(go(a[1]), go(a[0]).cast("int"))
    if op == "some":
        return go(a[0])
    if op == "none":
        return F.lit(None)
    if op == "if":
        return F.when(go(a[0]), go(a[1])).otherwise(go(a[2]))
    raise ValueError(f"unknown operator {op}")


def _range(low: Column, high: Column) -> Column:
    """The numbers from low up to high; Spark's sequence() would count down."""
    return F.when(low < high, F.sequence(low.cast("bigint"), high.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
