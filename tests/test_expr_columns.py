"""Expressions as columns give the values of the same trees in programs, at the edges of every width; and closures do too."""

import itertools

import pytest

from bytegrain.functions import closures
from bytegrain.functions import expr as X
from bytegrain.functions import pattern as P
from bytegrain.functions.values import RANGES, EvalError, Int, Some, Tagged

V = X.var
KINDS = sorted(RANGES)


def edges(kind):
    low, high = RANGES[kind]
    return sorted({x for x in (low, low + 1, -1, 0, 1, 2, 3, 7, high // 2, high // 2 + 1, high - 1, high) if low <= x <= high})


def told(e, env):
    """The tree's value, None where it has none; closures must agree."""

    def closure():
        scope, at = closures.Scope().inner(*env)
        run = closures.build(e, scope)
        frame = [None] * (scope.counter[0] + 1)
        for place, v in zip(at, env.values()):
            frame[place] = v
        return run(frame)

    out = []
    for f in (lambda: X.value(e, env), closure):
        try:
            out.append(f())
        except EvalError:
            out.append(None)
    assert out[0] == out[1] and type(out[0]) is type(out[1])
    return out[0]


@pytest.mark.parametrize("kind", KINDS)
def test_arithmetic_of_a_kind(spark, kind):
    ops = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a // b, "rem": lambda a, b: a % b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}
    trees = {k: f(V("a"), V("b")) for k, f in ops.items()} | {"succ": X.succ(V("a")), "pred": X.pred(V("a"))}
    trees |= {f"l{n}": V("a") << n for n in (0, 1, 4, 7, 8, 31, 33, 63, 64, 70)} | {f"r{n}": V("a") >> n for n in (0, 1, 7, 31, 63, 64, 70)}
    trees |= {f"c{k}": X.cast(k, V("a")) for k in KINDS}
    pairs = list(itertools.product(edges(kind), repeat=2))
    frame = spark.createDataFrame([(k, str(a), str(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").selectExpr("k", *(f"cast({c} as {X.SPARK_TYPES[kind]}) as {c}" for c in "ab"))
    got = frame.select("k", *(X.column(t, {}, {"a": kind, "b": kind}, lenient=True).alias(n) for n, t in trees.items())).collect()
    for r in got:
        a, b = (Int(x, kind) for x in pairs[r["k"]])
        for name, t in trees.items():
            want = told(t, {"a": a, "b": b})
            assert (None if r[name] is None else int(r[name])) == want, (kind, name, a, b)


def test_plain_arithmetic(spark):
    numbers = [-(1 << 62), -(1 << 31), -8, -7, -1, 0, 1, 3, 7, (1 << 31) + 1, 9007199254740993, 1 << 62]
    pairs = list(itertools.product(numbers, repeat=2))
    trees = {"div": V("a") // V("b"), "rem": V("a") % V("b"), "and": V("a") & V("b"), "or": V("a") | V("b"), "add": V("a") + V("b"), "l": V("a") << 1, "r": V("a") >> 3, "not": X.negate(V("a").lt(V("b"))), "either": X.either(V("a").eq(1), V("b").gte(3))}
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a bigint, b bigint").select("k", *(X.column(t, {}, lenient=True).alias(n) for n, t in trees.items())).collect()
    for r in got:
        a, b = pairs[r["k"]]
        for name, t in trees.items():
            want = told(t, {"a": a, "b": b})
            want = None if want is not None and not -(1 << 63) <= want < 1 << 63 else want  # a long has no such value
            assert r[name] == want, (name, a, b)


def test_errors_without_lenience(spark):
    one = spark.range(1)
    for e in (X.u8(200) + X.u8(100), X.cast("u8", 256), X.lift([1, 2]).at(-1), X.lift([1, 2]).at(2), X.lift(1) // 0, X.sub_seq(X.lift([1]), 1, 1), X.match(X.lift(3), (P.integer(1), 1))):
        with pytest.raises(EvalError):
            X.value(e, {})
        with pytest.raises(Exception, match="no u8|out of range|division by zero|no case"):
            one.select(X.column(e, {}).alias("x")).collect()
    with pytest.raises(EvalError):
        X.column(X.u8(1) + X.u16(1), {})


def test_sequences(spark):
    lists = [[], [5], [1, 2, 2, 3], list(range(40))]
    s = V("s")
    trees = {
        "accum": X.flat_map_accum(lambda acc, x: X.tuple_of(acc + x, X.seq_of(acc, acc + x)), 0, s), "so_far": X.flat_map_list(lambda out, x: X.if_else(X.seq_length(out).lt(3), X.seq_of(x * 2), X.seq_of()), s),
        "map": X.flat_map(lambda x: X.seq_of(x, x % 2), s), "fold": X.left_fold(lambda acc, x: acc * 2 + x, 0, X.sub_seq(s, 0, 0)), "append": X.append(s, X.seq_of(7)), "numbers": X.enum_from_to(2, X.seq_length(s)), "dup": X.dup(3, X.seq_length(s)),
        "at": s.at(1), "at_minus": s.at(X.lift(0) - 1), "part": X.sub_seq(s, 1, 2), "copy": X.sub_seq_inflate(s, X.seq_length(s) - 1, 3), "found": X.find_by_key(lambda x: x % 4, 2, s), "sorted": X.find_by_key(lambda x: x, 2, s, is_sorted=True),
        "length": X.seq_length(s), "some": X.some(X.seq_length(s)), "none": X.none(), "record": X.record_of(n=X.seq_length(s))["n"], "pair": X.tuple_of(X.seq_length(s), 4)[1], "bound": X.destructure(X.tuple_of(X.seq_length(s), 2), P.tuple_of(P.binding("p"), P.integer(2)), V("p")),
        "tagged": X.match(X.tagged("t", X.seq_length(s)), (P.variant("t", P.binding("x")), V("x") * 1)),
    }
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, s array<bigint>")
    got = frame.select("k", *(X.column(t, {}, lenient=True).alias(n) for n, t in trees.items())).collect()
    for r in got:
        for name, t in trees.items():
            want = told(t, {"s": lists[r["k"]]})
            want = want.value if isinstance(want, Some) else list(want) if isinstance(want, range) else want
            if name in ("copy",) and not lists[r["k"]]:
                want = None
            assert r[name] == want, (name, lists[r["k"]])


def test_chars_and_bytes(spark):
    codes = [0, 65, 0x7F, 0xE9, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0x1F980, 0x10FFFF, 0x110000]
    got = spark.createDataFrame([(c,) for c in codes], "c bigint").select("c", X.column(X.as_char(V("c")), {}).alias("x")).collect()
    assert all(r["x"] == told(X.as_char(V("c")), {"c": r["c"]}) for r in got)
    for kind, order in itertools.product(("u16", "u32", "u64"), ("big", "little")):
        n = int(kind[1:]) // 8
        raws = [bytes(n), bytes([255] * n), bytes(range(1, n + 1)), bytes([0x80] + [0] * (n - 1))]
        tree = X.endian(kind, order, V("raw"))
        rows = spark.createDataFrame([(bytearray(x),) for x in raws], "raw binary").select("raw", X.column(tree, {}).alias("x")).collect()
        assert all(int(r["x"]) == told(tree, {"raw": bytes(r["raw"])}) for r in rows)


def test_kinds_of_literals(spark):
    e = X.match(X.cast("u8", V("a")), (P.integer(1, "u16"), 1), (P.integer(1, "u8"), 2), (P.wildcard(), 3))
    got = [r["x"] for r in spark.createDataFrame([(1,), (2,)], "a bigint").select(X.column(e, {}).alias("x")).collect()]
    assert got == [2, 3] == [told(e, {"a": n}) for n in (1, 2)]
    assert told(X.match(X.lift(Tagged("t", True)), (P.variant("t", P.boolean(True)), 1), (P.wildcard(), 0)), {}) == 1
    assert told(X.match(X.lift(Int(3, "u8")), (P.char("a"), 0), (P.between(2, None), 1)), {}) == 1
