import pytest

from bytegrain.functions import numeric as M
from bytegrain.functions import numeric_text as T
from bytegrain.functions.values import EvalError


@pytest.mark.parametrize("text, env, value", [("1 + 2 * 3", {}, 7), ("(1 + 2) * 3", {}, 9), ("10 - 4 - 3", {}, 3), ("~7 / 2", {}, -3), ("~7 % 3", {}, -1), ("abs ~x", {"x": 5}, 5), ("x as u8", {"x": 200}, 200), ("300 as? u8", {}, 44), ("255u8 as? i8", {}, -1), ("x*y - 1", {"x": 3, "y": 4}, 11)])
def test_text(text, env, value):
    tree = T.parse(text)
    assert M.evaluate(tree, env) == value and T.parse(T.shown(tree)) == tree


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "as u8", "1 as u9", "1 $ 2", ")"])
def test_what_is_no_text(text):
    with pytest.raises(ValueError):
        T.parse(text)


def test_elaboration():
    tree = T.elaborated(T.parse("(a + 1) as u16 * b"), {"a": "u8", "b": "u16"})
    assert tree.rep == "u16" and T.primitives(tree) == ["add_u8", "cast_u8_u16", "mul_u16"]
    assert T.elaborated(T.parse("1 + 2"), {}, "i32").args[0].rep == "i32"
    with pytest.raises(EvalError):
        T.elaborated(T.parse("a + b"), {"a": "u8", "b": "i8"})
    with pytest.raises(EvalError):
        T.elaborated(T.parse("1 + 2"), {})


def test_widths():
    tree = T.elaborated(T.parse("(a + b - b) as u8"), {"a": "u8", "b": "u8"})
    assert T.evaluate_within(tree, {"a": 10, "b": 20}) == (10, True)
    assert T.evaluate_within(tree, {"a": 200, "b": 100}) == (200, False)
    assert T.evaluate_within(T.elaborated(T.parse("a as? i8"), {"a": "u8"}), {"a": 255}) == (-1, True)
