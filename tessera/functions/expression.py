"""A small expression language, compiled once to a Column.

Names, numbers, ``? :`` (lowest, right), ``||``, ``&&``, ``== !=``, ``< <= > >=``, ``+ -``, ``* / %``, ``^`` (right) and a
sign that binds tighter than ``^``; a number is true from 1e-8 on. Spaces and capitals don't matter. A step
that isn't finite makes the whole value null, also in the branch that isn't taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)|([a-z_]\w*)|(\|\||&&|[=!<>]=|[-+*/%^<>?:()])")
_LEVELS = [["||"], ["&&"], ["==", "!="], ["<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "log": F.ln,
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "sqrt": F.sqrt, "deg": F.degrees, "rad": F.radians,
}


class ExpressionError(ValueError):
    pass


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _binary(op: str, a: Column, b: Column) -> Column:
    truth = lambda c: c.cast("double")
    return _finite({
        "||": lambda: truth((a != 0) | (b != 0)), "&&": lambda: truth((a != 0) & (b != 0)), "==": lambda: truth(a == b), "!=": lambda: truth(a != b),
        "<": lambda: truth(a < b), "<=": lambda: truth(a <= b), ">": lambda: truth(a > b), ">=": lambda: truth(a >= b), "+": lambda: a + b, "-": lambda: a - b,
        "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, a % F.nullif(b, F.lit(0.0))), "^": lambda: F.pow(a, b),
    }[op]())


class _Reader:
    def __init__(self, text: str, names: dict[str, Column]):
        text = re.sub(r"\s+", "", text.lower())
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at]!r}")
            self.tokens.append(m[0])
            at = m.end()
        self.names, self.at = names, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if not token or want is not None and token != want:
            raise ExpressionError(f"expected {want or 'more'}, got {token!r}")
        self.at += 1
        return token

    def choice(self) -> Column:
        c = self.level(0)
        if self.peek() != "?":
            return c
        self.take()
        a = self.choice()
        self.take(":")
        b = self.choice()
        # both branches count: a null in either makes the whole null
        return F.when(c.isNotNull() & a.isNotNull() & b.isNotNull(), F.when(F.abs(c) > 1e-8, a).otherwise(b))

    def level(self, k: int) -> Column:
        if k == len(_LEVELS):
            return self.power()
        left = self.level(k + 1)
        while self.peek() in _LEVELS[k]:
            left = _binary(self.take(), left, self.level(k + 1))
        return left

    def power(self) -> Column:
        base = self.signed()
        return _binary(self.take(), base, self.power()) if self.peek() == "^" else base

    def signed(self) -> Column:
        if self.peek() in ("-", "+"):
            sign = self.take()
            if self.peek() in ("-", "+"):
                raise ExpressionError("two signs")
            return -self.atom() if sign == "-" else self.atom()
        return self.atom()

    def atom(self) -> Column:
        token = self.take()
        if token == "(":
            inside = self.choice()
            self.take(")")
            return inside
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token))
        if token in FUNCTIONS and self.peek() == "(":
            self.take()
            inside = self.choice()
            self.take(")")
            return _finite(FUNCTIONS[token](inside))
        if token in self.names:
            return self.names[token].cast("double")
        raise ExpressionError(f"unknown name {token!r}")


def compile_expression(text: str, names: dict[str, Column]) -> Column:
    """The Column of an expression over names (pi is known); raises ExpressionError if it can't be read."""
    reader = _Reader(text, {"pi": F.lit(3.141592653589793), **{k.lower(): v for k, v in names.items()}})
    out = reader.choice()
    if reader.peek():
        raise ExpressionError(f"unexpected {reader.peek()!r}")
    return out


def apply_expression(text: str, value: Column, names: dict[str, Column]) -> Column:
    """value where the expression has no value, else the expression over names and ``val``."""
    return F.coalesce(compile_expression(text, {**names, "val": value}), value)
