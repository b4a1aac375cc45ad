"""Settings from text: typed values within bounds, and lists of numbers in a small safe notation. Nothing is evaluated."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def numbers(text: str) -> list[float]:
    """``3``, ``-2.5``, ``c(50, 75)``, ``2001:2005``, ``c(1:3, 10 - 2)``: literals, c(), ranges by ``:``, brackets, plus and minus.

    Anything else is refused: names, other calls, strings, attributes, other operators.
    """
    spelled = re.sub(r"(-?\d+)\s*:\s*(-?\d+)", r"span(\1, \2)", text.strip())
    if re.search(r":|span\s*\(", text.replace(" ", "")) and "span(" not in spelled or "span" in text:
        raise ValueError(f"not a list of numbers: {text!r}")
    try:
        tree = ast.parse(spelled, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a list of numbers: {text!r}") from e

    def value(node: ast.AST) -> list[float]:
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return [v]
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=x):
                return [-v if isinstance(op, ast.USub) else v for v in value(x)]
            case ast.BinOp(left=x, op=ast.Add() | ast.Sub() as op, right=y):
                a, b = value(x), value(y)
                if len(a) == len(b) == 1:
                    return [a[0] - b[0] if isinstance(op, ast.Sub) else a[0] + b[0]]
            case ast.Call(func=ast.Name(id="c"), args=args, keywords=[]):
                return [v for x in args for v in value(x)]
            case ast.Call(func=ast.Name(id="span"), args=[x, y], keywords=[]):
                a, b = int(value(x)[0]), int(value(y)[0])
                return list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
        raise ValueError(f"not a list of numbers: {text!r}")

    return value(tree.body)


def setting(env: Mapping[str, str], name: str, kind: type, default, low=None, high=None, among=None):
    """A setting's value, or its default where it is absent or blank; a value of another kind or out of bounds is an error."""
    text = env.get(name, "").strip()
    if not text:
        return default
    try:
        if kind is bool:
            if text.lower() not in TRUE | FALSE:
                raise ValueError
            out = text.lower() in TRUE
        elif kind is list:
            out = numbers(text)
        elif kind is int:
            if not re.fullmatch(r"[+-]?\d+", text):
                raise ValueError
            out = int(text)
        else:
            out = kind(text)
            if kind is float and not abs(out) < float("inf"):
                raise ValueError
    except ValueError as e:
        raise ValueError(f"{name}: {text!r} is no {kind.__name__}") from e
    each = out if kind is list else [out]
    if any((low is not None and v < low) or (high is not None and v > high) or (among is not None and v not in among) for v in each):
        raise ValueError(f"{name}: {text!r} is out of bounds")
    return out
