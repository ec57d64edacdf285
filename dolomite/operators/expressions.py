"""Rule expressions as trees, checked and compiled to columns. Nothing is evaluated by Python.

A tree is JSON: a number; {"op": "max"|"min"|"and"|"or", "operands": [...]}; {"op": ">" ... "!=", "left": ..., "right": ...};
or text, an expression of numbers, dotted names, + - * /, parentheses, max and min.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|([-+*/(),]))")
COMPARE: dict[str, Callable[[Column, Column], Column]] = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Node:
    kind: str  # number, name, math, logic, compare
    value: object
    parts: tuple[Node, ...] = ()


def parse_math(text: str) -> Node:
    """By precedence; ValueError for anything else."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        if not (m := TOKEN.match(text, at)):
            raise ValueError(f"unexpected {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][3] if place < len(tokens) else None

    def take(symbol: str) -> None:
        nonlocal place
        if peek() != symbol:
            raise ValueError(f"{symbol} expected in {text!r}")
        place += 1

    def atom() -> Node:
        nonlocal place
        if place >= len(tokens):
            raise ValueError(f"{text!r} ends early")
        m = tokens[place]
        place += 1
        if m[1]:
            return Node("number", float(m[1]))
        if m[2]:
            if peek() == "(" and m[2].lower() in ("max", "min"):
                take("(")
                parts = [total()]
                while peek() == ",":
                    take(",")
                    parts.append(total())
                take(")")
                return Node("logic", m[2].lower(), tuple(parts))
            return Node("name", m[2])
        if m[3] == "(":
            inner = total()
            take(")")
            return inner
        if m[3] in "+-":
            return Node("math", m[3], (Node("number", 0.0), atom()))
        raise ValueError(f"unexpected {m[3]!r} in {text!r}")

    def chain(below: Callable[[], Node], symbols: str) -> Node:
        nonlocal place
        left = below()
        while peek() and peek() in symbols:
            op = peek()
            place += 1
            left = Node("math", op, (left, below()))
        return left

    def total() -> Node:
        return chain(lambda: chain(atom, "*/"), "+-")

    out = total()
    if place < len(tokens):
        raise ValueError(f"text behind the expression: {text!r}")
    return out


def build(tree: object) -> Node:
    if isinstance(tree, bool) or tree is None:
        raise ValueError(f"no expression: {tree!r}")
    if isinstance(tree, (int, float)):
        return Node("number", float(tree))
    if isinstance(tree, str):
        return parse_math(tree)
    op = tree.get("op") or tree.get("operator")
    if op in ("max", "min", "and", "or"):
        parts = tuple(map(build, tree.get("operands") or []))
        if not parts:
            raise ValueError(f"{op} without operands")
        return Node("logic", op, parts)
    if op in COMPARE:
        return Node("compare", op, (build(tree["left"]), build(tree["right"])))
    raise ValueError(f"unknown operator {op!r}")


def parse(text: str) -> Node:
    return build(json.loads(text))


def dumped(node: Node) -> object:
    """As JSON values again; math as text."""
    if node.kind == "number":
        return node.value
    if node.kind == "logic":
        return {"op": node.value, "operands": [dumped(p) for p in node.parts]}
    if node.kind == "compare":
        return {"op": node.value, "left": dumped(node.parts[0]), "right": dumped(node.parts[1])}
    return printed(node)


def printed(node: Node) -> str:
    if node.kind == "math":
        return f"({printed(node.parts[0])} {node.value} {printed(node.parts[1])})"
    if node.kind == "logic":
        return f"{node.value}({', '.join(map(printed, node.parts))})"
    return f"{node.value:g}" if node.kind == "number" else str(node.value)


def names(node: Node) -> set[str]:
    return {str(node.value)} if node.kind == "name" else set().union(*map(names, node.parts)) if node.parts else set()


def problems(node: Node, known: Mapping[str, object]) -> list[str]:
    """Names that are not known, sorted."""
    return [f"unknown variable {n}" for n in sorted(names(node) - set(known))]


def compiled(node: Node, known: Mapping[str, Column]) -> Column:
    """The tree as a column; known: the columns that names stand for. max and min of one operand are that operand."""
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "name":
        return known[str(node.value)]
    parts = [compiled(p, known) for p in node.parts]
    if node.kind == "compare":
        return COMPARE[str(node.value)](*parts)
    if node.kind == "math":
        a, b = parts
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[str(node.value)]()
    if node.value in ("and", "or"):
        return reduce((lambda a, b: a & b) if node.value == "and" else (lambda a, b: a | b), parts)
    return parts[0] if len(parts) == 1 else (F.greatest if node.value == "max" else F.least)(*parts)
