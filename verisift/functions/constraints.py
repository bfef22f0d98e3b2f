"""Constraint strings such as ``.isComplete("c")`` read into records, without evaluating
them: one chain of calls with literal arguments is accepted, and comparisons written as
``lambda x: x >= 0.9`` or as text (``">= 0.9"``).  Metrics and detectors are named by calls of
their own: ``.hasNoAnomalies(Mean("price"), MedianDeviation(days=7))``."""

from __future__ import annotations

import ast
import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class ConstraintProblem(ValueError):
    """A constraint string that cannot be read or does not fit the table."""


COMPARISONS = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt,
    ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne,
}


@dataclass(frozen=True)
class Assertion:
    """A comparison of one value with constants."""

    text: str

    def __call__(self, value: Column) -> Column:
        body, name = _assertion_body(self.text)
        return F.coalesce(_condition(body, name, value), F.lit(False))


def _assertion_body(text: str) -> tuple[ast.expr, str]:
    source = text.strip()
    if not source.startswith("lambda"):
        source = f"lambda x: x {source}"
    try:
        node = ast.parse(source, mode="eval").body
    except SyntaxError as problem:
        raise ConstraintProblem(f"cannot read comparison: {text}") from problem
    if not isinstance(node, ast.Lambda) or len(node.args.args) != 1:
        raise ConstraintProblem(f"not a comparison of one value: {text}")
    return node.body, node.args.args[0].arg


def _condition(node: ast.expr, name: str, value: Column) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_condition(v, name, value) for v in node.values]
        joined = parts[0]
        for part in parts[1:]:
            joined = joined & part if isinstance(node.op, ast.And) else joined | part
        return joined
    if isinstance(node, ast.Compare):
        sides = [_operand(n, name, value) for n in (node.left, *node.comparators)]
        joined = F.lit(True)
        for left, op, right in zip(sides, node.ops, sides[1:]):
            if type(op) not in COMPARISONS:
                raise ConstraintProblem(f"comparison not allowed: {ast.unparse(node)}")
            joined = joined & COMPARISONS[type(op)](left, right)
        return joined
    raise ConstraintProblem(f"not a comparison: {ast.unparse(node)}")


def _operand(node: ast.expr, name: str, value: Column) -> Column:
    if isinstance(node, ast.Name) and node.id == name:
        return value
    try:
        constant = ast.literal_eval(node)
    except ValueError as problem:
        raise ConstraintProblem(f"not a constant: {ast.unparse(node)}") from problem
    if not isinstance(constant, (int, float)):
        raise ConstraintProblem(f"not a number: {constant!r}")
    return F.lit(float(constant))


IS_ONE = Assertion("== 1")


@dataclass(frozen=True)
class Call:
    """One constraint: its name and its arguments."""

    name: str
    args: tuple[Any, ...]
    text: str


@dataclass(frozen=True)
class Named:
    """A metric or detector named (with a capital) inside a constraint, with its arguments."""

    name: str
    args: tuple[Any, ...]
    kwargs: tuple[tuple[str, Any], ...] = ()


def _argument(node: ast.expr) -> Any:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id[:1].isupper():
        given = tuple((k.arg, _argument(k.value)) for k in node.keywords if k.arg)
        return Named(node.func.id, tuple(_argument(a) for a in node.args), given)
    if isinstance(node, ast.Lambda):
        text = ast.unparse(node)
        Assertion(text)(F.lit(0.0))
        return Assertion(text)
    if isinstance(node, ast.Attribute):
        return node.attr  # an enumeration member, e.g. ConstrainableDataTypes.Integral
    try:
        value = ast.literal_eval(node)
    except ValueError as problem:
        raise ConstraintProblem(f"argument is not a literal: {ast.unparse(node)}") from problem
    return tuple(value) if isinstance(value, list) else value


def read_constraint(rule: str) -> list[Call]:
    """Calls of a constraint chain, in order."""
    try:
        node = ast.parse("check" + rule.strip(), mode="eval").body
    except SyntaxError as problem:
        raise ConstraintProblem(f"cannot read constraint: {rule}") from problem
    calls: list[Call] = []
    while isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        arguments = [*node.args, *[k.value for k in node.keywords]]
        text = f"{node.func.attr}({', '.join(ast.unparse(a) for a in arguments)})"
        calls.append(Call(node.func.attr, tuple(_argument(a) for a in arguments), text))
        node = node.func.value
    if not calls or not isinstance(node, ast.Name) or node.id != "check":
        raise ConstraintProblem(f"not a chain of constraint calls: {rule}")
    return calls[::-1]
