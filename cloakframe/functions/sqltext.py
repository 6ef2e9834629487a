"""Small helpers to write Spark SQL expressions as text.

The engine's row-level expressions are deep; written as SQL text each reaches Spark in one call,
where the Column API would need thousands of driver round trips per query.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

_names = itertools.count()


def fresh(prefix: str = "v") -> str:
    """A lambda variable no enclosing lambda uses."""
    return f"{prefix}_{next(_names)}"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fn(body: Callable[..., str], arity: int = 1) -> str:
    """A SQL lambda from a Python function over variable names."""
    names = [fresh() for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def transform(array: str, body: Callable[..., str], arity: int = 1) -> str:
    return f"transform({array}, {fn(body, arity)})"


def keep(array: str, body: Callable[..., str], arity: int = 1) -> str:
    return f"filter({array}, {fn(body, arity)})"


def fold(array: str, zero: str, step: Callable[[str, str], str], finish: Callable[[str], str] | None = None) -> str:
    tail = f", {fn(finish)}" if finish else ""
    return f"aggregate({array}, {zero}, {fn(step, 2)}{tail})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and hand it to `body`, also inside a lambda."""
    return f"get(transform(array({value}), {fn(body)}), 0)"


def empty(array_type: str) -> str:
    return f"cast(array() AS {array_type})"
