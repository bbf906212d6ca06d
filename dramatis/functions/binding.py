"""Names for intermediate values inside column expressions, and literals of many values as one expression.

A column used in several places is written out in each, and nested uses multiply. Bound to a lambda variable, it
stands in the plan, and is computed, once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sql_literal(value: str | int | list[str] | None) -> str:
    if isinstance(value, list):
        return f"cast(array({', '.join(map(sql_literal, value))}) as array<string>)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "cast(null as string)" if value is None else str(value)


def literal_array(values: list[str]) -> Column:
    return F.expr(sql_literal(values))


def literal_map(entries: dict) -> Column:
    return F.expr(f"map({', '.join(sql_literal(x) for x in chain.from_iterable(entries.items()))})")
