"""Metadata filters as Columns: eq ne gt gte lt lte in nin contains icontains, "*", AND, OR, NOT.

Conditions of an AND on one key all count, and logical operators may be nested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "contains": lambda c, v: c.cast("string").contains(v),
    "icontains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
}
LOGIC = ("AND", "OR", "NOT")


def is_advanced(filters: dict) -> bool:
    """Whether more than plain equality is asked for."""
    return any(k in LOGIC or v == "*" or isinstance(v, dict) and any(o in COMPARISONS for o in v) for k, v in filters.items())


def compile_filter(filters: dict, column: Callable[[str], Column] = F.col) -> Column:
    """The condition of a filter; ``column`` finds the column of a key."""

    def one(key: str, wanted: object) -> Column:
        if key in LOGIC:
            if not isinstance(wanted, list) or not wanted:
                raise ValueError(f"{key} needs a list of conditions")
            parts = [compile_filter(f, column) for f in wanted]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "AND" else joined | p
            return ~joined if key == "NOT" else joined
        if wanted == "*":
            return column(key).isNotNull()
        if isinstance(wanted, dict):
            unknown = set(wanted) - set(COMPARISONS)
            if unknown:
                raise ValueError(f"unknown filter operator: {', '.join(sorted(unknown))}")
            found = [COMPARISONS[o](column(key), v) for o, v in wanted.items()]
        else:
            found = [column(key).isNull() if wanted is None else column(key) == wanted]
        joined = found[0]
        for f in found[1:]:
            joined = joined & f
        return joined

    condition = F.lit(True)
    for key, wanted in filters.items():
        condition = condition & one(key, wanted)
    return condition
