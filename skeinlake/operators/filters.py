"""Metadata filters: a dictionary of conditions to one column expression, which reaches the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F


def _one(c: Column, op: str, v: Any) -> Column:
    match op:
        case "$eq":
            return c == F.lit(v)
        case "$ne":
            return c != F.lit(v)
        case "$lt":
            return c < F.lit(v)
        case "$lte":
            return c <= F.lit(v)
        case "$gt":
            return c > F.lit(v)
        case "$gte":
            return c >= F.lit(v)
        case "$between":
            low, high = v
            return c.between(F.lit(low), F.lit(high))
        case "$in":
            return c.isin(list(v))
        case "$nin":
            return ~c.isin(list(v))
        case "$like":
            return F.contains(c, F.lit(v))
        case "$ilike":
            return F.contains(F.lower(c), F.lower(F.lit(v)))
    raise ValueError(f"unknown operator {op}")


def field(name: str, columns: list[str], like: Any = None) -> Column:
    """A column, or else a property of a graph node, as a number where it is compared with one."""
    if name in columns:
        return F.col(f"`{name}`")
    if "props" not in columns:
        raise ValueError(f"no column {name}")
    value = F.element_at("props", F.lit(name))
    first = like[0] if isinstance(like, (list, tuple)) and like else like
    return value.try_cast("double") if isinstance(first, (int, float)) and not isinstance(first, bool) else value


def compile_filter(filters: dict[str, Any] | None, columns: list[str]) -> Column:
    """``{"label": 3, "year": {"$gte": 2000}, "$or": [...]}`` as a condition; an empty one is true.

    Fields must be among ``columns``; of a table with a map ``props`` other names are its properties, absent ones null. As
    in SQL, a comparison with null is not true.
    """
    if not filters:
        return F.lit(True)
    parts = []
    for name, rule in filters.items():
        if name in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if name == "$and" else a | b, (compile_filter(r, columns) for r in rule)))
        elif isinstance(rule, dict):
            parts += [_one(field(name, columns, v), op, v) for op, v in rule.items()]
        else:
            parts.append(_one(field(name, columns, rule), "$eq", rule))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
