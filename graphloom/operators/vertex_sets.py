"""Set algebra on sorted, duplicate-free arrays of vertex ids, as columns.

``upper`` is a strict bound.  None of these is a Python UDF; those without a bound stay in generated code.
A null set gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(a: Column, upper: Column) -> Column:
    """{x in a: x < upper}."""
    return F.filter(a, lambda x: x < upper)


def bounded_count(a: Column, upper: Column) -> Column:
    return F.size(bounded(a, upper))


def _below(a: Column, upper: Column | None) -> Column:
    return a if upper is None else bounded(a, upper)


def intersect(a: Column, b: Column, upper: Column | None = None) -> Column:
    """a & b, below upper if given."""
    return _below(F.array_intersect(a, b), upper)


def intersect_count(a: Column, b: Column, upper: Column | None = None) -> Column:
    return F.size(intersect(a, b, upper))


def subtract(a: Column, b: Column, owner: Column, upper: Column | None = None) -> Column:
    """a without b and without b's owner: what remains is not adjacent to the owner and not the owner."""
    return _below(F.array_except(a, F.array_append(b, owner)), upper)


def subtract_count(a: Column, b: Column, owner: Column, upper: Column | None = None) -> Column:
    return F.size(subtract(a, b, owner, upper))


def remove(a: Column, vertex: Column) -> Column:
    """a without one vertex."""
    return F.array_remove(a, vertex)


def remove_count(a: Column, vertex: Column) -> Column:
    return F.size(remove(a, vertex))


def indices(a: Column, b: Column) -> Column:
    """0-based places in a of the elements of b (null where an element is missing)."""
    return F.transform(b, lambda x: F.nullif(F.array_position(a, x), F.lit(0)) - 1)
