"""Sets (sorted distinct arrays), ordered-array search, order vectors, scalar brackets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def inter(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def sym_diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def insert(a: Column, x: Column) -> Column:
    return union(a, F.array(x))


def remove(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def has(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def ordinal(a: Column, x: Column) -> Column:
    """Place from 0, or -1."""
    return F.array_position(a, x) - 1


def relates(a: Column, op: str, b: Column) -> Column:
    """'=', '<>', '<=', '<', '>=', '>' by inclusion, '&' overlap, '~' disjoint."""
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    same = inside(a, b) & inside(b, a)
    return {"=": same, "<>": ~same, "<=": inside(a, b), "<": inside(a, b) & ~same, ">=": inside(b, a), ">": inside(b, a) & ~same, "&": F.size(F.array_intersect(a, b)) > 0, "~": F.size(F.array_intersect(a, b)) == 0}[op]


def last_le(a: Column, x: Column) -> Column:
    """Place of the last element <= x of an ordered array, or -1."""
    return F.size(F.filter(a, lambda v: v <= x)) - 1


def last_lt(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda v: v < x)) - 1


def order_vector(a: Column) -> Column:
    """Places from 0 in rising order of their elements; equal elements keep theirs."""
    return F.transform(F.array_sort(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"])


def reorder(a: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(a, i + 1))


def is_order_vector(a: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(a) == F.sequence(F.lit(0), F.size(a) - 1).cast("array<int>"))


def bracket(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def total(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
