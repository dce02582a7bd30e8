"""Array column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.scalars import col


def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def mean(a) -> Column:
    a = col(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def std_pop(a) -> Column:
    a = col(a)
    m = mean(a)
    squares = F.transform(a, lambda x: (x.cast("double") - m) * (x.cast("double") - m))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def shift_grid(a, width: int, dx, dy) -> Column:
    """Row-major grid moved right by dx and down by dy cells; emptied cells are 0."""
    a, dx, dy = col(a), dx if isinstance(dx, Column) else F.lit(dx), dy if isinstance(dy, Column) else F.lit(dy)
    height = (F.size(a) / width).cast("int")

    def cell(i: Column) -> Column:
        x = i % width - dx
        y = F.floor(i / width).cast("int") - dy
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return F.when(inside, F.get(a, (y * width + x).cast("int"))).otherwise(F.lit(0.0).cast("float"))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), cell)


def to_columns(a: str, names: Sequence[str]) -> list[Column]:
    return [F.get(col(a), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
