"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(id_col: str, parts: int) -> Column:
    """The block of a vertex: its id modulo the number of blocks."""
    return F.pmod(F.col(id_col), F.lit(parts)).cast("long")


def chunks(values: Column, n: int) -> Column:
    """An array cut into n runs whose lengths differ by one at most, the longer ones first."""
    size = F.size(values)
    small, more = F.floor(size / n).cast("int"), (size % n).cast("int")
    begin = lambda i: i * small + F.least(i, more) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(values, begin(i), small + (i < more).cast("int")))
