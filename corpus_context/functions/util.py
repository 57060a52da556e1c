from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Column from a Column or a column name."""
    return c if isinstance(c, Column) else F.col(c)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def array_of(values_or_col) -> Column:
    """A list of strings becomes a literal array; a Column is kept."""
    if isinstance(values_or_col, Column):
        return values_or_col
    return lit_array(list(values_or_col))
