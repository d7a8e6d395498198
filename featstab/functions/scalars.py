"""Column helpers shared by the operators: keyed hashing, average ranks, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def keyed(*parts: object) -> Column:
    """md5 of the parts joined by colons: the source of every pseudo-random order."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *(c.cast("string") for c in columns)).cast("binary"))


def keyed_int(*parts: object) -> Column:
    """The first 32 bits of keyed() as a number."""
    return F.conv(F.substring(keyed(*parts), 1, 8), 16, 10).cast("long")


def average_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1 in rising order; ties get their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / F.lit(2.0)


def scaled_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Average rank scaled to [0, 1]; 1 where there is one row alone."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n > 1, (average_rank(x, by) - 1) / (n - 1)).otherwise(average_rank(x, by))


def percent_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Average rank over the number of rows."""
    return average_rank(x, by) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and without a negative zero, integers as long."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        shown.append(c.alias(name))
    return df.select(*shown)
