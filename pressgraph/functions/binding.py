"""Naming a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The planner may inline a column into every place that refers to it, most
    of all when it pushes a filter down.  A bound value is one reference, so
    nested rules stay linear in size.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def fixed(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns, or replace them, that are computed where they stand.

    A filter on an ordinary column is pushed to the scan with the whole rule
    behind the column copied into it, once for each reference on the way.
    Filters stop at a generator, here of one row, and columns are not inlined
    through it.
    """
    d = df.withColumn("_fixed", F.explode_outer(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
    kept = [F.col(c) for c in df.columns if c not in values]
    return d.select(*kept, *[F.col("_fixed")[n].alias(n) for n in values])
