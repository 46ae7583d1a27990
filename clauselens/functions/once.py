"""Computing a costly column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns`` for columns that later expressions use many times.

    The optimiser merges neighbouring projections and moves filters below them,
    which repeats a plain column's expression at every use.  The output of a
    generator is never repeated, so the columns leave a one-element ``inline``.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))
