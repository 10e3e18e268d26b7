"""Small tables beside large ones: their size is checked before they are sent out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a dimension may have.
MOST = 10_000


def checked(small: DataFrame, most: int = MOST) -> DataFrame:
    """A table of at most ``most`` rows, which may go out to all tasks; more are an error, not a plan."""
    if small.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of more than {most} rows: {small.columns}")
    return F.broadcast(small)


def times(df: DataFrame, small: DataFrame, most: int = MOST) -> DataFrame:
    """Every row of df with every row of a small table, whose size is checked and which is broadcast."""
    return df.crossJoin(checked(small, most))
