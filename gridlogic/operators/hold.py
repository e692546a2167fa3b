"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once per row: through a generator, so that the optimizer does not copy their expressions into the
    functions that use them for every element."""
    for name, expression in columns.items():
        df = df.select("*", F.explode(F.array(expression)).alias(name))
    return df


def once_each(rows: DataFrame, key: str, make) -> DataFrame:
    """rows with the columns that make adds to a table of key alone, made once for each distinct value and joined back; rows that make leaves out go. For work that
    depends on little of a row, such as a small graph that many rows share; where all keys differ, it costs a shuffle more."""
    return rows.join(make(rows.select(key).distinct()), key)
