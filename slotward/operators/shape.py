"""Turning one wide row into many narrow ones."""

from pyspark.sql import Column, DataFrame, functions as F


def rows_of(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Emit one output row per dict for every input row."""
    entries = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*entries)))


def one_row(df: DataFrame, **values: Column) -> Column:
    """A struct of aggregates of df, usable as a scalar in another frame."""
    return df.agg(F.struct(*[v.alias(k) for k, v in values.items()]).alias("row")).select("row").scalar()
