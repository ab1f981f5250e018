"""Rounding and guarded ratios."""

from pyspark.sql import Column, functions as F


def share(part: Column, whole: Column, scale: float = 1.0, digits: int = 6) -> Column:
    """part / whole times scale, null for an empty whole."""
    return F.round(F.lit(float(scale)) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def tally(condition: Column) -> Column:
    """Number of rows where the condition holds, as a bigint, 0 for no rows."""
    return F.count(F.when(condition, F.lit(1)))


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def bigints(df, *keep):
    """Integer and boolean-free view of a result: ints widened so both engines agree on types."""
    wide = [
        F.col(f"`{name}`").cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    return df.select(*wide)
