"""State changes between consecutive observations of a machine."""

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import share, tally
from .temporal import series

START = -1  # fixed value: stands for "no state"


def with_previous(rows: DataFrame, state: str) -> DataFrame:
    return rows.select("machine_name", F.col(state).alias("current"), F.lag(state, 1).over(series()).alias("previous"))


def transition_counts(rows: DataFrame, state: str, known_only: bool = False) -> DataFrame:
    """(previous, current, n); unknown states are START unless only known pairs are wanted."""
    pairs = with_previous(rows, state)
    pairs = pairs.dropna(subset=["previous", "current"]) if known_only else pairs.fillna(START, ["previous", "current"])
    return pairs.groupBy("previous", "current").agg(F.count("*").alias("n"))


def transition_matrix(counts: DataFrame, states: list[int]) -> DataFrame:
    """Crosstab form of transition counts over a fixed list of states."""
    cells = [F.coalesce(F.sum(F.when(F.col("current") == s, F.col("n"))), F.lit(0)).alias(f"to_{s}") for s in states]
    return counts.groupBy("previous").agg(*cells)


def volatile_machines(rows: DataFrame, state: str, known_only: bool = False) -> DataFrame:
    """Machines that ever change state, against all machines (with a known state)."""
    pairs = with_previous(rows, state)
    changed = F.col("current") != F.col("previous")
    per = pairs.groupBy("machine_name").agg(
        F.max(F.when(changed, 1).otherwise(0)).alias("moved"), F.count("current").alias("known")
    )
    seen = F.col("known") > 0 if known_only else F.lit(True)
    return per.agg(tally(F.col("moved") == 1).alias("volatile"), tally(seen).alias("machines")).select(
        F.lit(state).alias("signal"), "volatile", "machines"
    )


def predecessors(rows: DataFrame, state: str, reached: int) -> DataFrame:
    """Which known states precede the given state, with their share."""
    counts = transition_counts(rows, state, known_only=True).filter(F.col("current") == reached)
    whole = counts.agg(F.sum("n")).scalar()
    return counts.select("previous", "n", share(F.col("n"), whole, 100).alias("pct"))
