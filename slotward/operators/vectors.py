"""Distinct feature vectors with their row counts.

Detectors and linear models see nothing of a row but its features, so equal rows are handled once
with a weight: the hot all-healthy vector is reduced before the shuffle and costs one row afterwards.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, health
from . import ranking

TRAINING_ROWS = 1_000_000  # rows a training table is brought down to, weights kept
ROWS_PER_TASK = 20_000  # training rows per partition


def baselines() -> dict[str, Column]:
    """Incident definitions the detectors are compared with."""
    return {
        "helper": F.col("helper_current_failure_state") == 1,
        "hw": F.col("critical_component_count") > 0,
        "net": F.col("ping_status_binary") == 1,
        "chronic": F.col("ping_timeout_rate_6slot") == 1.0,
        "accum": F.col("problems_active_sum_6slot") >= 3,
        "target": F.col("target_failure_3slot") == 1,
    }


def collapse(rows: DataFrame, features: list[str], counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct imputed vector: the features, `n`, and one count per condition."""
    conditions = {f"_{k}": F.coalesce(v.cast("int"), F.lit(0)) for k, v in (counts or {}).items()}
    named = rows.select(*health.imputed(features, fill_rest=True), *[v.alias(k) for k, v in conditions.items()])
    sums = [F.sum(k).alias(k[1:]) for k in conditions]
    return named.groupBy(*features).agg(F.count("*").alias("n"), *sums)


def scaled(vectors: DataFrame, features: list[str]) -> DataFrame:
    """Population-standardised features from weighted sums; a constant column is divided by 1."""
    n = F.sum("n")
    stats = vectors.agg(*[
        F.struct((F.sum(F.col(f) * F.col("n")) / n).alias("m"), (F.sum(F.col(f) * F.col(f) * F.col("n")) / n).alias("q")).alias(f)
        for f in features
    ]).first()  # one row of means, however large the table
    out = []
    for f in features:
        variance = max(stats[f]["q"] - stats[f]["m"] ** 2, 0.0)
        spread = variance ** 0.5 if variance > 1e-12 else 1.0
        out.append(((F.col(f) - stats[f]["m"]) / spread).alias(f))
    rest = [c for c in vectors.columns if c not in features]
    return vectors.select(*out, *rest)


def labelled(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row per distinct imputed vector and `label` (a missing label counts as 0), with its number of rows `n`."""
    y = F.coalesce(F.col(label), F.lit(0)).cast("double").alias("label")
    return rows.select(*health.imputed(features, fill_rest=True), y).groupBy(*features, "label").agg(F.count("*").alias("n"))


def training_rows(rows: DataFrame, features: list[str], label: str, target: int = TRAINING_ROWS) -> DataFrame:
    """Weighted training rows: features, `label`, `weight`.

    Up to `target` rows nothing changes. Beyond it equal rows are merged, and a heavy group is
    split again into equal parts, so that row sampling inside the learners still works on small
    pieces. The weights always add up to the number of rows.
    """
    groups = ranking.pinned(labelled(rows, features, label))
    total, distinct = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    part = max(1, -(-total // target))
    pieces = F.ceil(F.col("n") / part)
    rows_out = distinct + total // part
    split = groups.withColumn("piece", F.explode(F.sequence(F.lit(1), pieces))).select(
        *features, "label", (F.col("n") / pieces).alias("weight")
    )
    return split.repartition(max(1, -(-rows_out // ROWS_PER_TASK)))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a batch and, for every row, its place among them; rows are told apart by their bytes."""
    x = np.ascontiguousarray(x, float)
    whole = x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, places = np.unique(whole, return_index=True, return_inverse=True)
    return x[first], places
