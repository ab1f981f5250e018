"""Incident profiles and feature screening on the master table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, health
from ..functions.numbers import share, tally, total
from . import profile, shape


def incident_predicates() -> dict[str, Column]:
    return {
        "hardware_critical": F.col("critical_component_count") > 0,
        "network_dropout": F.col("ping_status_binary") == 1,
        "chronic_24h": F.col("ping_timeout_rate_6slot") == 1.0,
        "chronic_12h": F.col("ping_timeout_rate_3slot") == 1.0,
        "problem_accumulation": F.col("problems_active_sum_6slot") >= 3,
        "current_incident": F.col("helper_current_failure_state") == 1,
        "pre_failure_12h": F.col("target_failure_3slot") == 1,
    }


def incident_profile(master: DataFrame) -> DataFrame:
    """Rows and machines per incident definition; counted per machine first, so no distinct is needed."""
    tests = incident_predicates()
    per = master.groupBy("machine_name").agg(F.count("*").alias("rows"), *[tally(p).alias(n) for n, p in tests.items()])
    whole = per.agg(
        F.sum("rows").alias("_rows"),
        *[F.sum(n).alias(n) for n in tests], *[tally(F.col(n) > 0).alias(f"{n}_m") for n in tests],
    )
    return shape.rows_of(whole, [
        {"incident": F.lit(n), "rows": F.col(n), "machines": F.col(f"{n}_m"), "pct": share(F.col(n), F.col("_rows"), 100)}
        for n in tests
    ])


RATE_THRESHOLDS = [0.01, 0.33, 0.66, 1.0]  # fixed values


def threshold_counts(master: DataFrame) -> DataFrame:
    """Rows reaching each rate threshold, all thresholds in one pass."""
    grid = [(c, t) for c in fixed.RATE_COLUMNS for t in RATE_THRESHOLDS]
    counted = master.agg(F.count("*").alias("_rows"), *[tally(F.col(c) >= t).alias(f"n{i}") for i, (c, t) in enumerate(grid)])
    return shape.rows_of(counted, [
        {"feature": F.lit(c), "threshold": F.lit(t), "rows": F.col(f"n{i}"), "pct": share(F.col(f"n{i}"), F.col("_rows"), 100)}
        for i, (c, t) in enumerate(grid)
    ])


def has_sensors() -> Column:
    return F.col("has_hpe") | F.col("has_dell")


def feature_profile(master: DataFrame) -> DataFrame:
    """Severity breaches over all rows and per-component breaches on rows with hardware sensors."""
    metrics = {
        "problem sum >= 1": F.col("problems_active_sum_6slot") >= 1,
        "degraded rows": F.col("degraded_component_count") > 0,
        "not ok rows": F.col("not_ok_component_count") > 0,
        "critical rows": F.col("critical_component_count") > 0,
        "hardware rows": has_sensors(),
    }
    for c in fixed.COMPONENTS:
        worst = F.col(f"hardware_{c}_worst_status")
        metrics[f"{c} critical"] = has_sensors() & (worst == 3)
        metrics[f"{c} not ok"] = has_sensors() & (worst == 2)
    counted = master.agg(F.count("*").alias("_rows"), *[tally(p).alias(n) for n, p in metrics.items()])
    return shape.rows_of(counted, [
        {"metric": F.lit(n), "rows": F.col(n), "pct": share(F.col(n), F.col("_rows"), 100)} for n in metrics
    ])


def class_means(rows: DataFrame, label: str, features: list[str], floor: float = 0.0, absolute: bool = False) -> DataFrame:
    """Mean of each feature where the label is 0 and 1, and their ratio when the base is large enough."""
    wide = rows.agg(*[
        F.avg(F.when(F.col(label) == k, F.col(f).cast("double"))).alias(f"{f}_{k}") for f in features for k in (0, 1)
    ])

    def row(f):
        zero, one = F.col(f"{f}_0"), F.col(f"{f}_1")
        base = F.abs(zero) if absolute else zero
        return {"feature": F.lit(f), "mean_0": F.round(zero, 6), "mean_1": F.round(one, 6),
                "lift": F.round(F.when(base > floor, one / F.when(base > floor, zero)), 6)}

    return shape.rows_of(wide, [row(f) for f in features])


def anomaly_drivers(rows: DataFrame, flag: str, features: list[str], top: int = 10) -> DataFrame:
    """Features with the highest mean among flagged rows, on the values before imputation."""
    means = class_means(rows, flag, features, 1e-5, absolute=True)
    return means.orderBy(F.desc_nulls_last("mean_1"), "feature").limit(top)


def constant_features(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features with at most one value, null counted as a value."""
    seen = profile.column_values(rows, features).groupBy("column_name").agg(F.count("*").alias("values"))
    return seen.filter(F.col("values") <= 1).select(F.col("column_name").alias("feature"), "values")


def missing_profile(rows: DataFrame, features: list[str]) -> DataFrame:
    counted = rows.agg(F.count("*").alias("_rows"), *[tally(F.col(f).isNull()).alias(f) for f in features])
    long = shape.rows_of(counted, [
        {"feature": F.lit(f), "null_count": F.col(f), "null_pct": share(F.col(f), F.col("_rows"), 100)} for f in features
    ])
    return long.filter(F.col("null_count") > 0)


def mutual_information(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Discrete mutual information (nats) of each imputed feature with the label, labelled rows only.

    Rows collapse to (feature, value, label) counts before anything is grouped per feature.
    """
    known = rows.filter(F.col(label).isNotNull())
    values = known.select(F.col(label).alias("y"), *[F.round(c, 6).alias(n) for n, c in zip(features, health.imputed(features))])
    cells = values.unpivot(["y"], features, "feature", "value").groupBy("feature", "value", "y").agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy("feature")).cast("double")
    nx = F.sum("n").over(Window.partitionBy("feature", "value")).cast("double")
    ny = F.sum("n").over(Window.partitionBy("feature", "y")).cast("double")
    term = F.col("n") / n * F.ln(F.col("n") * n / (nx * ny))
    return cells.select("feature", term.alias("term")).groupBy("feature").agg(F.round(F.sum("term"), 6).alias("mi"))


def standard_scaling(rows: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per imputed feature; a constant column is divided by 1."""
    values = rows.select(*health.imputed(features, fill_rest=True))
    wide = values.agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features])
    return shape.rows_of(wide, [
        {"feature": F.lit(f), "mean": F.round(f"{f}_m", 6),
         "scale": F.round(F.when(F.col(f"{f}_s") == 0, 1.0).otherwise(F.col(f"{f}_s")), 6)} for f in features
    ])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights and the positive scale; rows without label count as 0."""
    y = F.coalesce(F.col(label), F.lit(0))
    counted = rows.agg(F.count("*").alias("rows"), total(y).alias("positives"))
    negatives = F.col("rows") - F.col("positives")
    return counted.select(
        F.lit(label).alias("label"), "rows", "positives", negatives.alias("negatives"),
        share(F.col("rows"), negatives * 2).alias("weight_0"), share(F.col("rows"), F.col("positives") * 2).alias("weight_1"),
        share(negatives, F.greatest("positives", F.lit(1))).alias("scale_pos_weight"),
    )
