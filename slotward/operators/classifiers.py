"""Failure classifiers: Spark ML pipelines and boosted trees; inputs are imputed on both sides."""

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..session import path_exists, shared_folder
from . import boosting, vectors

INPUTS = "model_inputs"

# Learner settings.
BOOSTED_SETTINGS = dict(maxIter=150, maxDepth=6, stepSize=0.05, rowShare=0.8, columnShare=0.8, seed=42)
FOREST_SETTINGS = dict(numTrees=100, maxDepth=10, seed=42)
LOGISTIC_SETTINGS = dict(maxIter=1000, elasticNetParam=0.0, standardization=False)


def check_features(features: list[str]) -> None:
    """Look-ahead columns and synthetic flags must not be model inputs."""
    leaks = [f for f in features if f.startswith(("target_", "helper_")) or "disagreement_flag" in f]
    if leaks:
        raise ValueError(f"not allowed as model inputs: {leaks}")


def _impute_stage(features: list[str]) -> SQLTransformer:
    def filled(f):
        value = fixed.HARDWARE_FILL if f in fixed.WORST_COLUMNS else 0
        return f"coalesce(CAST({f} AS DOUBLE), {float(value)}D) AS _{f}"

    return SQLTransformer(statement=f"SELECT *, {', '.join(filled(f) for f in features)} FROM __THIS__")


def _stages(features: list[str], learner, scale: bool = False) -> Pipeline:
    names = [f"_{f}" for f in features]
    raw = "raw_inputs" if scale else INPUTS
    stages = [_impute_stage(features), VectorAssembler(inputCols=names, outputCol=raw)]
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=INPUTS, withMean=True, withStd=True))
    return Pipeline(stages=stages + [learner])


def _totals(train: DataFrame) -> tuple[float, float]:
    row = train.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    return float(row[0] or 0.0), float(row[1] or 0.0)


def _weighted(train: DataFrame, zero: float, one: float) -> DataFrame:
    factor = F.when(F.col("label") == 1, one).otherwise(zero)
    return train.withColumn("fit_weight", F.col("weight") * factor)


def fit(rows: DataFrame, label: str, features: list[str], kind: str, **settings) -> PipelineModel | boosting.BoostedTrees:
    """Fit `logistic`, `forest` or `boosted` trees on labelled rows; a missing label counts as 0.

    `settings` override the learner's fixed settings.
    """
    check_features(features)
    if kind == "boosted":
        used = {**BOOSTED_SETTINGS, **settings}
        return boosting.fit(rows, label, features, used["maxIter"], used["maxDepth"], used["stepSize"],
                            used["rowShare"], used["columnShare"], used["seed"])
    shared_folder(rows.sparkSession)
    train = vectors.training_rows(rows, features, label)
    total, positive = _totals(train)
    negative = total - positive
    balanced = (total / (2 * max(negative, 1.0)), total / (2 * max(positive, 1.0)))
    common = dict(featuresCol=INPUTS, labelCol="label", weightCol="fit_weight")
    if kind == "logistic":
        learner = LogisticRegression(**{"regParam": 1.0 / max(total, 1.0), **LOGISTIC_SETTINGS, **common, **settings})
        return _stages(features, learner, scale=True).fit(_weighted(train, *balanced))
    if kind == "forest":
        return _stages(features, RandomForestClassifier(**{**FOREST_SETTINGS, **common, **settings})).fit(_weighted(train, *balanced))
    raise ValueError(f"unknown model kind {kind}")


def predict(model: PipelineModel | boosting.BoostedTrees, rows: DataFrame, name: str = "probability_of_failure") -> DataFrame:
    """Add the failure probability, rounded to nine digits."""
    if isinstance(model, boosting.BoostedTrees):
        return model.probability(rows, name)
    scored = model.transform(rows)
    helpers = [c for c in scored.columns if c not in rows.columns]
    return scored.withColumn(name, F.round(vector_to_array("probability")[1], 9)).drop(*helpers)


def save(model: PipelineModel | boosting.BoostedTrees, path: str) -> None:
    if isinstance(model, boosting.BoostedTrees):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | boosting.BoostedTrees:
    spark = SparkSession.active()
    if path_exists(spark, f"{path}/nodes"):
        return boosting.BoostedTrees.load(spark, path)
    return PipelineModel.load(path)


def save_metadata(spark, path: str, thresholds: dict[str, float]) -> None:
    """Feature order, imputation rules, cut-offs and tiers next to the models."""
    policy = {
        h: {"lookahead_window": p["lookahead_window"], "optimal_f1_threshold": thresholds.get(h, p["optimal_f1"]),
            "risk_tiers": {t[0]: {"min_prob": t[1], "max_prob": t[2], "action": t[3]} for t in p["tiers"]}}
        for h, p in fixed.RISK_POLICY.items()
    }
    document = {
        "detector_features": fixed.DETECTOR_FEATURES, "classifier_features": fixed.CLASSIFIER_FEATURES,
        "imputation": {"hardware_cols": fixed.WORST_COLUMNS, "hardware_value": fixed.HARDWARE_FILL,
                       "lag_cols": fixed.LAG_COLUMNS, "lag_value": fixed.LAG_FILL},
        "contamination": fixed.CONTAMINATION, "policy": policy,
    }
    spark.range(1).select(F.lit(json.dumps(document)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
