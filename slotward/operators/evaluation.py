"""Detector and classifier quality from aggregated counts."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import share
from . import ranking, shape


def detector_metrics(vectors: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per detector from weighted vectors that carry `n` and the baseline counts."""
    bases = ["helper", "hw", "net", "chronic", "accum", "target"]
    have = [b for b in bases if b in vectors.columns]
    sums = [F.sum("n").alias("_n")] + [F.sum(b).alias(f"_{b}") for b in have]
    for i, flag in enumerate(flags.values()):
        on = lambda c: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0))  # noqa: B023,E731 - used at once
        sums += [on("n").alias(f"f{i}_n")] + [on(b).alias(f"f{i}_{b}") for b in have]
    wide = vectors.agg(*sums)

    def row(i, name):
        alerts, hits = F.col(f"f{i}_n"), F.col(f"f{i}_helper")
        false = alerts - hits
        out = {"detector": F.lit(name), "alerts": alerts, "true_positives": hits, "false_positives": false,
               "alert_pct": share(alerts, F.col("_n"), 100),
               "precision_pct": F.coalesce(share(hits, alerts, 100), F.lit(0.0)),
               "false_positive_rate_pct": share(false, F.col("_n") - F.col("_helper"), 100)}
        return out | {f"recall_{b}_pct": share(F.col(f"f{i}_{b}"), F.col(f"_{b}"), 100) for b in have}

    return shape.rows_of(wide, [row(i, name) for i, name in enumerate(flags)])


def score_totals(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Running true and false positives from the highest score down, one row per distinct score."""
    y = F.coalesce(F.col(label), F.lit(0)).cast("bigint")
    groups = scored.select(F.col(probability).alias("threshold"), y.alias("y")).groupBy("threshold").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    return ranking.running_totals(groups, [F.desc("threshold")], {"tp": "pos", "fp": "neg"})


def curve(totals: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate at every distinct score."""
    whole = totals.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n"))).scalar()
    return totals.select(
        "threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif(whole["p"], F.lit(0))).alias("recall"), (F.col("fp") / F.nullif(whole["n"], F.lit(0))).alias("fpr"),
    )


def areas(totals: DataFrame) -> DataFrame:
    """PR-AUC (from recall 0 at precision 1) and ROC-AUC by trapezoids; each row knows its predecessor."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = tp / (tp + fp)
    before = F.when(tp0 + fp0 > 0, tp0 / F.when(tp0 + fp0 > 0, tp0 + fp0)).otherwise(1.0)
    pr = F.sum((tp - tp0) * (precision + before) / 2)
    roc = F.sum((fp - fp0) * (tp + tp0) / 2)
    positives, negatives = F.max(tp), F.max(fp)
    return totals.agg(
        F.round(pr / F.nullif(positives, F.lit(0.0)), 6).alias("pr_auc"),
        F.round(roc / F.nullif(positives * negatives, F.lit(0.0)), 6).alias("roc_auc"),
    )


def at_threshold(scored: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Confusion matrix, precision, recall and F1 in percent; 0 where a denominator is 0."""
    y, hit = F.coalesce(F.col(label), F.lit(0)) == 1, F.col(probability) >= threshold
    cell = lambda c: F.count(F.when(c, 1))
    counted = scored.agg(cell(~y & ~hit).alias("tn"), cell(~y & hit).alias("fp"), cell(y & ~hit).alias("fn"), cell(y & hit).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counted.select(
        "tn", "fp", "fn", "tp", zero(share(tp, tp + fp, 100)).alias("precision_pct"),
        zero(share(tp, tp + fn, 100)).alias("recall_pct"), zero(share(2 * tp, 2 * tp + fp + fn, 100)).alias("f1_pct"),
    )


def best_f1(totals: DataFrame) -> DataFrame:
    """Score cut with the highest F1, the lowest one on ties."""
    points = curve(totals)
    p, r = F.col("precision"), F.coalesce("recall", F.lit(0.0))
    f1 = F.round(2 * p * r / (p + r + 1e-9), 12)
    best = points.withColumn("f1", f1).orderBy(F.desc("f1"), "threshold").limit(1)
    return best.select(
        F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("optimal_threshold"),
        F.round(F.col("f1") * 100, 6).alias("optimal_f1_pct"), F.round(p * 100, 6).alias("optimal_precision_pct"),
        F.round(r * 100, 6).alias("optimal_recall_pct"),
    )


def report(scored: DataFrame, label: str, probability: str, model: str, threshold: float = 0.5) -> DataFrame:
    """All quality numbers of one model in one row."""
    totals = score_totals(scored, label, probability)
    base, extra = at_threshold(scored, label, probability, threshold), []
    for part in (areas(totals), best_f1(totals)):
        row = part.select(F.struct("*")).scalar()
        extra += [row[c].alias(c) for c in part.columns]
    return base.select(F.lit(model).alias("model"), "*", *extra)
