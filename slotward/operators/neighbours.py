"""Mutual information of continuous columns with a label by nearest neighbours inside the class.

Works on (value, label, count) cells: the distance to the k-th neighbour comes from the cells next to
each one, the rows closer than that from running totals over the sorted values. Where k rows of the
class share the value, the distance is zero and the rows at the value itself are compared, so ties
give the discrete information. No group holds more than 2k + 1 cells and no window sees a whole column.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import health
from . import ranking

GRAIN = 1_000_000  # values are read to six digits, so that distances are whole numbers


def digamma(x: Column) -> Column:
    """Digamma of a number of at least 1: six steps up, then the asymptotic series."""
    z = x + F.lit(6.0)
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    for step in range(6):
        series = series - 1 / (x + F.lit(float(step)))
    return series


def _cells(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, y, v (value in grains), n; labels held by a single row are left out."""
    known = rows.filter(F.col(label).isNotNull())
    values = known.select(F.col(label).alias("y"), *[
        F.round(c * GRAIN).cast("long").alias(f) for f, c in zip(features, health.imputed(features, fill_rest=True), strict=True)])
    counted = values.unpivot(["y"], features, "feature", "v").groupBy("feature", "v", "y").agg(F.count("*").alias("n"))
    classes = counted.groupBy("feature", "y").agg(F.sum("n").alias("n_y")).filter("n_y > 1")
    return ranking.pinned(counted.join(classes, ["feature", "y"]))


def _reach(cells: DataFrame, k: int) -> DataFrame:
    """Cells with `near`, the number of neighbours asked for, and `r`, the distance to the last of them."""
    placed = ranking.with_position(cells, [F.col("feature"), F.col("y"), F.col("v")])
    around = placed.withColumn("step", F.explode(F.sequence(F.lit(-k), F.lit(k)))).groupBy(
        "feature", "y", (F.col("position") + F.col("step")).alias("at")).agg(
        F.collect_list(F.struct("v", F.when(F.col("step") == 0, F.col("n") - 1).otherwise(F.col("n")).alias("n"))).alias("cells"),
        *[F.max(F.when(F.col("step") == 0, F.col(c))).alias(c) for c in ("v", "n", "n_y")]).filter(F.col("v").isNotNull())
    near = F.least(F.lit(k), F.col("n_y") - 1)
    by_distance = F.array_sort(F.transform("cells", lambda c: F.struct(F.abs(c["v"] - F.col("v")).alias("d"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("r"))
    walked = F.aggregate(by_distance, start, lambda s, c: F.when(s["seen"] >= F.col("near"), s).otherwise(
        F.struct((s["seen"] + c["n"]).alias("seen"), c["d"].alias("r"))))
    return around.withColumn("near", near).withColumn("r", walked["r"]).select("feature", "y", "v", "n", "n_y", "near", "r")


def _within(reached: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of any label closer than `r` (at the value itself where r is 0) as `m`, the row itself counted.

    The ends of every interval are sorted in between the values and take the running total there.
    """
    values = cells.groupBy("feature", "v").agg(F.sum("n").alias("w")).select(
        "feature", F.col("v").alias("x"), F.lit(1).alias("turn"), "w", F.lit(0).alias("sign"), F.lit(None).cast("long").alias("v"), F.lit(None).alias("y"))
    tie = F.col("r") == 0
    ends = F.array(
        F.struct((F.col("v") + F.col("r")).alias("x"), F.when(tie, 2).otherwise(0).alias("turn"), F.lit(1).alias("sign")),
        F.struct((F.col("v") - F.col("r")).alias("x"), F.when(tie, 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign")))
    asked = reached.select("feature", "v", "y", F.inline(ends)).withColumn("w", F.lit(0).cast("long"))
    totals = ranking.running_totals(values.unionByName(asked), [F.col(c) for c in ("feature", "x", "turn", "y", "v", "sign")], {"upto": "w"})
    return totals.filter("sign <> 0").groupBy("feature", "y", "v").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))


def information(rows: DataFrame, label: str, features: list[str], k: int = 3) -> DataFrame:
    """feature, mi in nats (never below zero), labelled rows only; nulls are imputed. No labelled rows, no result."""
    cells = _cells(rows, label, features)
    reached = ranking.pinned(_reach(cells, k))
    found = reached.join(_within(reached, cells), ["feature", "y", "v"])
    tie = F.col("r") == 0
    share = digamma(F.when(tie, F.col("n") - 1).otherwise(F.col("near"))) - digamma(F.col("n_y")) - digamma(F.when(tie, F.col("m") - 1).otherwise(F.col("m")))
    total = F.sum("n").cast("double")
    return found.withColumn("term", F.col("n") * share).groupBy("feature").agg(
        F.round(F.greatest(digamma(total) + F.sum("term") / total, F.lit(0.0)), 6).alias("mi"))
