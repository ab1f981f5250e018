"""Additive explanations of boosted trees (path-dependent Shapley values).

A leaf's share of the prediction depends only on which of the at most `depth` features on its path
a row satisfies. Those patterns are enumerated once per leaf, and a row then only looks its pattern
up, so a batch of rows costs one comparison per path feature.
"""

from collections.abc import Iterator
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import health
from . import vectors
from .boosting import BoostedTrees


def tree_nodes(model: BoostedTrees, spark) -> pd.DataFrame:
    """Node table of boosted trees; a leaf's value times `tree_weight` is its share of the margin, half the log-odds."""
    return model.nodes.assign(tree_weight=0.5)


def _leaf_paths(tree: pd.DataFrame) -> list[tuple]:
    """(value, {feature: (low, high, share of training weight)}) of every leaf."""
    rows = {r.node: r for r in tree.itertuples()}
    out, waiting = [], [(0, {})]
    while waiting:
        at, path = waiting.pop()
        here = rows[at]
        if here.left < 0:
            out.append((here.value * here.tree_weight, path))
            continue
        low, high, kept = path.get(here.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((here.left, (low, min(high, here.threshold))), (here.right, (max(low, here.threshold), high))):
            part = rows[child].cover / here.cover if here.cover else 0.0
            waiting.append((child, path | {here.feature: (*bounds, kept * part)}))
    return out


def _pattern_shares(shares: np.ndarray) -> np.ndarray:
    """Shapley share of each path feature for every satisfied / unsatisfied pattern, leaf value 1."""
    d = len(shares)
    patterns = np.array(list(product([0.0, 1.0], repeat=d)))
    out = np.zeros((2 ** d, d))
    weights = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
    for i in range(d):
        others = [j for j in range(d) if j != i]
        size = np.zeros((2 ** d, d))  # coefficient k: subsets of k other features, rest left to chance
        size[:, 0] = 1.0
        for j in others:
            size[:, 1:] = size[:, 1:] * shares[j] + size[:, :-1] * patterns[:, [j]]
            size[:, 0] = size[:, 0] * shares[j]
        out[:, i] = (patterns[:, i] - shares[i]) * (size @ np.array(weights))
    return out


class Explainer:
    """Contributions in log-odds; the base value is the weighted mean prediction of the trees."""

    def __init__(self, nodes: pd.DataFrame, features: list[str]):
        self.features, self.leaves, self.base = features, [], 0.0
        for _, tree in nodes.groupby("tree"):
            for value, path in _leaf_paths(tree):
                value = 2.0 * value  # margins to log-odds
                order = list(path)
                low, high, share = (np.array([path[f][k] for f in order]) for k in range(3))
                self.base += value * float(np.prod(share)) if order else value
                if order:
                    bits = 2 ** np.arange(len(order) - 1, -1, -1)
                    self.leaves.append((order, low, high, bits, value * _pattern_shares(share)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        x, places = vectors.distinct(x)
        out = np.zeros((len(x), len(self.features)))
        for order, low, high, bits, table in self.leaves:
            part = x[:, order]
            pattern = ((part > low) & (part <= high)) @ bits
            out[:, order] += table[pattern]
        return out[places]


def explain(rows: DataFrame, model: BoostedTrees, features: list[str]) -> DataFrame:
    """Add `base_value` and `contributions` (one number per feature, in feature order)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tree_nodes(model, spark))
    filled = rows.withColumns({f"_in_{f}": c for f, c in zip(features, health.imputed(features, fill_rest=True))})
    inputs = [f"_in_{f}" for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explainer = None
        for batch in batches:
            explainer = explainer or Explainer(shared.value, features)
            found = explainer.contributions(batch[inputs].to_numpy(float))
            yield batch.drop(columns=inputs).assign(base_value=explainer.base, contributions=list(np.round(found, 9)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return filled.mapInPandas(run, f"{kinds}, base_value double, contributions array<double>")


def drivers(explained: DataFrame, features: list[str], top: int = 6, positive: int = 4, negative: int = 3) -> DataFrame:
    """Strongest contributions per row: overall, towards failure and towards normal."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[F.round(c, 4) for c in health.imputed(features, fill_rest=True)])
    entry = lambda n, v, c: F.struct(
        (-F.abs(F.round(c, 4))).alias("order"), n.alias("feature"), v.alias("value"), F.round(c, 4).alias("contribution"))
    zipped = F.arrays_zip(names.alias("n"), values.alias("v"), F.col("contributions").alias("c"))
    ordered = F.array_sort(F.transform(zipped, lambda z: entry(z["n"], z["v"], z["c"])))
    rows = explained.withColumn("_ordered", ordered)
    return rows.withColumns({
        "top_drivers": F.slice("_ordered", 1, top),
        "positive_drivers": F.slice(F.filter("_ordered", lambda x: x["contribution"] > 0), 1, positive),
        "protective_factors": F.slice(F.filter("_ordered", lambda x: x["contribution"] < 0), 1, negative),
    }).drop("_ordered")


def global_importance(explained: DataFrame, features: list[str], weight: str = "n") -> DataFrame:
    """Mean absolute contribution per feature over weighted vectors."""
    n = F.sum(weight)
    wide = explained.agg(*[
        (F.sum(F.abs(F.col("contributions")[i]) * F.col(weight)) / n).alias(f) for i, f in enumerate(features)
    ])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.round(f, 4).alias("mean_abs_contribution")) for f in features])))
    return long.orderBy(F.desc("mean_abs_contribution"), "feature")


def case_studies(explained: DataFrame, features: list[str], label: str, probability: str, cases: int = 2) -> DataFrame:
    """First true positives with a probability of at least one half, with their positive drivers."""
    hits = explained.filter((F.col(label) == 1) & (F.col(probability) >= 0.5)).orderBy("observation_id").limit(cases)
    numbered = drivers(hits, features).withColumn("case_id", F.row_number().over(Window.orderBy("observation_id")))
    return numbered.select("case_id", "observation_id", F.round(F.col(probability) * 100, 1).alias("probability_pct"), "positive_drivers")


def sensor_notes(drivers_column: str = "positive_drivers"):
    """A note for every driver that says a sensor is missing rather than that hardware failed."""
    missing = F.filter(drivers_column, lambda x: (x["value"] == -1) & x["feature"].contains("status"))
    return F.transform(missing, lambda x: F.concat(
        F.lit("Note on '"), x["feature"], F.lit(" = -1': sensor missing or unmonitored, not a confirmed hardware failure.")))
