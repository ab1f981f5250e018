"""Isolation forest: trees on small hashed samples, scores from a compact node table."""

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, health

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"
EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) from a hash."""
    return F.pmod(F.shiftright(F.xxhash64(*parts), 11), F.lit(1 << 53)) / F.lit(float(1 << 53))


def drawn_trees(key: str, trees: int, share: float, seed: int) -> Column:
    """Trees that draw a row, each with probability `share` on its own.

    One hash gives their number by the inverse of the binomial distribution, and that is all for most rows of a
    large table; a further hash per tree picks distinct trees, each new pick that is taken giving way to the
    highest number allowed (Floyd's sampling).
    """
    none = F.array().cast("array<int>")
    if share >= 1:
        return F.sequence(F.lit(0), F.lit(trees - 1))
    upto, total = [], 0.0
    for k in range(trees):
        total += comb(trees, k) * share**k * (1 - share) ** (trees - k)
        upto.append(total)
        if 1 - total < 1e-15:
            break
    u = _uniform(F.col(key), F.lit(seed))
    number = F.size(F.filter(F.array(*map(F.lit, upto)), lambda c: c <= u))

    def pick(chosen: Column, j: Column) -> Column:
        t = F.floor(_uniform(F.col(key), j, F.lit(seed + 2)) * (j + 1)).cast("int")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    picked = F.aggregate(F.sequence(F.lit(trees) - number, F.lit(trees - 1)), none, pick)
    return F.when(u < F.lit(upto[0]), none).otherwise(picked)


def tree_samples(rows: DataFrame, features: list[str], key: str, trees: int, sample: int, seed: int, size: int) -> DataFrame:
    """At most `sample` of all `size` rows per tree, chosen by hashes of the row key, so partitioning does not matter.

    About 2 * sample * trees rows leave the scan whatever the size of the table.
    """
    share = min(1.0, 2.0 * sample / max(size, 1))
    picked = rows.withColumn("_trees", drawn_trees(key, trees, share, seed)).filter(F.size("_trees") > 0)
    drawn = picked.select(key, *health.imputed(features, fill_rest=True), F.explode("_trees").alias("tree"))
    drawn = drawn.withColumn("draw", F.xxhash64(F.col(key), "tree", F.lit(seed + 1)))
    order = Window.partitionBy("tree").orderBy("draw", key)
    return drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample)


def _grow(x: np.ndarray, limit: int, rng) -> list[tuple]:
    nodes, waiting = [], [(np.arange(len(x)), 0, None, False)]
    while waiting:
        members, depth, parent, is_right = waiting.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(members)))])
        if parent is not None:
            nodes[parent][3 if is_right else 2] = me
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) < 2 or not len(usable):
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = part[:, feature] <= cut
        nodes[me][:2] = [feature, cut]
        waiting.append((members[~below], depth + 1, me, True))
        waiting.append((members[below], depth + 1, me, False))
    return nodes


def fit(rows: DataFrame, features: list[str], key: str = "observation_id", trees: int = fixed.FOREST_TREES,
        sample: int = fixed.FOREST_SAMPLE, seed: int = 42) -> DataFrame:
    """Node table of the forest: at most trees * (2 * sample - 1) rows."""
    size = rows.count()
    limit = int(np.ceil(np.log2(max(min(sample, size), 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("rank")
        tree = int(ordered["tree"].iloc[0])
        nodes = _grow(ordered[features].to_numpy(float), limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return tree_samples(rows, features, key, trees, sample, seed, size).groupBy("tree").applyInPandas(build, NODE_SCHEMA)


class Forest:
    """Node arrays of a fitted forest and the vectorised score."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = [
            tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
            for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")
        ]
        # A root's depth is the mean path among the rows its tree has seen.
        self.scale = float(np.mean([t[4][0] for t in self.trees])) if self.trees else 1.0

    def depth(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of every row."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, threshold, left, right, depth in self.trees:
            at = np.zeros(len(x), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                below = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
                inner = feature[at] >= 0
            total += depth[at]
        return total / max(len(self.trees), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(2.0 ** (-self.depth(x) / max(self.scale, 1e-9)), 9)


def score(rows: DataFrame, nodes: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """Add the isolation score (higher is more unusual); features must be imputed already.

    The node table has a size fixed by the forest's parameters, so it travels with the tasks.
    """
    table = nodes.toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(shared.value)
        for batch in batches:
            yield batch.assign(**{name: forest.score(batch[features].to_numpy(float))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, `{name}` double")
