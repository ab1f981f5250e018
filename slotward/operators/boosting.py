"""Second-order gradient boosting on binned features, all levels of all trees in one Spark stage.

Equal rows are merged to weighted vectors, each feature is cut once into at most 256 bins, and the
binned vectors are dealt to the tasks of one barrier stage, which hold them while the trees grow. At a
level every task sums gradients and hessians of its own vectors per (node, feature, bin), the tasks
exchange these sums (`BarrierTaskContext.allGather`) and pick the same splits from them. What is
exchanged depends on depth, features, bins and tasks, not on the number of vectors; nothing but the
node table reaches the driver program. A lost task restarts the stage, whose input is checkpointed.

Null features are imputed, a null label is 0; without rows, or without anything to split, the
probability is one half. Sums are exact (multiples of 2**-20), so the trees depend neither on the
partitioning nor on the order of rows.
"""

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions import health
from ..session import shared_folder
from . import ranking, vectors

BINS = 256
BLOCK_ROWS = 50_000  # weighted vectors per task, as long as there are free cores
GRAIN = float(1 << 20)
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
KEPT_MARGINS = 64  # blocks whose margins a Python worker remembers

# Regularisation of leaves, smallest hessian of a child, smallest gain of a split.
LEAF_PENALTY, CHILD_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6

_margins: dict = {}  # in a worker: block -> (trees added, margins)


class Tree(NamedTuple):
    """A tree in heap order: children of node i are 2i + 1 and 2i + 2, `feature` is -1 in a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # last bin that goes left
    value: np.ndarray  # log-odds, learning rate included
    cover: np.ndarray  # hessian sum

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size), np.zeros(size))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of every vector after `levels` steps; a vector in a leaf stays there."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            at = self.below(bins, at)
        return at

    def below(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Node of every vector one step further down."""
        feature = self.feature[at]
        down = 2 * at + 1 + (bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.cut[at])
        return np.where(feature >= 0, down, at)


class Block(NamedTuple):
    """Vectors of one partition: bin numbers, hash keys, labels, row counts, class weights."""

    name: tuple
    bins: np.ndarray
    key: np.ndarray
    label: np.ndarray
    count: np.ndarray
    scale: np.ndarray


# --- bins --------------------------------------------------------------------------------------

def cut_points(table: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Thresholds between neighbouring bins of each feature; up to `bins` values each has a bin of its own.

    Values are counted per feature and ranked with global running totals, so neither a window nor the
    driver sees all values of a feature; at most `bins` rows per feature are brought to the driver.
    """
    long = table.select("n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])))
    counted = long.groupBy("f", "v").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    placed = ranking.pinned(ranking.running_totals(counted, [F.col("f"), F.col("v")], {"upto": "n", "place": "one"}))
    of_feature = placed.groupBy("f").agg(F.count("*").alias("values"), F.sum("n").alias("total"), F.min("place").alias("first"),
                                         F.min(F.col("upto") - F.col("n")).alias("before"))
    share = (F.col("upto") - F.col("before") - F.col("n") / 2) / F.col("total")
    bin_of = F.when(F.col("values") <= bins, F.col("place") - F.col("first")).otherwise(F.floor(share * bins))
    ends = placed.join(F.broadcast(of_feature), "f").groupBy("f", bin_of.alias("b")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    found = ends.toPandas().sort_values(["f", "b"])
    out = []
    for i in range(len(features)):
        part = found[found.f == i]
        below, above = part.high.to_numpy(float)[:-1], part.low.to_numpy(float)[1:]
        with np.errstate(invalid="ignore"):
            middle = below + (above - below) / 2
        out.append(np.where(np.isfinite(middle), middle, below))  # next to infinities and NaN the lower value is the cut
    return out


def _block(batches: Iterator[pa.RecordBatch], name: tuple, features: list[str], cuts: list[np.ndarray], positive: float) -> Block:
    """The vectors of a task; batches are binned as they come."""
    parts = []
    for batch in batches:
        column = lambda c, kind: batch.column(c).to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023,E731 - used at once
        bins = np.empty((batch.num_rows, len(features)), np.int16, order="F")
        for i, (f, c) in enumerate(zip(features, cuts, strict=True)):
            bins[:, i] = np.searchsorted(c, column(f, float), side="left")
        parts.append((bins, column("key", np.int64).view(np.uint64), column("label", float), column("n", float)))
    none = (np.empty((0, len(features)), np.int16), np.empty(0, np.uint64), np.empty(0), np.empty(0))
    bins, key, label, count = map(np.concatenate, zip(*parts or [none], strict=True))
    return Block(name, np.asfortranarray(bins), key, label, count, np.where(label == 1, positive, 1.0))


# --- one level ---------------------------------------------------------------------------------

def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys and a stream number (finaliser of a splittable generator)."""
    z = key + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def sampled_counts(block: Block, share: float, number: int) -> np.ndarray:
    """Rows of each vector that a round uses: whole numbers with mean share * count, a single row with probability `share`."""
    return np.floor(share * block.count + uniform(block.key, number))


def _margin(block: Block, trees: list[Tree], depth: int) -> np.ndarray:
    done, margin = _margins.pop(block.name, (0, None))
    if margin is None or done > len(trees) or len(margin) != len(block.bins):
        done, margin = 0, np.zeros(len(block.bins))
    for tree in trees[done:]:
        margin = margin + tree.value[tree.places(block.bins, depth)]
    _margins[block.name] = len(trees), margin
    while len(_margins) > KEPT_MARGINS:
        _margins.pop(next(iter(_margins)))
    return margin


def _level_sums(block: Block, slopes: list[np.ndarray], at: np.ndarray, nodes: int, columns: np.ndarray,
                starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of gradients and hessians, in grains, of a block per place (`at`; below 0: none) and bin of each column."""
    used = np.flatnonzero(at >= 0)
    place, own = at[used], [s[used] for s in slopes]
    out = np.zeros((2, nodes, int(sizes.sum())))
    for c in columns:
        cell = place * sizes[c] + block.bins[used, c]
        for sums, s in zip(out, own, strict=True):
            sums[:, starts[c]:starts[c] + sizes[c]] = np.bincount(cell, s, nodes * sizes[c]).reshape(nodes, sizes[c])
    return out


def _exchanged(sums: np.ndarray) -> np.ndarray:
    """The sums of all tasks of the stage; whole numbers, so their order does not matter."""
    packed = base64.b64encode(zlib.compress(sums.astype(np.int64).tobytes(), 1)).decode("ascii")
    parts = BarrierTaskContext.get().allGather(packed)
    return sum(np.frombuffer(zlib.decompress(base64.b64decode(p)), np.int64) for p in parts).reshape(sums.shape).astype(float)


def _pick_splits(tree: Tree, sums: np.ndarray, level: int, columns: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rate: float) -> bool:
    """Write the best split of each node of the level and its children's values into the tree; False if none was found."""
    first, found = 2**level - 1, False
    spans = [slice(starts[c], starts[c] + sizes[c]) for c in columns]
    left = np.full(sums.shape, np.nan)
    for span in spans:
        left[:, :, span] = np.cumsum(sums[:, :, span], axis=2)
        left[:, :, span.stop - 1] = np.nan  # nothing would go right
    total = sums[:, :, spans[0]].sum(axis=2)
    right = total[:, :, None] - left
    score = lambda s: s[0] ** 2 / (s[1] + LEAF_PENALTY)
    gain = score(left) + score(right) - score(total)[:, None]
    gain[~((left[1] >= CHILD_HESSIAN) & (right[1] >= CHILD_HESSIAN))] = -np.inf
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(len(gain)):
        node, best = first + i, int(np.argmax(gain[i]))
        if level == 0:
            tree.value[0], tree.cover[0] = -rate * total[0, 0] / (total[1, 0] + LEAF_PENALTY), total[1, 0]
        if gain[i, best] <= LEAST_GAIN:
            continue
        found = True
        tree.feature[node], tree.cut[node] = owner[best], best - starts[owner[best]]
        for child, (g, h) in ((2 * node + 1, left[:, i, best]), (2 * node + 2, right[:, i, best])):
            tree.value[child], tree.cover[child] = -rate * g / (h + LEAF_PENALTY), h
    return found


def _columns(features: int, share: float, seed: int, number: int) -> np.ndarray:
    """Features a round may split on, drawn by hash."""
    draw = uniform(np.arange(features, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003), number)
    return np.sort(np.argsort(draw, kind="stable")[:max(1, int(share * features))])


def grow(block: Block, merged: Callable[[np.ndarray], np.ndarray], sizes: np.ndarray, rounds: int, depth: int, rate: float,
         row_share: float, column_share: float, seed: int) -> list[Tree]:
    """The trees, from a task's own vectors and `merged`, which turns its sums into those of all tasks.

    Of two siblings only the left one is summed, the right one is the rest of the parent; whole numbers make that exact.
    """
    starts, trees = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), []
    for number in range(rounds):
        tree, columns = Tree.empty(depth), _columns(len(sizes), column_share, seed, number)
        p = 1.0 / (1.0 + np.exp(-_margin(block, trees, depth)))
        weight = sampled_counts(block, row_share, seed + number) * block.scale
        slopes = [np.rint(s * weight * GRAIN) for s in (p - block.label, np.maximum(p * (1 - p), 1e-16))]
        at, sums = np.zeros(len(block.bins), np.int64), None
        for level in range(depth):
            place = at - (2**level - 1)  # below 0 in a leaf further up
            place = np.where((weight > 0) & (place >= 0) & ((level == 0) | (place % 2 == 0)), place // 2, -1)
            left = merged(_level_sums(block, slopes, place, max(1, 2**(level - 1)), columns, starts, sizes))
            if level:
                parents = np.arange(2**(level - 1) - 1, 2**level - 1)
                rest = np.where((tree.feature[parents] >= 0)[None, :, None], sums - left, 0.0)
                left = np.stack([left, rest], axis=2).reshape(2, 2**level, -1)
            sums = left
            if not _pick_splits(tree, sums / GRAIN, level, columns, starts, sizes, rate):
                break
            at = tree.below(block.bins, at)
        trees.append(tree)
    return trees


# --- the model ---------------------------------------------------------------------------------

def _node_table(trees: list[Tree], cuts: list[np.ndarray]) -> pd.DataFrame:
    """Reachable nodes of all trees; leaves have feature and children -1."""
    rows = []
    for number, tree in enumerate(trees):
        waiting = [0]
        while waiting:
            i = waiting.pop()
            f = int(tree.feature[i])
            inner = f >= 0
            rows.append((number, i, f, float(cuts[f][tree.cut[i]]) if inner else 0.0, 2 * i + 1 if inner else -1,
                         2 * i + 2 if inner else -1, 0.0 if inner else float(tree.value[i]), float(tree.cover[i])))
            waiting += [2 * i + 2, 2 * i + 1] if inner else []
    kinds = dict(tree="int32", node="int32", feature="int32", threshold=float, left="int32", right="int32", value=float, cover=float)
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


class BoostedTrees:
    """Features in order and the node table, whose size is fixed by rounds and depth."""

    def __init__(self, features: list[str], nodes: pd.DataFrame):
        self.features, self.nodes = features, nodes.sort_values(["tree", "node"], ignore_index=True)
        self._arrays = []
        for _, t in self.nodes.groupby("tree"):
            size = int(t.node.max()) + 1
            arrays = [np.full(size, fill, kind) for fill, kind in ((-1, np.int64), (0, float), (-1, np.int64), (-1, np.int64), (0, float))]
            for array, name in zip(arrays, ("feature", "threshold", "left", "right", "value"), strict=True):
                array[t.node.to_numpy()] = t[name].to_numpy()
            self._arrays.append(arrays)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        x, places = vectors.distinct(x)
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, threshold, left, right, value in self._arrays:
            at = np.zeros(len(x), np.int64)
            inner = feature[at] >= 0
            while inner.any():
                below = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
                inner = feature[at] >= 0
            total += value[at]
        return total[places]

    def probability(self, rows: DataFrame, name: str) -> DataFrame:
        """Add the probability of label 1, rounded to nine digits; only the features pass through Python."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(np.round(1.0 / (1.0 + np.exp(-shared.value.log_odds(np.column_stack(columns)))), 9))

        inputs = [c.cast("double") for c in health.imputed(self.features, fill_rest=True)]
        return rows.withColumn(name, scored(*inputs))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(i, f) for i, f in enumerate(self.features)], "place int, feature string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/features")
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark, path: str) -> "BoostedTrees":
        named = spark.read.parquet(f"{path}/features").orderBy("place").toPandas()
        return cls(named.feature.tolist(), spark.read.parquet(f"{path}/nodes").toPandas())


def fit(rows: DataFrame, label: str, features: list[str], rounds: int = 150, depth: int = 6, rate: float = 0.05,
        row_share: float = 0.8, column_share: float = 0.8, seed: int = 42, block_rows: int = BLOCK_ROWS) -> BoostedTrees:
    """Boosted trees on labelled rows; the rarer positives weigh as much as all negatives together."""
    spark = rows.sparkSession
    shared_folder(spark)
    merged = ranking.pinned(vectors.labelled(rows, features, label))
    size, total, positive = merged.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("label")), F.lit(0))).first()
    if not size:
        return BoostedTrees(features, _node_table([], []))
    cuts = cut_points(merged, features)
    scale = float((total - positive) / max(positive, 1))
    tasks = min(-(-size // block_rows), max(1, spark.sparkContext.defaultParallelism // 2))  # a stage waits for so many free cores
    keyed = merged.withColumn("key", F.xxhash64(*features, "label")).repartition(tasks, "key")
    name, sizes = uuid.uuid4().hex, np.array([len(c) + 1 for c in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = BarrierTaskContext.get().partitionId() if tasks > 1 else 0
        block = _block(batches, (name, place), features, cuts, scale)
        trees = grow(block, _exchanged if tasks > 1 else np.asarray, sizes, rounds, depth, rate, row_share, column_share, seed)
        _margins.pop(block.name, None)
        if place == 0:  # every task has the same trees
            yield pa.RecordBatch.from_pandas(_node_table(trees, cuts), preserve_index=False)

    inputs = keyed.select("key", "label", "n", *[F.col(f).cast("double").alias(f) for f in features])
    return BoostedTrees(features, inputs.mapInArrow(run, NODE_SCHEMA, barrier=tasks > 1).toPandas())
