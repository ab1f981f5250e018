"""Density noise: vectors with no dense neighbour within a radius.

Exact, without comparing all pairs. Vectors are put into nested grid cells, each with its bounding box and the
weight of its vectors. Cells are joined to cells from the coarsest level down: a pair whose farthest corners are in
reach adds its weight unseen, a pair whose nearest corners are out of reach drops, only the others are opened into
pairs of their children. A cell that has enough weight for sure, or could not get enough even with all open pairs,
is settled with everything in it and opens nothing. Children of a heavy cell are dealt to several keys, so that
no task holds all of them.
"""

from math import floor, log2

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from . import ranking

FINEST = 3  # halvings of the radius in the finest cells
SPLIT = 64  # children of a cell under one key; dealing adds at most one row for as many pairs
FEW = 1_000_000  # pairs that are compared without cells between the first one and the vectors


def _grid(vectors: DataFrame, features: list[str], eps: float) -> tuple[list[float], list[float]]:
    """Smallest value of each feature and the cell widths, halved from one cell for all down to a part of the radius."""
    found = vectors.agg(*[F.struct(F.min(f).alias("low"), (F.max(f) - F.min(f)).alias("span")).alias(f) for f in features]).first()
    span = max((found[f]["span"] or 0.0) for f in features)
    top = floor(log2(span / eps)) + 1 if span >= eps else 0  # the span is less than eps * 2 ** top
    return [found[f]["low"] or 0.0 for f in features], [eps * 2.0**k for k in range(top, -FINEST - 1, -1)]


def _cell(features: list[str], low: list[float], width: float) -> Column:
    """64-bit key of a vector's cell."""
    return F.xxhash64(*[F.floor((F.col(f) - F.lit(m)) / F.lit(width)) for f, m in zip(features, low, strict=True)])


def _levels(vectors: DataFrame, features: list[str], low: list[float], widths: list[float]) -> list[DataFrame]:
    """Cells of every level from the coarsest, the vectors last: id, parent, salt, parts, w and corners l, h of each."""
    up = F.array(*[_cell(features, low, w) for w in reversed(widths)])
    corners = [F.array(*features).alias(c) for c in "lh"]
    nodes = [vectors.select(F.col("vid").alias("id"), up.alias("up"), F.col("n").alias("w"), F.lit(1).alias("parts"), *corners)]
    for _ in widths:
        corners = [F.array(*[a(F.get(c, F.lit(k))) for k in range(len(features))]).alias(c) for c, a in (("l", F.min), ("h", F.max))]
        parts = F.ceil(F.count("*") / F.lit(SPLIT)).cast("int").alias("parts")
        above = F.min(F.slice("up", 2, len(widths))).alias("up")
        nodes.append(ranking.pinned(nodes[-1].groupBy(F.get("up", F.lit(0)).alias("id")).agg(above, F.sum("w").alias("w"), parts, *corners)))
    out = [nodes[-1]]
    for parents, children in zip(nodes[:0:-1], nodes[-2::-1], strict=True):
        own = parents.select(F.col("id").alias("parent"), F.col("parts").alias("keys"))
        placed = children.withColumn("parent", F.get("up", F.lit(0))).join(own, "parent")
        out.append(placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("keys"))).drop("keys", "up"))
    return out


def _opened(pairs: DataFrame, side: str, children: DataFrame) -> DataFrame:
    """Pairs with the cell of one side replaced by each of its children."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1))).withColumnRenamed(f"{side}_id", "parent")
    # A number given keeps small keys, which open into many pairs, from being merged into one task.
    keys = keys.drop(f"{side}_parts").repartition(tasks, "parent", "salt")
    named = children.select("parent", "salt", *[F.col(c).alias(f"{side}_{c}") for c in children.columns if c not in ("parent", "salt")])
    return keys.join(named, ["parent", "salt"]).drop("parent", "salt")


def _reach() -> tuple[Column, Column]:
    """Squared distances of the nearest and the farthest corners of both cells of a pair."""
    def squares(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x * x)

    gap = F.transform("p_l", lambda low, k: F.greatest(F.lit(0.0), F.get("c_l", k) - F.get("p_h", k), low - F.get("c_h", k)))
    far = F.transform("p_l", lambda low, k: F.greatest(F.get("c_h", k) - low, F.get("p_h", k) - F.get("c_l", k)))
    return squares(gap), squares(far)


def with_weight(probes: DataFrame, candidates: DataFrame, features: list[str], eps: float, need: int,
                grid: tuple[list[float], list[float]], compared: list[int] | None = None) -> DataFrame:
    """vid of the probes that have candidates of at least the weight `need` within eps.

    `compared` takes the number of pairs looked at on every level.
    """
    low, widths = grid
    if probes.count() * candidates.count() <= FEW:
        widths = widths[:1]
    left = _levels(probes, features, low, widths)
    right = left if candidates is probes else _levels(candidates, features, low, widths)
    near, far = _reach()
    roots = [side.select("id", F.col("parts").alias(f"{name}_parts")) for side, name in ((left[0], "p"), (right[0], "c"))]
    pairs = roots[0].join(roots[1], "id").select(F.col("id").alias("p_id"), "p_parts", F.col("id").alias("c_id"), "c_parts", F.lit(0).cast("long").alias("sure"))
    enough = None
    for level in range(1, len(left)):
        met = _opened(_opened(pairs, "p", left[level]), "c", right[level])
        seen = met.select("p_id", "p_parts", "c_id", "c_parts", "sure", "c_w", near.alias("near"), far.alias("far")).filter(F.col("near") <= eps * eps)
        if compared is not None:
            compared.append(met.count())
        seen = ranking.pinned(seen.withColumn("inside", F.col("far") <= eps * eps).drop("near", "far"))
        sure = F.max("sure") + F.sum(F.when(F.col("inside"), F.col("c_w")).otherwise(0))
        sums = seen.groupBy("p_id").agg(sure.alias("sure"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("c_w"))).alias("open"))
        found = sums.filter(F.col("sure") >= need).select(F.lit(level).alias("level"), F.col("p_id").alias("id"))
        enough = found if enough is None else enough.unionByName(found)
        unsure = sums.filter((F.col("sure") < need) & (F.col("sure") + F.col("open") >= need)).select("p_id", "sure")
        pairs = ranking.pinned(seen.filter(~F.col("inside")).drop("sure", "c_w", "inside").join(unsure, "p_id"))
        if pairs.isEmpty():
            break
    path = F.array(*[_cell(features, low, w) for w in widths[1:]], "vid")
    places = probes.select("vid", F.posexplode(path).alias("level", "id")).withColumn("level", F.col("level") + 1)
    return places.join(ranking.pinned(enough), ["level", "id"], "left_semi").select("vid").distinct()


def noise(scaled: DataFrame, features: list[str], eps: float = fixed.DENSITY_EPS, min_rows: int = fixed.DENSITY_MIN_ROWS,
          compared: list[int] | None = None) -> DataFrame:
    """The vectors with an `is_noise` flag; `n` is the number of rows behind each vector."""
    vectors = ranking.pinned(scaled.withColumn("vid", F.monotonically_increasing_id()))
    grid = _grid(vectors, features, eps)
    core = ranking.pinned(with_weight(vectors, vectors, features, eps, min_rows, grid, compared))
    others = ranking.pinned(vectors.join(core, "vid", "left_anti"))
    lonely = others.select("vid")
    if not others.isEmpty() and not core.isEmpty():
        reached = with_weight(others, vectors.join(core, "vid", "left_semi"), features, eps, 1, grid, compared)
        lonely = lonely.join(reached, "vid", "left_anti")
    return vectors.join(lonely.withColumn("is_noise", F.lit(True)), "vid", "left").withColumn("is_noise", F.coalesce("is_noise", F.lit(False))).drop("vid")
