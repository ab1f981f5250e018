"""Global positions and running totals without a single-task window.

Rows are range-partitioned and sorted, each block is numbered on its own, and the block offsets
(one small row per block) are added. The range boundaries are sampled, so the sorted blocks are
checkpointed once: both the rows and the offsets then come from the same blocks, also after a
lost executor.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder

BLOCK_SHIFT = 33  # fixed value: bits of the in-partition counter of monotonically_increasing_id


def pinned(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder; later reads do not recompute them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _sorted_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = pinned(ordered.withColumn("_row", F.monotonically_increasing_id()))
    return tagged.withColumn("_block", F.shiftright("_row", BLOCK_SHIFT))


def _offsets(block_totals: DataFrame, names: list[str]) -> DataFrame:
    """Totals of all earlier blocks; one row per block of the range partitioning."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifted = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names]
    return block_totals.select("_block", *shifted)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in the total order given (ties broken by the order itself)."""
    blocks = _sorted_blocks(df, order)
    in_block = F.col("_row") - F.shiftleft(F.col("_block"), BLOCK_SHIFT) + 1
    offsets = _offsets(blocks.groupBy("_block").agg(F.count("*").alias("n")), ["n"])
    placed = blocks.join(F.broadcast(offsets), "_block")
    return placed.withColumn(name, F.col("_before_n") + in_block).drop("_row", "_block", "_before_n")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sum of each column in the global order; names map result -> column."""
    blocks = _sorted_blocks(df, order)
    columns = list(dict.fromkeys(sums.values()))
    totals = blocks.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns])
    within = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumns({f"_in_{c}": F.sum(c).over(within) for c in columns})
    joined = local.join(F.broadcast(_offsets(totals, columns)), "_block")
    out = {name: F.col(f"_before_{c}") + F.col(f"_in_{c}") for name, c in sums.items()}
    helpers = [f"{p}_{c}" for c in columns for p in ("_in", "_before")]
    return joined.withColumns(out).drop("_row", "_block", *helpers)


def percentiles_of(placed: DataFrame, value: str, shares: dict[str, float]) -> dict[str, float]:
    """Linearly interpolated percentiles from distinct values and their running count `upto`.

    Only the count and two values per percentile reach the driver.
    """
    size = placed.agg(F.max("upto")).first()[0]
    if not size:
        return dict.fromkeys(shares)
    ranks = {name: q * (size - 1) for name, q in shares.items()}
    ends = [(name, end, int(rank) + (end == "high" and rank > int(rank))) for name, rank in ranks.items() for end in ("low", "high")]
    found = placed.agg(*[F.min(F.when(F.col("upto") > at, F.col(value))).alias(f"{end}_{name}") for name, end, at in ends]).first()
    return {
        name: float(found[f"low_{name}"]) + (float(found[f"high_{name}"]) - float(found[f"low_{name}"])) * (rank - int(rank))
        for name, rank in ranks.items()
    }


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], weight: str | None = None) -> dict[str, float]:
    """Exact percentiles of a column, each under its given name; `weight` counts a row several times."""
    n = F.sum(weight) if weight else F.count("*")
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(n.alias("n"))
    return percentiles_of(running_totals(counted, [F.col(value)], {"upto": "n"}), value, shares)
