"""Set comparisons of machine inventories across sources."""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import tally


def presence(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per distinct key with a flag per source."""
    tagged = [
        df.select(*keys).dropna().distinct().withColumn("source", F.lit(name)) for name, df in frames.items()
    ]
    together = reduce(DataFrame.unionByName, tagged)
    flags = [F.max((F.col("source") == name).cast("int")).alias(f"in_{name}") for name in frames]
    return together.groupBy(*keys).agg(*flags)


def _label(keys):
    return F.concat_ws("|", *keys)


def _first(rows: DataFrame, group: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy("label")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("sample"))


def _counted(rows: DataFrame, group: str, names: list[str], k: int) -> DataFrame:
    """Count and first labels per group, groups without members included."""
    counts = rows.agg(*[tally(F.col(group) == n).alias(n) for n in names])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias(group), F.col(f"`{n}`").alias("n")) for n in names])))
    return long.join(_first(rows, group, k), group, "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def overlaps(frames: dict[str, DataFrame], keys: list[str], sample: int = 5, all_sample: int = 10) -> DataFrame:
    """Intersections of every pair of sources and of all of them."""
    present = presence(frames, keys).withColumn("label", _label(keys))
    groups = {f"{a} & {b}": (a, b) for a, b in combinations(frames, 2)}
    groups["all"] = tuple(frames)
    inside = F.array_compact(F.array(*[
        F.when(reduce(lambda x, y: x & y, [F.col(f"in_{s}") == 1 for s in members]), name)
        for name, members in groups.items()
    ]))
    rows = present.select("label", F.explode(inside).alias("combination"))
    pairs = _counted(rows, "combination", list(groups), sample)
    full = _first(rows.filter(F.col("combination") == "all"), "combination", all_sample)
    return pairs.join(full.withColumnRenamed("sample", "all_sample"), "combination", "left").select(
        "combination", "n", F.coalesce("all_sample", "sample").alias("sample")
    )


def only_in_one(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys found in exactly one source."""
    flags = [F.col(f"in_{s}") for s in frames]
    where = F.coalesce(*[F.when(F.col(f"in_{s}") == 1, s) for s in frames])
    return presence(frames, keys).filter(sum(flags, F.lit(0)) == 1).select(*keys, where.alias("source"))


def containment(part: DataFrame, whole: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """Is every key of `part` in `whole`? Offenders are counted and sampled."""
    missing = part.select(F.col(key).alias("k")).dropna().distinct().join(
        whole.select(F.col(key).alias("k")).distinct(), "k", "left_anti"
    )
    shown = missing.orderBy("k").limit(sample).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("k"))).cast("array<string>"), ", ")
    )
    return missing.agg(F.count("*").alias("missing_keys")).select(
        "missing_keys", (F.col("missing_keys") == 0).alias("is_subset"), shown.scalar().alias("sample")
    )


def segments(ping: DataFrame, hpe: DataFrame, dell: DataFrame) -> DataFrame:
    """Machines and observations of the common, one-vendor and ping-only segments."""
    machine = ["machine_name"]
    flags = presence({"ping": ping, "hpe": hpe, "dell": dell}, machine)
    h, d = F.col("in_hpe") == 1, F.col("in_dell") == 1
    name = F.when(h & d, "common").when(d, "dell only").when(h, "hpe only").otherwise("ping only")
    counts = ping.groupBy(*machine).agg(F.count("*").alias("n"))
    placed = flags.filter(F.col("in_ping") == 1).join(counts, machine)
    return placed.groupBy(name.alias("segment")).agg(
        F.count("*").alias("machines"), F.sum("n").alias("observations")
    )


def same_partner(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Do two sources give each shared key the same value?"""
    a = left.select(key, F.col(value).alias("a")).distinct()
    b = right.select(key, F.col(value).alias("b")).distinct()
    return a.join(b, key).agg(
        F.count("*").alias("overlapping"), tally(F.col("a") == F.col("b")).alias("same"),
        tally(F.col("a") != F.col("b")).alias("different"),
    )
