"""Helpers of this subpackage: reads, checkpoints in the shared folder, words, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

BLOCK = 64  # array items per step of `running`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lowered(words: Column) -> Column:
    """Lower-case array items. Whole texts are not lowered: outside ASCII that costs more than all the rest.

    ASCII items need no look for capitals first: their lower case is quick."""
    plain = lambda w: F.octet_length(w) == F.length(w)
    return F.transform(words, lambda w: F.when(plain(w) | w.rlike(r"\p{Lu}"), F.lower(w)).otherwise(w))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+")
    return lowered(F.filter(pieces, lambda w: w != ""))


def running(steps: Column) -> Column:
    """Running sums of an array, block by block, so that long arrays are not copied once per item."""
    zero = F.array(F.lit(0).cast("long"))

    def sums(items: Column) -> Column:
        return F.aggregate(items, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    count = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(steps, k * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, lambda b: F.slice(sums(b), 2, F.size(b)))
    pair = F.transform(F.array(inner), lambda s: F.struct(s.alias("s"), sums(F.transform(s, lambda b: F.element_at(b, -1))).alias("base")))
    moved = F.transform(pair, lambda p: F.flatten(F.transform(p["s"], lambda b, k: F.transform(b, lambda v: v + F.get(p["base"], k)))))
    return F.get(moved, F.lit(0))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The frame as a broadcast side if it is counted to have at most `rows` rows, as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of the edges, by contraction.

    Each round maps a node to the first of itself and its neighbours, in order of degree in even rounds, which
    folds stars at once, and in a fresh random order in odd rounds, by which expected node counts fall by a
    constant factor; then the edges are contracted. Nothing but whether edges are left reaches the driver.
    """
    edges = pinned(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a != b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("component", "near")
        weight = -F.count("*") if turn % 2 == 0 else F.lit(0)
        order = both.groupBy("component").agg(weight.alias("weight"))
        order = order.select("component", F.struct("weight", F.xxhash64(F.lit(turn), "component").alias("rank"), F.col("component").alias("node")).alias("own"))
        near = both.join(order.toDF("near", "other"), "near").groupBy("component").agg(F.min("other").alias("other"))
        step = pinned(near.join(order, "component").select("component", F.least("own", "other")["node"].alias("next")))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        start, end = step.toDF("a", "na"), step.toDF("b", "nb")
        moved = edges.join(start, "a").join(end, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        edges = pinned(moved.filter("a != b").distinct())
        turn += 1
    return pinned(labels)
