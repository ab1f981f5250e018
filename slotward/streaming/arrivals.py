"""Arriving ping observations joined with the hardware tables and merged into gold.

Every delivery is reduced to the earliest event per key, joined, and merged with the stored rows of the days it
touches; the earliest event of a key wins, however late it arrives, so gold equals the batch result whatever
the order of deliveries. Only touched days are read and rewritten, and a delivery that is processed again
changes nothing.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..operators import gold as gold_ops
from ..operators.ranking import pinned
from ..session import path_exists

DAY = "slot_date"


def earliest(rows: DataFrame, time: str) -> DataFrame:
    """The row of the earliest event of every key; equal times go by the other columns."""
    others = [c for c in rows.columns if c not in fixed.KEY and c != time]
    first = F.min(F.struct(F.col(time).isNull().alias("_none"), time, *others)).alias("first")
    return rows.groupBy(*fixed.KEY).agg(first).select(*[c if c in fixed.KEY else F.col("first")[c].alias(c) for c in rows.columns])


def merge_gold(ping: DataFrame, hpe: DataFrame, dell: DataFrame, path: str) -> None:
    """Merge one delivery of canonical ping rows into the gold table at `path`, laid out by day."""
    spark = ping.sparkSession
    fresh = pinned(gold_ops.build_gold(earliest(ping, "event_time"), hpe, dell).withColumn(DAY, F.substring("monitoring_slot", 1, 10)))
    if path_exists(spark, path):
        days = [r[DAY] for r in fresh.select(DAY).distinct().collect()]  # a delivery touches few days
        stored = spark.read.schema(fresh.schema).parquet(path).filter(F.col(DAY).isin(days))
        fresh = pinned(earliest(stored.select(fresh.columns).unionByName(fresh), "event_time_ping"))
    fresh.hint("rebalance", F.col(DAY)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def append_gold(ping: DataFrame, hpe: DataFrame, dell: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; run again for the next delivery. `ping` is a stream in canonical form."""
    return (
        ping.writeStream.foreachBatch(lambda batch, _number: merge_gold(batch, hpe, dell, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
