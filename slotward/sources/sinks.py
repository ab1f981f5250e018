"""Publishing tables and checking what was written."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import tally


def publish_parquet(df: DataFrame, path: str, day: Column | None = None) -> None:
    """Parquet, laid out by day when one is given so that time filters prune folders.

    Days are rebalanced: small ones share a task and a busy one is split by the size of its data.
    """
    if day is None:
        df.write.mode("overwrite").parquet(path)
        return
    df.withColumn("slot_date", day).hint("rebalance", F.col("slot_date")).write.mode("overwrite").partitionBy("slot_date").parquet(path)


def publish_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def summary(gold: DataFrame) -> DataFrame:
    """Rows, columns, machines, slots and rows per source tag, counted per (machine, tag) first."""
    slots_seen = gold.select("monitoring_slot").distinct().agg(F.count("*")).scalar()
    per = gold.groupBy("machine_name", "telemetry_source").agg(F.count("*").alias("n"))
    machines = per.select("machine_name").distinct().agg(F.count("*")).scalar()
    tags = ["Ping Only", "Ping + Dell", "Ping + HPE", "Ping + HPE + Dell"]  # fixed values
    name = lambda t: t.lower().replace(" + ", "_").replace(" ", "_") + "_rows"
    return per.agg(
        F.sum("n").alias("rows"),
        *[F.coalesce(F.sum(F.when(F.col("telemetry_source") == t, F.col("n"))), F.lit(0)).alias(name(t)) for t in tags],
    ).select(
        "*", machines.alias("machines"), slots_seen.alias("slots"), F.lit(len(gold.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(gold.columns)).alias("column_names"),
    )


def publish_summary(gold: DataFrame, path: str) -> None:
    summary(gold).coalesce(1).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum over all columns."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("checksum"), F.lit(len(df.columns)).alias("columns"))


def verify_written(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Do count, schema and content of the stored table equal what was meant to be written?"""
    same_schema = dict(source.dtypes) == dict(stored.dtypes)
    both = fingerprint(source).withColumn("side", F.lit("source")).unionByName(
        fingerprint(stored.select(*source.columns)).withColumn("side", F.lit("stored")))
    side = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    return both.agg(
        side("source", "rows").alias("source_rows"), side("stored", "rows").alias("stored_rows"),
        (tally(F.col("rows").isNotNull()) == 2).alias("both_read"),
        (side("source", "checksum") == side("stored", "checksum")).alias("same_content"),
    ).withColumn("same_schema", F.lit(same_schema))
