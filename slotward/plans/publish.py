"""End-to-end publication: gold, certificate, features. Later steps read what earlier ones wrote."""

from pyspark.sql import DataFrame, functions as F

from ..operators import audits, gold as gold_ops, temporal
from ..sources import sinks


def slot_day():
    return F.substring("monitoring_slot", 1, 10)


def publish_gold(ping: DataFrame, hpe: DataFrame, dell: DataFrame, folder: str, sizes: dict, distribution: dict) -> DataFrame:
    """Write gold by day, audit the written table, write the certificate, stop on a failed check.

    The audit's passes then read only the columns they need instead of repeating the join.
    """
    spark = ping.sparkSession
    sinks.publish_parquet(gold_ops.build_gold(ping, hpe, dell), f"{folder}/gold", slot_day())
    gold = spark.read.parquet(f"{folder}/gold").drop("slot_date")
    sinks.publish_parquet(audits.certificate(gold, sizes, distribution), f"{folder}/certificate")
    sinks.publish_summary(gold, f"{folder}/summary")
    audits.require(spark.read.parquet(f"{folder}/certificate"))
    return gold


def publish_master(gold: DataFrame, folder: str) -> DataFrame:
    """Row features, history features and labels as the master table, written by day."""
    master = temporal.build_master(gold_ops.row_features(gold))
    sinks.publish_parquet(master, f"{folder}/master", slot_day())
    return gold.sparkSession.read.parquet(f"{folder}/master").drop("slot_date")
