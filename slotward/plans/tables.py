"""DataFrames the registered queries start from."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import gold as gold_ops
from ..operators import temporal
from ..session import folder_state
from ..sources import binding


def planned_once(build):
    """Keep the (lazy) plan per session and state of the folder: composing it again costs more than planning it."""
    plans: dict = {}

    @wraps(build)
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        state = folder_state(spark, sf_dir)
        if key not in plans or plans[key][0] != state:
            plans[key] = state, build(spark, sf_dir)
        return plans[key][1]

    return table


@planned_once
def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_ops.build_gold(
        binding.ping(spark, sf_dir), binding.hpe(spark, sf_dir), binding.dell(spark, sf_dir)
    )


@planned_once
def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_ops.row_features(gold(spark, sf_dir))


@planned_once
def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.build_master(stage(spark, sf_dir))


def latest(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return temporal.latest_per_machine(master(spark, sf_dir), columns)


FLEET_COLUMNS = ["ping_timeout_rate_3slot", "ping_timeout_rate_6slot", "critical_component_count"]


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows with stand-in scores, for the reports that need no fitted model.

    The newest row is a maximum of structs, which Spark does not prune, so only the columns of the scores go in.
    """
    rate = F.col("ping_timeout_rate_6slot")
    return latest(spark, sf_dir, FLEET_COLUMNS).withColumns({
        "score": F.round(rate + F.lit(0.01) * F.col("critical_component_count"), 6),
        "p12": F.round(rate, 6),
        "p24": F.round("ping_timeout_rate_3slot", 6),
    })
