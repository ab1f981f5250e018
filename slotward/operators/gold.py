"""Standardise the sources, join them on the slot grid, derive row features."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, health


def standardize(raw: DataFrame, source: str) -> DataFrame:
    """Raw export names to canonical names, keeping the canonical columns."""
    return raw.withColumnsRenamed(fixed.CANONICAL_NAMES[source]).select(*fixed.CANONICAL_COLUMNS[source])


def with_vendor_names(source_rows: DataFrame, source: str) -> DataFrame:
    """Prefix a source's columns with its name, keys untouched."""
    names = {c: f"{source}_{c}" for c in source_rows.columns if c not in fixed.KEY + ["event_time"]}
    names["event_time"] = f"event_time_{source}"
    return source_rows.withColumnsRenamed(names)


def join_sources(ping: DataFrame, hpe: DataFrame, dell: DataFrame) -> DataFrame:
    """Ping rows with the hardware readings of the same key; the key is unique in every source."""
    return (
        with_vendor_names(ping, "ping")
        .join(with_vendor_names(hpe, "hpe"), fixed.KEY, "left")
        .join(with_vendor_names(dell, "dell"), fixed.KEY, "left")
    )


def build_gold(ping: DataFrame, hpe: DataFrame, dell: DataFrame) -> DataFrame:
    has_hpe, has_dell = F.col("event_time_hpe").isNotNull(), F.col("event_time_dell").isNotNull()
    return join_sources(ping, hpe, dell).select(
        "*",
        F.lit(True).alias("has_ping"),
        has_hpe.alias("has_hpe"),
        has_dell.alias("has_dell"),
        health.source_tag(has_hpe, has_dell).alias("telemetry_source"),
        F.concat("machine_name", F.lit("|"), "ip_address", F.lit("|"), "monitoring_slot").alias("observation_id"),
    ).select(*fixed.GOLD_COLUMNS)


def row_features(gold: DataFrame) -> DataFrame:
    """Ranks, worst states, disagreement flags, counts and the active-problem flag."""
    ranks = {f"{v}_{c}_rank": health.severity(f"{v}_{c}") for c in fixed.COMPONENTS for v in ("hpe", "dell")}
    worst = {f"hardware_{c}_worst_status": F.greatest(f"hpe_{c}_rank", f"dell_{c}_rank") for c in fixed.COMPONENTS}
    flags = {f"hardware_{c}_disagreement_flag": health.disagreement(c) for c in fixed.COMPONENTS}
    counts = {name: health.count_at(fixed.WORST_COLUMNS, rank) for name, rank in zip(fixed.COUNT_COLUMNS, (3, 2, 1))}
    any_bad = F.greatest(*fixed.COUNT_COLUMNS) > 0
    ping_down = F.coalesce(F.col("ping_status_binary") == 1, F.lit(False))
    return (
        gold.withColumns({"ping_status_binary": health.ping_code("ping_status"), **ranks})
        .withColumns(worst)
        .withColumns({**flags, **counts})
        .withColumn("has_active_problem", (any_bad | ping_down).cast("int"))
    )
