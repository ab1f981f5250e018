"""Monitoring sources derived from the event table by integer arithmetic.

A machine has at most one `ping` row per slot after the first-row pick, so the rows of one
machine are limited by the length of the time grid (six per day) however many raw events it has.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, slots

UNREACHABLE_EVENT = "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ping_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reachability observation, duplicates of a slot included."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id"),
        F.expr("user_id AS id"),
        F.expr("concat('host-', lpad(CAST(user_id AS STRING), greatest(5, length(CAST(user_id AS STRING))), '0')) AS machine_name"),
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256) AS ip_address"),
        F.expr("ts AS event_time"),
        slots.slot_label(F.col("ts")).alias("monitoring_slot"),
        F.expr(f"IF(event_type = '{UNREACHABLE_EVENT}', 'Unreachable', 'Reachable') AS status"),
        F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k"),
        F.expr("event_type"),
        F.expr("value"),
    )


def _first_of_slot(raw: DataFrame) -> DataFrame:
    """Earliest row of each key, by a mergeable minimum: a hot machine is reduced before the shuffle."""
    first = F.min(F.struct("event_time", "event_id", "id", "status", "k")).alias("first")
    return raw.groupBy(*fixed.KEY).agg(first).select(*fixed.KEY, "first.*")


def ping_full(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Deduplicated observations, optionally of every n-th machine."""
    raw = ping_raw(spark, sf_dir)
    return _first_of_slot(raw if every == 1 else raw.filter(F.col("id") % every == 0))


def ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ping_full(spark, sf_dir).select(*fixed.CANONICAL_COLUMNS["ping"], "monitoring_slot")


def _state(component: str, shift: str, middle: str) -> str:
    position = fixed.COMPONENTS.index(component) + 1
    reading = f"(event_id * 7 + k * 13 + {position * 31} + {shift}) % 101"
    return f"""CASE WHEN {reading} = 0 THEN 'Critical' WHEN {reading} <= 2 THEN '{middle}'
               WHEN {reading} <= 6 THEN 'Degraded' ELSE 'OK' END AS {component}"""


def _problem_text() -> Column:
    parts = ", ".join(f"IF({c} <> 'OK', concat('{c} ', {c}), NULL)" for c in fixed.COMPONENTS)
    return F.expr(f"coalesce(nullif(concat_ws(';', {parts}), ''), 'No issues detected')")


def _hardware(spark, sf_dir, every: int, shift: str, middle: str, jitter: str) -> DataFrame:
    start = slots.slot_floor(F.col("event_time"))
    minutes = F.make_dt_interval(mins=F.expr(f"CAST({jitter} % 47 AS INT)"))
    return ping_full(spark, sf_dir, every).select(
        "id", "machine_name", "ip_address", "monitoring_slot", (start + minutes).alias("event_time"),
        *[F.expr(_state(c, shift, middle)) for c in fixed.COMPONENTS],
    ).withColumn("problems", _problem_text())


def hpe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hardware(spark, sf_dir, 4, "0", "OK", "k")
    return rows.withColumnRenamed("problems", "current_problems")


def dell_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hardware(spark, sf_dir, 2, "IF(k % 10 = 0, 17, 0)", "NOT OK", "k * 3")
    worst = ", ".join(f"CASE {c} WHEN 'Critical' THEN 2 WHEN 'OK' THEN 0 ELSE 1 END" for c in fixed.COMPONENTS)
    return rows.selectExpr(
        "*", "'OK' AS status",
        f"element_at(array('OK', 'Degraded', 'Critical'), greatest({worst}) + 1) AS overall_status",
        "problems AS issues_detected", "CAST(NULL AS STRING) AS comments",
    ).withColumnRenamed("problems", "current_problems")


def hpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpe_full(spark, sf_dir).select(*fixed.CANONICAL_COLUMNS["hpe"], "monitoring_slot")


def dell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dell_full(spark, sf_dir).select(*fixed.CANONICAL_COLUMNS["dell"], "monitoring_slot")


def raw_export(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The source under its raw export names."""
    frames = {"ping": ping_full, "hpe": hpe_full, "dell": dell_full}
    back = {new: old for old, new in fixed.CANONICAL_NAMES[source].items()}
    return frames[source](spark, sf_dir).withColumnsRenamed(back).select(*fixed.RAW_COLUMNS[source])


def text_time() -> Column:
    """Raw text form of the event time: mostly day first, some ISO, some unreadable."""
    return (
        F.when(F.col("event_id") % 97 == 0, "n/a")
        .when(F.col("event_id") % 50 == 0, F.date_format("event_time", fixed.ISO))
        .otherwise(F.date_format("event_time", fixed.DAY_FIRST))
    )


def ping_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations with text timestamps under the raw export names."""
    return ping_raw(spark, sf_dir).select(
        "event_id", "id",
        F.col("machine_name").alias("vm_name"), F.col("ip_address").alias("vm_ip"),
        "status", text_time().alias("timestamp"),
    )
