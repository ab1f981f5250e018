"""Positional windows of one machine: history features and look-ahead labels.

All windows share one partitioning and ordering, so the whole set is one exchange and one sort.
A partition is one machine's deduplicated slots: at most six rows per day of history.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed


def series():
    """Rows of one machine in slot order, with tie-breakers."""
    return Window.partitionBy("machine_name").orderBy(
        "monitoring_slot", "ip_address", "event_time_ping", "observation_id"
    )


def last_rows(n: int):
    """The current row and the n-1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def next_rows(n: int, start: int = 1):
    """Rows t+start .. t+n."""
    return series().rowsBetween(start, n)


def failing_now() -> Column:
    """Unreachable or a critical component; unknown stays unknown."""
    return ((F.col("ping_status_binary") == 1) | (F.col("critical_component_count") > 0)).cast("int")


def history_columns() -> dict[str, Column]:
    ping, problem = F.col("ping_status_binary"), F.col("has_active_problem")
    return {
        "ping_status_binary_lag1": F.lag(ping, 1).over(series()),
        "ping_status_binary_lag2": F.lag(ping, 2).over(series()),
        "ping_timeout_rate_3slot": F.avg(ping).over(last_rows(3)),
        "ping_timeout_rate_6slot": F.avg(ping).over(last_rows(6)),
        "problems_active_sum_6slot": F.sum(problem).over(last_rows(6)).cast("int"),
    }


def ahead_max(value: Column, n: int, start: int = 1) -> Column:
    """Largest future value in reach; null only when the series has no future value there."""
    return F.max(value).over(next_rows(n, start))


def label_columns() -> dict[str, Column]:
    failing, ping, critical = failing_now(), F.col("ping_status_binary"), F.col("critical_component_count")
    return {
        "helper_current_failure_state": failing,
        "target_failure_3slot": ahead_max(failing, 3),
        "target_failure_6slot": ahead_max(failing, 6),
        "target_network_alert_3slot": ahead_max(ping, 3),
        "target_hardware_failure_3slot": (ahead_max(critical, 3) >= 1).cast("int"),
    }


def history_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns(history_columns())


def labels(rows: DataFrame) -> DataFrame:
    return rows.withColumns(label_columns())


def build_master(row_features: DataFrame) -> DataFrame:
    """History and labels side by side, so that one window operator computes all frames."""
    return row_features.withColumns({**history_columns(), **label_columns()})


def latest_per_machine(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest row of each machine, by a mergeable maximum."""
    order = ["event_time_ping", "monitoring_slot", "ip_address", "observation_id"]
    rest = [c for c in (columns or rows.columns) if c not in order + ["machine_name"]]
    newest = F.max(F.struct(*order, *rest)).alias("newest")
    return rows.groupBy("machine_name").agg(newest).select("machine_name", "newest.*")


def recent_rows(rows: DataFrame, n: int) -> DataFrame:
    """Last n rows of each machine, numbered backwards in `age` (1 is the newest)."""
    backwards = Window.partitionBy("machine_name").orderBy(
        F.desc("event_time_ping"), F.desc("monitoring_slot"), F.desc("ip_address"), F.desc("observation_id")
    )
    return rows.withColumn("age", F.row_number().over(backwards)).filter(F.col("age") <= n)
