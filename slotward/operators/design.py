"""Design: features and labels the reference describes in its documents without code.

Windows follow the same per-machine series as the built features.
"""

from math import pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, health, slots
from . import temporal

# Diagnostic phrases.
PHRASES = {"has_power_redundancy_loss": "Power supply redundancy is lost",
           "has_thermal_throttling": "CPU 1 throttling due to thermal threshold",
           "has_disk_array_warning": "Disk array controller"}
WEEK = 42  # rows of seven days


def warning_score() -> Column:
    """Sum of the ordinal ranks over the six components."""
    return F.expr(" + ".join(f"coalesce({c}, 0)" for c in fixed.WORST_COLUMNS))


def changed(state: str) -> Column:
    """1 where the state differs from the row before."""
    return F.coalesce((F.col(state) != F.lag(state, 1).over(temporal.series())).cast("int"), F.lit(0))


def forward_filled(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Component states carried over at most `reach` rows, with a flag where that happened."""
    past = temporal.series().rowsBetween(-reach, 0)
    filled = {f"{c}_filled": F.last(c, ignorenulls=True).over(past) for c in fixed.WORST_COLUMNS}
    with_values = rows.withColumns(filled)
    used = [F.col(c).isNull() & F.col(f"{c}_filled").isNotNull() for c in fixed.WORST_COLUMNS]
    any_used = used[0]
    for one in used[1:]:
        any_used = any_used | one
    return with_values.withColumn("is_imputed", any_used.cast("int"))


def phrase_flags(text: str, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    return {name: F.coalesce(F.col(text).contains(part).cast("int"), F.lit(0)) for name, part in phrases.items()}


def ping_drops(n: int = 6) -> Column:
    return F.sum("ping_status_binary").over(temporal.last_rows(n))


def temperature_drift(rows: DataFrame) -> DataFrame:
    """Temperature rank minus its most frequent rank of the last week, the lower rank on ties."""
    temp, week = "hardware_temperature_worst_status", temporal.last_rows(WEEK)
    counts = [F.count(F.when(F.col(temp) == r, 1)).over(week).alias(f"_r{r}") for r in range(4)]
    counted = rows.select("*", *counts)
    most = F.greatest(*[f"_r{r}" for r in range(4)])
    mode = F.coalesce(*[F.when((F.col(f"_r{r}") == most) & (most > 0), r) for r in range(4)])
    return counted.withColumn("temp_delta_from_baseline", F.col(temp) - mode).drop(*[f"_r{r}" for r in range(4)])


def hours_since_warning() -> Column:
    """Hours since a component last reported a warning or worse, 0 on such a row."""
    now = slots.slot_time(F.col("monitoring_slot"))
    past = temporal.series().rowsBetween(Window.unboundedPreceding, 0)
    return slots.hours_between(now, F.last(F.when(warning_score() > 0, now), ignorenulls=True).over(past))


def flip_rate(rows: DataFrame, n: int, name: str) -> DataFrame:
    """State changes of ping within the last n rows."""
    flips = rows.withColumn("_flip", changed("ping_status_binary"))
    return flips.withColumn(name, F.sum("_flip").over(temporal.last_rows(n))).drop("_flip")


def week_failure_label(word: str = "failed") -> Column:
    """Critical state or a telling text within the next seven days."""
    said = F.coalesce(F.col("dell_issues_detected").contains(word), F.lit(False))
    bad = ((F.col("critical_component_count") > 0) | said).cast("int")
    return temporal.ahead_max(bad, WEEK)


def outage_label() -> Column:
    """At least two unreachable rows among the next six."""
    return (F.sum("ping_status_binary").over(temporal.next_rows(6)) >= 2).cast("int")


def further_labels() -> dict[str, Column]:
    ping, critical = F.col("ping_status_binary"), F.col("critical_component_count")
    return {
        "target_hardware_failure_6slot": (temporal.ahead_max(critical, 6) >= 1).cast("int"),
        "target_ping_failure_3slot": temporal.ahead_max(ping, 3),
        "target_ping_failure_6slot": temporal.ahead_max(ping, 6),
    }


def failure_regimes(rows: DataFrame) -> DataFrame:
    """Sustained outage, chronic instability and multi-component crash, with the strongest as regime."""
    ping = F.col("ping_status_binary")
    marked = rows.withColumns({
        "_down6": F.sum(ping).over(temporal.last_rows(6)), "_before": F.lag(ping, 1).over(temporal.series()),
        "_problems6": F.sum("has_active_problem").over(temporal.last_rows(6)),
    })
    down = F.coalesce(ping == 1, F.lit(False))
    flags = {
        "sustained_outage": down & ((F.col("_down6") >= 2) | F.coalesce(F.col("_before") == 1, F.lit(False))),
        "chronic_failure": F.col("_problems6") == 6,
        "multi_component_crash": F.col("critical_component_count") >= 2,
    }
    regime = (
        F.when(flags["multi_component_crash"], "multi-component crash").when(F.col("critical_component_count") >= 1, "hardware failure")
        .when(flags["chronic_failure"], "chronic failure").when(flags["sustained_outage"], "sustained outage")
        .when(down, "network blip").otherwise("none")
    )
    return marked.withColumns({**{k: v.cast("int") for k, v in flags.items()}, "failure_regime": regime}).drop("_down6", "_before", "_problems6")


def component_history() -> dict[str, Column]:
    cpu, temp = "hardware_cpu_worst_status", "hardware_temperature_worst_status"
    series = temporal.series()
    return {
        "cpu_lag1": F.lag(cpu, 1).over(series), "cpu_trend_3slot": F.round(F.avg(cpu).over(temporal.last_rows(3)), 6),
        "temperature_lag1": F.lag(temp, 1).over(series), "temperature_peak_3slot": F.max(temp).over(temporal.last_rows(3)),
        "critical_lag1": F.lag("critical_component_count", 1).over(series),
    }


def shape_features() -> dict[str, Column]:
    """Temperature slope, ping variance, distinct issues and the slot hour on a circle."""
    temp, hour = F.col("hardware_temperature_worst_status"), F.substring("monitoring_slot", -2, 2).cast("int")
    issues = F.size(F.array_distinct(F.split("dell_issues_detected", ";")))
    angle = hour * F.lit(2 * pi / 24)
    return {
        "temp_trend_slope": temp - F.lag(temp, 1).over(temporal.series()),
        "ping_instability_index": F.round(F.var_samp("ping_status_binary").over(temporal.last_rows(6)), 6),
        "cumulative_issues_count": F.when(health.present_text(F.col("dell_issues_detected"))
                                          & (F.col("dell_issues_detected") != "No issues detected"), issues).otherwise(0),
        "time_of_day_sin": F.round(F.sin(angle), 6), "time_of_day_cos": F.round(F.cos(angle), 6),
    }


def persistent(flag: Column) -> Column:
    """The flag holds now and held on the row before."""
    return flag & F.coalesce(F.lag(flag, 1).over(temporal.series()), F.lit(False))


def recent_trend(rows: DataFrame, value: str, n: int = WEEK) -> DataFrame:
    """Least-squares slope and Mann-Kendall statistic of the last n rows of every machine."""
    last = temporal.recent_rows(rows, n).select("machine_name", (-F.col("age")).alias("t"), F.col(value).cast("double").alias("x"))
    points = F.array_sort(F.collect_list(F.struct("t", "x"))).alias("points")
    lines = last.groupBy("machine_name").agg(
        F.count("*").alias("rows"), F.round(F.regr_slope(F.col("x"), F.col("t").cast("double")), 6).alias("slope"), points)
    signs = F.expr("""aggregate(transform(points, (a, i) -> aggregate(slice(points, i + 2, size(points)), 0,
                      (s, b) -> s + CAST(signum(b.x - a.x) AS INT))), 0, (s, v) -> s + v)""")
    return lines.withColumn("kendall_s", signs).drop("points")


def root_causes(rows: DataFrame) -> DataFrame:
    """Unreachable rows attributed to what the hardware reports in the same slot."""
    sensors = F.col("has_hpe") | F.col("has_dell")
    cause = (
        F.when(F.col("critical_component_count") > 0, "host hardware critical").when(warning_score() > 0, "host hardware warning")
        .when(sensors, "network").otherwise("no hardware telemetry")
    )
    return rows.filter(F.col("ping_status_binary") == 1).withColumn("root_cause", cause)


def health_score(reach: float = 0.4, hardware: float = 0.4, problem: float = 0.2) -> Column:
    """0-100 mix of reachability, worst component state and active problems; the weights are the caller's."""
    worst = F.coalesce(F.greatest(*fixed.WORST_COLUMNS), F.lit(0)) / 3.0
    up, quiet = 1 - F.coalesce("ping_status_binary", F.lit(0)), 1 - F.col("has_active_problem")
    return F.round(100 * (reach * up + hardware * (1 - worst) + problem * quiet), 6)


def filled_states(columns: list[str]) -> dict[str, Column]:
    """Missing states as 'Unknown' with one flag that something was missing."""
    missing = F.expr(" OR ".join(f"{c} IS NULL" for c in columns)).cast("int")
    return {**{f"{c}_filled": F.coalesce(c, F.lit("Unknown")) for c in columns}, "data_missing_flag": missing}


def isolated_outages(rows: DataFrame, octets: int = 256) -> DataFrame:
    """Unreachable machines whose subnet, of `octets` addresses, is otherwise reachable in the slot."""
    subnet = F.substring_index("ip_address", ".", 3)
    if octets < 256:
        last = F.substring_index("ip_address", ".", -1).cast("int")
        subnet = F.concat_ws(".", subnet, (last - last % octets).cast("string"))
    placed = rows.select("observation_id", "machine_name", "monitoring_slot", "ping_status_binary", subnet.alias("subnet"))
    cells = placed.groupBy("subnet", "monitoring_slot").agg(
        F.count("*").alias("machines"), F.sum("ping_status_binary").alias("down"))
    down = placed.filter(F.col("ping_status_binary") == 1)
    return down.join(cells.filter((F.col("down") == 1) & (F.col("machines") > 1)), ["subnet", "monitoring_slot"]).select(
        "observation_id", "machine_name", "subnet", "machines")


def consensus_warning() -> Column:
    """A hardware warning that comes with rising temperature or a change of reachability."""
    series, temp = temporal.series(), F.col("hardware_temperature_worst_status")
    rising = F.coalesce(temp > F.lag(temp, 1).over(series), F.lit(False))
    moved = F.coalesce(F.col("ping_status_binary") != F.lag("ping_status_binary", 1).over(series), F.lit(False))
    return ((warning_score() > 0) & (rising | moved)).cast("int")


def margin_label(n: int = 6) -> Column:
    """Failure within t+2 .. t+n: the row right before the failure is left out."""
    return temporal.ahead_max(temporal.failing_now(), n, start=2)
