"""Design: documented features and labels, checked like the built ones."""

from math import pi

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import design
from . import tables
from .registry import query
from .tables_sql import ahead, back, over

SCORE = "(" + " + ".join(f"coalesce({c}, 0)" for c in fixed.WORST_COLUMNS) + ")"
TEST_PHRASES = {"has_power_redundancy_loss": "power Critical", "has_thermal_throttling": "temperature",
                "has_disk_array_warning": "storage"}
TEMP, CPU, PING = "hardware_temperature_worst_status", "hardware_cpu_worst_status", "ping_status_binary"


def big(expr, name):
    return f"CAST({expr} AS BIGINT) AS {name}"


def stage(spark, sf):
    return tables.stage(spark, sf)


def keep(df, *names):
    return df.select("observation_id", *names)


@query("doc01_forward_fill", f"""
SELECT observation_id, {', '.join(big(f'last_value({c} IGNORE NULLS) ' + over('ROWS BETWEEN 3 PRECEDING AND CURRENT ROW'), f'{c}_filled') for c in fixed.WORST_COLUMNS)},
 CAST({' OR '.join(f"({c} IS NULL AND last_value({c} IGNORE NULLS) {over('ROWS BETWEEN 3 PRECEDING AND CURRENT ROW')} IS NOT NULL)" for c in fixed.WORST_COLUMNS)} AS BIGINT) AS is_imputed
FROM stage""", "stage")
def _(spark, sf):
    return keep(design.forward_filled(stage(spark, sf)), *[f"{c}_filled" for c in fixed.WORST_COLUMNS], "is_imputed")


@query("doc02_phrase_flags", f"""
SELECT observation_id, {', '.join(big(f"coalesce(contains(dell_issues_detected, '{p}'), false)", n) for n, p in TEST_PHRASES.items())} FROM gold""", "gold")
def _(spark, sf):
    return keep(tables.gold(spark, sf).withColumns(design.phrase_flags("dell_issues_detected", TEST_PHRASES)), *TEST_PHRASES)


@query("doc03_ping_drops", f"SELECT observation_id, {big(f'sum({PING}) {back(6)}', 'rolling_24h_ping_drops')} FROM stage", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.ping_drops().alias("rolling_24h_ping_drops"))


COUNTS = ", ".join(f"count(*) FILTER (WHERE {TEMP} = {r}) {back(42)} AS r{r}" for r in range(4))
MODE = "CASE WHEN greatest(r0, r1, r2, r3) = 0 THEN NULL " + " ".join(
    f"WHEN r{r} = greatest(r0, r1, r2, r3) THEN {r}" for r in range(4)) + " END"


@query("doc04_temperature_drift", f"""
SELECT observation_id, {big(f'{TEMP} - {MODE}', 'temp_delta_from_baseline')} FROM (SELECT *, {COUNTS} FROM stage)""", "stage")
def _(spark, sf):
    return keep(design.temperature_drift(stage(spark, sf)), "temp_delta_from_baseline")


@query("doc05_hours_since_warning", f"""
WITH s AS (SELECT *, epoch(strptime(substr(monitoring_slot, 1, 10) || ' ' || substr(monitoring_slot, -2), '%Y-%m-%d %H')) AS e FROM stage)
SELECT observation_id, (e - last_value(CASE WHEN {SCORE} > 0 THEN e END IGNORE NULLS) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}) / 3600.0 AS hours_since_last_warning FROM s""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.hours_since_warning().alias("hours_since_last_warning"))


FLIP = f"SELECT *, coalesce(CAST({PING} <> lag({PING}) {over()} AS INT), 0) AS flip FROM stage"


@query("doc06_flip_rate", f"SELECT observation_id, {big(f'sum(flip) {back(12)}', 'ping_state_flip_rate')} FROM ({FLIP})", "stage")
def _(spark, sf):
    return keep(design.flip_rate(stage(spark, sf), 12, "ping_state_flip_rate"), "ping_state_flip_rate")


@query("doc07_week_failure_label", f"""
SELECT observation_id, {big(f"max(CAST(critical_component_count > 0 OR coalesce(contains(dell_issues_detected, 'power'), false) AS INT)) {ahead(42)}", 'is_failing_in_7d')} FROM stage""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.week_failure_label("power").alias("is_failing_in_7d"))


@query("doc08_outage_label", f"SELECT observation_id, {big(f'sum({PING}) {ahead(6)} >= 2', 'target_network_outage_6slot')} FROM stage", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.outage_label().alias("target_network_outage_6slot"))


@query("doc09_further_labels", f"""
SELECT observation_id, {big(f'max(critical_component_count) {ahead(6)} >= 1', 'target_hardware_failure_6slot')},
 {big(f'max({PING}) {ahead(3)}', 'target_ping_failure_3slot')}, {big(f'max({PING}) {ahead(6)}', 'target_ping_failure_6slot')} FROM stage""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), *[c.alias(n) for n, c in design.further_labels().items()])


@query("doc10_failure_regimes", f"""
WITH s AS (SELECT *, sum({PING}) {back(6)} AS down6, lag({PING}) {over()} AS before, sum(has_active_problem) {back(6)} AS problems6 FROM stage),
f AS (SELECT *, coalesce({PING} = 1, false) AND (down6 >= 2 OR coalesce(before = 1, false)) AS so, problems6 = 6 AS cf FROM s)
SELECT observation_id, {big('so', 'sustained_outage')}, {big('cf', 'chronic_failure')}, {big('critical_component_count >= 2', 'multi_component_crash')},
 CASE WHEN critical_component_count >= 2 THEN 'multi-component crash' WHEN critical_component_count >= 1 THEN 'hardware failure'
      WHEN cf THEN 'chronic failure' WHEN so THEN 'sustained outage' WHEN coalesce({PING} = 1, false) THEN 'network blip' ELSE 'none' END AS failure_regime FROM f""", "stage")
def _(spark, sf):
    return keep(design.failure_regimes(stage(spark, sf)), "sustained_outage", "chronic_failure", "multi_component_crash", "failure_regime")


@query("doc11_component_history", f"""
SELECT observation_id, {big(f'lag({CPU}) {over()}', 'cpu_lag1')}, round(avg({CPU}) {back(3)}, 6) AS cpu_trend_3slot,
 {big(f'lag({TEMP}) {over()}', 'temperature_lag1')}, {big(f'max({TEMP}) {back(3)}', 'temperature_peak_3slot')},
 {big(f'lag(critical_component_count) {over()}', 'critical_lag1')} FROM stage""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), *[c.alias(n) for n, c in design.component_history().items()])


HOUR = "CAST(substr(monitoring_slot, -2) AS INT)"


@query("doc12_shape_features", f"""
SELECT observation_id, {big(f'{TEMP} - lag({TEMP}) {over()}', 'temp_trend_slope')}, round(var_samp({PING}) {back(6)}, 6) AS ping_instability_index,
 CASE WHEN trim(dell_issues_detected) NOT IN ('', 'None', 'nan', 'No issues detected') THEN len(list_distinct(string_split(dell_issues_detected, ';'))) ELSE 0 END AS cumulative_issues_count,
 round(sin({HOUR} * {2 * pi / 24}::DOUBLE), 6) AS time_of_day_sin, round(cos({HOUR} * {2 * pi / 24}::DOUBLE), 6) AS time_of_day_cos FROM stage""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), *[c.alias(n) for n, c in design.shape_features().items()])


@query("doc13_alert_persistence", f"""
SELECT observation_id, ping_timeout_rate_6slot >= 0.4 AND coalesce(lag(ping_timeout_rate_6slot >= 0.4) {over()}, false) AS persistent FROM master""", "master")
def _(spark, sf):
    return keep(tables.master(spark, sf), design.persistent(F.col("ping_timeout_rate_6slot") >= 0.4).alias("persistent"))


@query("doc14_recent_trend", f"""
WITH r AS (SELECT machine_name, problems_active_sum_6slot AS x, row_number() OVER (PARTITION BY machine_name ORDER BY event_time_ping DESC, monitoring_slot DESC) AS age FROM master),
l AS (SELECT * FROM r WHERE age <= 42),
k AS (SELECT a.machine_name, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s FROM l a JOIN l b ON a.machine_name = b.machine_name AND b.age < a.age GROUP BY 1)
SELECT l.machine_name, count(*) AS rows, round(regr_slope(CAST(x AS DOUBLE), CAST(-age AS DOUBLE)), 6) AS slope, coalesce(any_value(s), 0) AS kendall_s
FROM l LEFT JOIN k USING (machine_name) GROUP BY l.machine_name""", "master")
def _(spark, sf):
    return design.recent_trend(tables.master(spark, sf), "problems_active_sum_6slot")


@query("doc15_root_causes", f"""
SELECT observation_id, CASE WHEN critical_component_count > 0 THEN 'host hardware critical' WHEN {SCORE} > 0 THEN 'host hardware warning'
 WHEN has_hpe OR has_dell THEN 'network' ELSE 'no hardware telemetry' END AS root_cause FROM stage WHERE {PING} = 1""", "stage")
def _(spark, sf):
    return keep(design.root_causes(stage(spark, sf)), "root_cause")


@query("doc16_warning_score", f"SELECT observation_id, {big(SCORE, 'component_warning_count')} FROM stage", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.warning_score().alias("component_warning_count"))


WORST = f"coalesce(greatest({', '.join(fixed.WORST_COLUMNS)}), 0) / 3.0::DOUBLE"


@query("doc17_health_score", f"""
SELECT observation_id, round(100 * (0.4::DOUBLE * (1 - coalesce({PING}, 0)) + 0.4::DOUBLE * (1 - {WORST}) + 0.2::DOUBLE * (1 - has_active_problem)), 6) AS health_score FROM stage""", "stage")
def _(spark, sf):
    return keep(stage(spark, sf), design.health_score().alias("health_score"))


DELL_STATES = ["dell_fans", "dell_temperature", "dell_power"]


@query("doc18_flaps_and_fills", f"""
SELECT observation_id, {big(f'sum(flip) {back(6)}', 'ping_flap_count_24h')}, {', '.join(f"coalesce({c}, 'Unknown') AS {c}_filled" for c in DELL_STATES)},
 {big('(' + ' OR '.join(f'{c} IS NULL' for c in DELL_STATES) + ')', 'data_missing_flag')} FROM ({FLIP})""", "stage")
def _(spark, sf):
    rows = design.flip_rate(stage(spark, sf), 6, "ping_flap_count_24h")
    filled = design.filled_states(DELL_STATES)
    return keep(rows.withColumns(filled), "ping_flap_count_24h", *filled)


@query("doc19_isolated_outages", f"""
WITH s AS (SELECT *, regexp_replace(ip_address, '\\.[0-9]+$', '') AS subnet FROM stage),
c AS (SELECT subnet, monitoring_slot, count(*) AS machines, sum({PING}) AS down FROM s GROUP BY 1, 2)
SELECT observation_id, machine_name, subnet, machines FROM s JOIN c USING (subnet, monitoring_slot)
WHERE {PING} = 1 AND down = 1 AND machines > 1""", "stage")
def _(spark, sf):
    return design.isolated_outages(stage(spark, sf))


@query("doc19_isolated_outages_of_four", f"""
WITH s AS (SELECT *, regexp_replace(ip_address, '\\.[0-9]+$', '') || '.' || CAST(CAST(regexp_extract(ip_address, '[0-9]+$') AS INT) // 4 * 4 AS VARCHAR) AS subnet FROM stage),
c AS (SELECT subnet, monitoring_slot, count(*) AS machines, sum({PING}) AS down FROM s GROUP BY 1, 2)
SELECT observation_id, machine_name, subnet, machines FROM s JOIN c USING (subnet, monitoring_slot)
WHERE {PING} = 1 AND down = 1 AND machines > 1""", "stage")
def _(spark, sf):
    """The same rule on subnets small enough for single outages."""
    return design.isolated_outages(stage(spark, sf), 4)


@query("doc20_consensus_and_margin", f"""
SELECT observation_id, {big(f"{SCORE} > 0 AND (coalesce({TEMP} > lag({TEMP}) {over()}, false) OR coalesce({PING} <> lag({PING}) {over()}, false))", 'consensus_warning')},
 {big(f'max(helper_current_failure_state) {ahead(6, 2)}', 'target_failure_margin')} FROM stage""", "stage")
def _(spark, sf):
    rows = stage(spark, sf)
    return keep(rows, design.consensus_warning().alias("consensus_warning"), design.margin_label().alias("target_failure_margin"))
