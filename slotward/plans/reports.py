"""Snapshots, histories, alerts, ranks and policy, on scores that SQL can reproduce."""

from pyspark.sql import functions as F

from ..functions import fixed, health, slots
from ..operators import audit_log as log_table, reports, temporal, vendors
from ..session import fresh_path
from ..sources import binding
from . import tables
from .features import CRITICAL_NAMES, HOLDING, OTHERS, critical_names, holding_names, label_sql, other_states
from .profiling import AS_OF
from .registry import query
from .tables_sql import any_equals, stamp
from .vendors import TEXT_GOLD

C = fixed.COMPONENTS
PING_SQL = "CASE WHEN coalesce(ping_status_binary, 0) = 1 THEN 'Unreachable' ELSE 'Reachable' END"


def _present(c):
    return f"CASE WHEN {c} IS NOT NULL AND trim({c}) NOT IN ('', 'None', 'nan') THEN {c} END"


@query("rpt01_latest_snapshot", f"""
SELECT machine_name, {stamp('event_time_ping')} AS event_time, monitoring_slot, ip_address, telemetry_source,
       {PING_SQL} AS ping_status, {', '.join(f'{label_sql(w)} AS {c}_status' for c, w in zip(C, fixed.WORST_COLUMNS))},
       {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in fixed.COUNT_COLUMNS)},
       {', '.join(f'{_present(c)} AS {c}' for c in reports.DIAGNOSTICS)} FROM latest""", "latest")
def _(spark, sf):
    return reports.latest_snapshot(tables.stage(spark, sf))


@query("win09_latest_row", f"""
SELECT machine_name, {stamp('event_time_ping')} AS event_time, monitoring_slot,
       round(ping_timeout_rate_6slot, 6) AS ping_timeout_rate_6slot FROM latest""", "latest")
def _(spark, sf):
    newest = tables.latest(spark, sf, ["event_time_ping", "monitoring_slot", "ping_timeout_rate_6slot"])
    return newest.select("machine_name", slots.time_text(F.col("event_time_ping")).alias("event_time"), "monitoring_slot",
                         F.round("ping_timeout_rate_6slot", 6).alias("ping_timeout_rate_6slot"))


BACK = "PARTITION BY machine_name ORDER BY event_time_ping DESC, monitoring_slot DESC, ip_address DESC, observation_id DESC"


@query("win10_recent_rows", f"""
SELECT machine_name, monitoring_slot, row_number() OVER ({BACK}) AS age FROM gold QUALIFY row_number() OVER ({BACK}) <= 6""", "gold")
def _(spark, sf):
    return temporal.recent_rows(tables.gold(spark, sf), 6).select("machine_name", "monitoring_slot", "age")


def _trend_sql(first, last, n):
    return f"CASE WHEN {n} < 2 THEN 'INSUFFICIENT_DATA' WHEN {last} > {first} THEN 'INCREASING' WHEN {last} < {first} THEN 'DECREASING' ELSE 'STABLE' END"


RECENT = f"""recent AS (SELECT *, row_number() OVER ({BACK}) AS age, round(ping_timeout_rate_6slot, 3) AS r6 FROM master
 QUALIFY row_number() OVER ({BACK}) <= 6)"""


@query("rpt02_server_history", f"""
WITH {RECENT}
SELECT machine_name, count(*) AS slots_returned,
  string_agg({stamp('event_time_ping')} || '|' || monitoring_slot || '|' || {PING_SQL} || '|'
    || printf('%.3f', round(ping_timeout_rate_3slot, 3)) || '|' || printf('%.3f', r6) || '|' || problems_active_sum_6slot
    || '|' || critical_component_count || '|' || degraded_component_count, ';' ORDER BY age DESC) AS timeline,
  {_trend_sql('arg_max(r6, age)', 'arg_min(r6, age)', 'count(*)')} AS ping_timeout_trend,
  {_trend_sql('arg_max(problems_active_sum_6slot, age)', 'arg_min(problems_active_sum_6slot, age)', 'count(*)')} AS problem_accumulation_trend
FROM recent GROUP BY machine_name""", "master")
def _(spark, sf):
    return reports.history(tables.master(spark, sf)).withColumn("timeline", reports.timeline_text())


@query("win13_trend", f"""
WITH {RECENT}
SELECT machine_name, count(*) AS rows, {_trend_sql('arg_max(r6, age)', 'arg_min(r6, age)', 'count(*)')} AS trend
FROM recent GROUP BY machine_name""", "master")
def _(spark, sf):
    return reports.latest_trends(tables.master(spark, sf), 6)


# --- fleet scores ----------------------------------------------------------------------------

SCORED = """scored AS (
  SELECT *, round(cut, 6) AS threshold, score > cut AS is_anomaly, round(100.0 * c, 6) AS percentile,
         round(score - cut, 6) AS score_delta FROM (
    SELECT *, cume_dist() OVER (ORDER BY score) AS c,
           row_number() OVER (ORDER BY round(score, 4) DESC, machine_name) AS fleet_rank, count(*) OVER () AS total_servers
    FROM fleet), (SELECT quantile_cont(score, 0.98) AS cut FROM fleet))"""


def scored(spark, sf):
    keep = tables.fleet(spark, sf).select("machine_name", "score", "p12", "p24")
    return reports.fleet_scores(keep)


@query("rpt03_win11_win12_fleet_scores", f"""
WITH {SCORED}
SELECT machine_name, score, threshold, is_anomaly, percentile, fleet_rank, score_delta, total_servers FROM scored""", "fleet")
def _(spark, sf):
    return scored(spark, sf).select("machine_name", "score", "threshold", "is_anomaly", "percentile", "fleet_rank",
                                    "score_delta", "total_servers")


@query("rpt04_score_distribution", f"""
WITH {SCORED}
SELECT count(*) AS total_servers, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score,
       round(median(score), 6) AS median_score, round(stddev_pop(score), 6) AS std_score,
       count(*) FILTER (WHERE is_anomaly) AS total_anomalies, max(threshold) AS threshold,
       round(100.0 * CAST(count(*) FILTER (WHERE is_anomaly) AS DOUBLE) / count(*), 6) AS anomaly_rate_pct FROM scored""", "fleet")
def _(spark, sf):
    return reports.score_distribution(scored(spark, sf))


@query("rpt04_sorted_scores", """
SELECT score, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY score) AS BIGINT) AS upto FROM fleet GROUP BY score ORDER BY score""", "fleet")
def _(spark, sf):
    counted = tables.fleet(spark, sf).groupBy("score").agg(F.count("*").alias("n"))
    return reports.ranking.running_totals(counted, [F.col("score")], {"upto": "n"})


REASON = """CASE WHEN is_anomaly THEN printf('Anomaly score (%.2f) exceeded fleet threshold (%.2f). Server is in the %.1fth percentile, ranked #%d of %d most anomalous.',
  score, threshold, percentile, fleet_rank, total_servers)
 ELSE printf('Anomaly score (%.2f) is %s the fleet threshold (%.2f). Server operates within normal fleet behavior.', score,
  CASE WHEN score_delta < -0.3 THEN 'well below' WHEN score_delta < -0.1 THEN 'below' ELSE 'near but below' END, threshold) END"""


@query("rpt05_anomaly_classification", f"""
WITH {SCORED} SELECT machine_name, CASE WHEN is_anomaly THEN 'ANOMALOUS' ELSE 'NORMAL' END AS tier, {REASON} AS reason FROM scored""", "fleet")
def _(spark, sf):
    return reports.classify_anomalies(scored(spark, sf)).select("machine_name", "tier", "reason")


@query("sort02_top_anomalies", f"""
WITH {SCORED} SELECT machine_name, score, fleet_rank, percentile, score_delta FROM scored WHERE is_anomaly ORDER BY fleet_rank LIMIT 10""", "fleet")
def _(spark, sf):
    return reports.top_anomalies(scored(spark, sf))


def tier_sql(p, horizon, field=0):
    tiers = fixed.RISK_POLICY[horizon]["tiers"]
    cases = " ".join(f"WHEN {p} >= {lo} AND {p} < {hi} THEN '{t[field]}'" for t in tiers for lo, hi in [t[1:3]])
    return f"CASE WHEN {p} >= 1.0 THEN '{tiers[-1][field]}' {cases} ELSE '{tiers[0][field]}' END"


def _risk_sql(p, horizon):
    policy = fixed.RISK_POLICY[horizon]
    return f"""SELECT machine_name, '{horizon}' AS horizon, {tier_sql(p, horizon)} AS risk_tier, {tier_sql(p, horizon, 3)} AS action,
 round({p} * 100, 1) AS probability_pct, {p} >= {policy['optimal_f1']} AS exceeds_optimal_f1,
 {policy['optimal_f1']}::DOUBLE AS optimal_f1_threshold, '{policy['lookahead_window']}' AS lookahead_window FROM fleet"""


def rated(fleet, p, horizon):
    cols = reports.risk_columns(p, horizon)
    return fleet.select("machine_name", F.lit(horizon).alias("horizon"), *[c.alias(n) for n, c in cols.items()])


@query("rpt08_risk_tiers", _risk_sql("p12", "3slot") + " UNION ALL " + _risk_sql("p24", "6slot"), "fleet")
def _(spark, sf):
    """Both horizons in one pass over the fleet."""
    horizons = [F.struct(F.lit(h).alias("horizon"), *[c.alias(n) for n, c in reports.risk_columns(p, h).items()])
                for p, h in (("p12", "3slot"), ("p24", "6slot"))]
    return tables.fleet(spark, sf).select("machine_name", F.inline(F.array(*horizons)))


@query("sort03_top_at_risk", f"""
SELECT machine_name, round(p12 * 100, 1) AS probability_pct, {tier_sql('p12', '3slot')} AS risk_tier FROM fleet
WHERE {tier_sql('p12', '3slot')} IN ('WARNING', 'CRITICAL') ORDER BY 2 DESC, 1 LIMIT 5""", "fleet")
def _(spark, sf):
    return reports.top_at_risk(rated(tables.fleet(spark, sf), "p12", "3slot"))


COMPOSITE = f"""
WITH {SCORED}, t AS (SELECT *, {tier_sql('p12', '3slot')} AS tier_12h, {tier_sql('p24', '6slot')} AS tier_24h FROM scored)
SELECT machine_name, tier_12h, tier_24h,
  CASE WHEN tier_12h = 'CRITICAL' OR tier_24h = 'CRITICAL' THEN 'CRITICAL'
       WHEN is_anomaly OR tier_12h = 'WARNING' OR tier_24h = 'WARNING' THEN 'WARNING' ELSE 'NORMAL' END AS composite_risk,
  coalesce(concat_ws('; ', CASE WHEN is_anomaly THEN printf('Isolation Forest: ANOMALOUS (score=%.4f)', score) END,
    CASE WHEN tier_12h <> 'NORMAL' THEN 'XGBoost 12h: ' || tier_12h || ' (' || printf('%.1f', round(p12 * 100, 1)) || '%)' END,
    CASE WHEN tier_24h <> 'NORMAL' THEN 'XGBoost 24h: ' || tier_24h || ' (' || printf('%.1f', round(p24 * 100, 1)) || '%)' END), '') AS signals,
  CASE WHEN is_anomaly AND tier_12h = 'CRITICAL' THEN 'Server is both anomalous AND predicted to fail within 12 hours. Immediate intervention required.'
       WHEN tier_12h = 'CRITICAL' OR tier_24h = 'CRITICAL' THEN 'High failure probability detected. Dispatch SRE remediation ticket.'
       WHEN is_anomaly OR tier_12h = 'WARNING' OR tier_24h = 'WARNING' THEN 'Elevated risk signals detected. Schedule preventative inspection within 24 hours.'
       ELSE 'All engines report normal operating conditions.' END AS summary FROM t"""


@query("rpt10_composite_risk", COMPOSITE, "fleet")
def _(spark, sf):
    rows = scored(spark, sf).withColumns({
        "tier_12h": reports.risk_columns("p12", "3slot")["risk_tier"], "tier_24h": reports.risk_columns("p24", "6slot")["risk_tier"],
    })
    return reports.composite_risk(rows).select(
        "machine_name", "tier_12h", "tier_24h", "composite_risk", F.array_join("contributing_signals", "; ").alias("signals"), "summary")


@query("rpt11_fleet_summary", f"""
WITH {SCORED}, t AS (SELECT *, {tier_sql('p12', '3slot')} AS tier, round(p12 * 100, 1) AS pct FROM scored)
SELECT count(*) AS total_servers, count(*) FILTER (WHERE tier = 'NORMAL') AS normal, count(*) FILTER (WHERE tier = 'WARNING') AS warning,
  count(*) FILTER (WHERE tier = 'CRITICAL') AS critical, count(*) FILTER (WHERE is_anomaly) AS anomalies_detected,
  max(threshold) AS anomaly_threshold, round(100.0 * CAST(count(*) FILTER (WHERE is_anomaly) AS DOUBLE) / count(*), 6) AS anomaly_rate_pct,
  min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score,
  (SELECT coalesce(string_agg(machine_name, ', ' ORDER BY fleet_rank), '') FROM (SELECT * FROM t WHERE is_anomaly ORDER BY fleet_rank LIMIT 10)) AS top_anomalies,
  (SELECT coalesce(string_agg(machine_name, ', ' ORDER BY pct DESC, machine_name), '') FROM
     (SELECT * FROM t WHERE tier <> 'NORMAL' ORDER BY pct DESC, machine_name LIMIT 5)) AS top_at_risk FROM t""", "fleet")
def _(spark, sf):
    return reports.fleet_summary(scored(spark, sf))


@query("rpt12_sort04_recent_alerts", f"""
WITH {RECENT}, a AS (SELECT *, concat_ws('; ',
    CASE WHEN critical_component_count > 0 THEN 'Critical hardware: ' || critical_component_count || ' component(s)' END,
    CASE WHEN ping_timeout_rate_6slot > 0.5 THEN 'High ping timeout: ' || printf('%.0f', ping_timeout_rate_6slot * 100) || '%' END,
    CASE WHEN problems_active_sum_6slot >= 3 THEN 'Sustained problems: ' || problems_active_sum_6slot || ' active over 24h' END,
    CASE WHEN ping_status_binary = 1 THEN 'Server unreachable' END) AS alert_reasons FROM recent
  WHERE critical_component_count > 0 OR ping_timeout_rate_6slot > 0.5 OR problems_active_sum_6slot >= 3 OR ping_status_binary = 1)
SELECT machine_name, {stamp('event_time_ping')} AS event_time, monitoring_slot AS slot, alert_reasons, {PING_SQL} AS ping_status,
       r6 AS ping_timeout_rate_6slot, CAST(critical_component_count AS BIGINT) AS critical_components,
       CAST(problems_active_sum_6slot AS BIGINT) AS problems_active_sum_6slot, (SELECT count(*) FROM a) AS total_alerts
FROM a ORDER BY r6 DESC, machine_name, slot LIMIT 20""", "master")
def _(spark, sf):
    return reports.recent_alerts(tables.master(spark, sf))


@query("rpt15_value_inspection", f"""
SELECT machine_name, monitoring_slot, {HOLDING} AS holding, {OTHERS} AS others, dell_overall_status,
       {_present('dell_issues_detected')} AS dell_issues_detected, {_present('hpe_current_problems')} AS hpe_current_problems
FROM gold WHERE {any_equals(TEXT_GOLD, 'NOT OK')}""", "gold")
def _(spark, sf):
    texts = [F.when(health.present_text(F.col(c)), F.col(c)).alias(c) for c in reports.DIAGNOSTICS]
    return vendors.holding(tables.gold(spark, sf), "NOT OK").select(
        "machine_name", "monitoring_slot", holding_names().alias("holding"), other_states().alias("others"), "dell_overall_status", *texts)


@query("rpt15_critical_inspection", f"""
SELECT machine_name, monitoring_slot, CAST(critical_component_count AS BIGINT) AS critical_component_count, {CRITICAL_NAMES} AS components,
       dell_overall_status, {_present('dell_issues_detected')} AS dell_issues_detected, {_present('hpe_current_problems')} AS hpe_current_problems
FROM counted WHERE critical_component_count > 0""", "counted")
def _(spark, sf):
    texts = [F.when(health.present_text(F.col(c)), F.col(c)).alias(c) for c in reports.DIAGNOSTICS]
    rows = tables.stage(spark, sf).filter(F.col("critical_component_count") > 0)
    return rows.select("machine_name", "monitoring_slot", "critical_component_count", critical_names().alias("components"),
                       "dell_overall_status", *texts)


def tool_calls(spark, sf):
    """The event table as full records of an audit log."""
    high = F.col("value") > 100
    return binding.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("step"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("look for "), "event_type").alias("thought"), F.col("event_type").alias("tool_name"),
        F.from_json("props", "map<string,string>").alias("tool_args"),
        F.parse_json(F.to_json(F.struct("value", F.struct(high.alias("high"), F.parse_json("props").alias("props")).alias("reading")))).alias("evidence"),
        F.when(high, F.concat(F.lit("high "), "event_type")).alias("conclusion"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("tool_status"),
        F.round(slots.hours_between(F.lit(AS_OF).cast("timestamp_ntz"), F.col("ts")), 1).alias("data_staleness_hours"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("source"), F.lit("events"))).alias("audit_metadata"))


def stored_log(spark, sf):
    """A log written by two appends, the first of them repeated."""
    path, calls = fresh_path(spark, "audit-log"), tool_calls(spark, sf)
    first, rest = calls.filter("step % 2 = 0"), calls.filter("step % 2 = 1")
    for part in (first, rest, first):
        log_table.append(part, path)
    return log_table.read(spark, path)


@query("rpt16_audit_log_by_tool", f"""
SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS step, {stamp('ts')} AS at, 'look for ' || event_type AS thought,
       json_extract_string(props, '$.k') AS arg_k, value AS evidence_value, CASE WHEN value > 100 THEN 'high ' || event_type END AS conclusion,
       round(value, 2) AS latency_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS tool_status,
       round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 3600, 1) AS data_staleness_hours,
       CASE WHEN event_type = 'error' THEN 'events' END AS audit_source
FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    found = log_table.of_tool(stored_log(spark, sf), "error")
    return found.select(
        "session_id", "step", slots.time_text("timestamp").alias("at"), "thought", F.col("tool_args")["k"].alias("arg_k"),
        log_table.evidence_field("$.value", "double").alias("evidence_value"), "conclusion", "latency_ms", "tool_status",
        "data_staleness_hours", F.col("audit_metadata")["source"].alias("audit_source"))


@query("rpt16_audit_log_by_session", f"""
SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS steps, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools,
       {stamp('min(ts)')} AS first_time, {stamp('max(ts)')} AS last_time, count(*) FILTER (WHERE value > 100) AS conclusions,
       arg_max('high ' || event_type, (ts, event_id)) FILTER (WHERE value > 100) AS last_conclusion
FROM events GROUP BY user_id""")
def _(spark, sf):
    found = log_table.sessions(stored_log(spark, sf))
    return found.withColumns({c: slots.time_text(c) for c in ("first_time", "last_time")})


@query("rpt16_audit_log_by_evidence", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS calls, count(*) FILTER (WHERE value > 100) AS high
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY 1""")
def _(spark, sf):
    log = stored_log(spark, sf)
    k, high = log_table.evidence_field("$.reading.props.k", "bigint"), log_table.evidence_field("$.reading.high", "boolean")
    return log.filter(k >= 50).groupBy(k.alias("k")).agg(F.count("*").alias("calls"), F.count(F.when(high, 1)).alias("high"))


# --- cases and look-ups ----------------------------------------------------------------------

CASES = {
    "physical fault": "critical_component_count > 0",
    "chronic outage": "ping_timeout_rate_6slot = 1.0 AND critical_component_count = 0",
    "early warning": "problems_active_sum_6slot >= 3 AND helper_current_failure_state = 0",
}


@query("sort06_first_case_per_category", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{n}' AS case_type, observation_id, machine_name, monitoring_slot,
    CAST(problems_active_sum_6slot AS BIGINT) AS problems FROM master WHERE {p} ORDER BY observation_id LIMIT 1)""" for n, p in CASES.items()), "master")
def _(spark, sf):
    rows = tables.master(spark, sf)
    columns = ["machine_name", "monitoring_slot", "problems_active_sum_6slot"]
    cases = reports.first_case_per_category(rows, {n: F.expr(p) for n, p in CASES.items()}, columns)
    return cases.withColumnRenamed("problems_active_sum_6slot", "problems")


@query("join06_find_by_ip", """
WITH dim AS (SELECT ip_address, arg_max(machine_name, event_time) AS machine_name FROM ping GROUP BY 1),
asked AS (SELECT c_custkey, '10.0.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS ip_address FROM customer)
SELECT c_custkey, ip_address, machine_name, machine_name IS NOT NULL AS found FROM asked LEFT JOIN dim USING (ip_address)""", "ping")
def _(spark, sf):
    asked = binding.table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat('10.0.', c_custkey div 256, '.', c_custkey % 256) AS ip_address")
    return reports.find_by_ip(asked, tables.gold(spark, sf)).select("c_custkey", "ip_address", "machine_name", "found")
