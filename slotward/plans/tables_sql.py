"""Shared tables of the SQL statements: sources, gold, row features, master."""

from ..functions import fixed

C = fixed.COMPONENTS


def rank_case(col: str, table: dict = fixed.SEVERITY_RANKS) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


def count_at(rank: int) -> str:
    return " + ".join(f"coalesce(CAST({c} = {rank} AS INT), 0)" for c in fixed.WORST_COLUMNS)


def any_equals(columns, value: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} = '{value}', false)" for c in columns) + ")"


def reading(i: int, shift: str) -> str:
    return f"((event_id * 7 + k * 13 + {i * 31} + {shift}) % 101)"


def state(i: int, shift: str, middle: str) -> str:
    r = reading(i, shift)
    return f"CASE WHEN {r} = 0 THEN 'Critical' WHEN {r} <= 2 THEN '{middle}' WHEN {r} <= 6 THEN 'Degraded' ELSE 'OK' END"


def problem_text() -> str:
    parts = ", ".join(f"CASE WHEN {c} <> 'OK' THEN '{c} ' || {c} END" for c in C)
    return f"coalesce(nullif(concat_ws(';', {parts}), ''), 'No issues detected')"


def slot_of(t: str) -> str:
    return f"(strftime({t}, '%Y-%m-%d') || '_Slot-' || lpad(CAST((hour({t}) // 4) * 4 + 2 AS VARCHAR), 2, '0'))"


def floor_of(t: str) -> str:
    return f"(date_trunc('day', {t}) + to_hours(CAST(hour({t}) // 4 * 4 AS INT)))"


def shifted(t: str) -> str:
    return f"(date_trunc('day', {t} - INTERVAL 2 HOUR) + to_hours(CAST(hour({t} - INTERVAL 2 HOUR) // 4 * 4 AS INT)) + INTERVAL 2 HOUR)"


def stamp(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S')"


TABLES: dict[str, str] = {}

TABLES["ping_raw"] = f"""
SELECT event_id, user_id AS id,
       printf('host-%05d', user_id) AS machine_name,
       '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_address,
       ts AS event_time, {slot_of('ts')} AS monitoring_slot,
       CASE WHEN event_type = 'error' THEN 'Unreachable' ELSE 'Reachable' END AS status,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type, value
FROM events"""

TABLES["ping"] = """
SELECT * FROM ping_raw
QUALIFY row_number() OVER (PARTITION BY id, monitoring_slot ORDER BY event_time, event_id) = 1"""

TABLES["hpe"] = f"""
SELECT *, {problem_text()} AS current_problems FROM (
  SELECT id, machine_name, ip_address, monitoring_slot,
         {floor_of('event_time')} + to_minutes(CAST(k % 47 AS INT)) AS event_time,
         {', '.join(f"{state(i + 1, '0', 'OK')} AS {c}" for i, c in enumerate(C))}
  FROM ping WHERE id % 4 = 0)"""

_D = "(CASE WHEN k % 10 = 0 THEN 17 ELSE 0 END)"
TABLES["dell"] = f"""
SELECT *, {problem_text()} AS issues_detected, {problem_text()} AS current_problems,
       CASE WHEN {any_equals(C, 'Critical')} THEN 'Critical'
            WHEN {' OR '.join(f"{c} <> 'OK'" for c in C)} THEN 'Degraded' ELSE 'OK' END AS overall_status,
       'OK' AS status FROM (
  SELECT id, machine_name, ip_address, monitoring_slot,
         {floor_of('event_time')} + to_minutes(CAST((k * 3) % 47 AS INT)) AS event_time,
         {', '.join(f"{state(i + 1, _D, 'NOT OK')} AS {c}" for i, c in enumerate(C))}
  FROM ping WHERE id % 2 = 0)"""

TABLES["gold"] = f"""
SELECT p.machine_name || '|' || p.ip_address || '|' || p.monitoring_slot AS observation_id,
       p.machine_name, p.ip_address, p.monitoring_slot,
       true AS has_ping, h.event_time IS NOT NULL AS has_hpe, d.event_time IS NOT NULL AS has_dell,
       CASE WHEN h.event_time IS NOT NULL AND d.event_time IS NOT NULL THEN 'Ping + HPE + Dell'
            WHEN d.event_time IS NOT NULL THEN 'Ping + Dell'
            WHEN h.event_time IS NOT NULL THEN 'Ping + HPE' ELSE 'Ping Only' END AS telemetry_source,
       p.event_time AS event_time_ping, p.status AS ping_status,
       h.event_time AS event_time_hpe, {', '.join(f'h.{c} AS hpe_{c}' for c in fixed.EXPORT_COMPONENTS)},
       h.current_problems AS hpe_current_problems,
       d.event_time AS event_time_dell, d.status AS dell_status, d.overall_status AS dell_overall_status,
       {', '.join(f'd.{c} AS dell_{c}' for c in fixed.EXPORT_COMPONENTS)},
       d.issues_detected AS dell_issues_detected
FROM ping p
LEFT JOIN hpe h USING (machine_name, ip_address, monitoring_slot)
LEFT JOIN dell d USING (machine_name, ip_address, monitoring_slot)"""

TABLES["ranked"] = f"""
SELECT *, {rank_case('ping_status', fixed.PING_CODES)} AS ping_status_binary,
       {', '.join(f"{rank_case(f'{v}_{c}')} AS {v}_{c}_rank" for c in C for v in ('hpe', 'dell'))}
FROM gold"""

TABLES["worst"] = f"""
SELECT *, {', '.join(f"greatest(hpe_{c}_rank, dell_{c}_rank) AS hardware_{c}_worst_status" for c in C)},
       {', '.join(f"CAST(has_hpe AND has_dell AND hpe_{c} IS DISTINCT FROM dell_{c} AS INT) AS hardware_{c}_disagreement_flag" for c in C)}
FROM ranked"""

TABLES["counted"] = f"""
SELECT *, {count_at(3)} AS critical_component_count, {count_at(2)} AS not_ok_component_count,
       {count_at(1)} AS degraded_component_count FROM worst"""

TABLES["stage"] = """
SELECT *, CAST(critical_component_count > 0 OR not_ok_component_count > 0 OR degraded_component_count > 0
               OR coalesce(ping_status_binary = 1, false) AS INT) AS has_active_problem,
       CAST(ping_status_binary = 1 OR critical_component_count > 0 AS INT) AS helper_current_failure_state
FROM counted"""

SERIES = "PARTITION BY machine_name ORDER BY monitoring_slot, ip_address, event_time_ping, observation_id"


def over(frame: str = "") -> str:
    return f"OVER ({SERIES} {frame})"


def back(n: int) -> str:
    return over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def ahead(n: int, start: int = 1) -> str:
    return over(f"ROWS BETWEEN {start} FOLLOWING AND {n} FOLLOWING")


TABLES["master"] = f"""
SELECT *,
       lag(ping_status_binary, 1) {over()} AS ping_status_binary_lag1,
       lag(ping_status_binary, 2) {over()} AS ping_status_binary_lag2,
       avg(ping_status_binary) {back(3)} AS ping_timeout_rate_3slot,
       avg(ping_status_binary) {back(6)} AS ping_timeout_rate_6slot,
       CAST(sum(has_active_problem) {back(6)} AS INT) AS problems_active_sum_6slot,
       max(helper_current_failure_state) {ahead(3)} AS target_failure_3slot,
       max(helper_current_failure_state) {ahead(6)} AS target_failure_6slot,
       max(ping_status_binary) {ahead(3)} AS target_network_alert_3slot,
       CAST(max(critical_component_count) {ahead(3)} >= 1 AS INT) AS target_hardware_failure_3slot
FROM stage"""

TABLES["latest"] = """
SELECT * FROM master
QUALIFY row_number() OVER (PARTITION BY machine_name
  ORDER BY event_time_ping DESC, monitoring_slot DESC, ip_address DESC, observation_id DESC) = 1"""

TABLES["fleet"] = """
SELECT *, round(ping_timeout_rate_6slot + 0.01 * critical_component_count, 6) AS score,
       round(ping_timeout_rate_6slot, 6) AS p12, round(ping_timeout_rate_3slot, 6) AS p24
FROM latest"""

ORDER = list(TABLES)


def with_tables(last: str, body: str) -> str:
    """Prefix a statement with the shared tables up to `last`."""
    body = body.strip()
    if not last:
        return body
    wanted = ORDER[: ORDER.index(last) + 1]
    ctes = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in wanted)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
