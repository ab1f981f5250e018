"""Profiles of tables, columns, keys and time lines."""

from pyspark.sql import functions as F

from ..functions import fixed, slots
from ..operators import profile
from ..sources import binding
from . import tables
from .registry import query
from .tables_sql import shifted, stamp

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
AS_OF = "2024-02-01 00:00:00"


@query("agg01_table_overview", f"""
SELECT 'lineitem' AS table_name, count(*) AS rows, CAST({len(LINEITEM)} AS BIGINT) AS columns,
       '{','.join(LINEITEM)}' AS column_names FROM lineitem""")
def _(spark, sf):
    return profile.overview(binding.table(spark, sf, "lineitem"), "lineitem")


def _sample_sql(source: str, column: str, k: int) -> str:
    return f"""
SELECT '{column}' AS column_name, count(*) AS unique_count,
       string_agg(v, ', ' ORDER BY v) FILTER (WHERE r <= {k}) AS sample_values
FROM (SELECT CAST({column} AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST({column} AS VARCHAR)) AS r
      FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL))"""


@query("agg02_unique_machines",
       _sample_sql("ping_raw", "machine_name", 10) + " UNION ALL " + _sample_sql("ping_raw", "ip_address", 10),
       "ping_raw")
def _(spark, sf):
    raw = binding.ping_raw(spark, sf)
    out = profile.column_profile(raw, 10, ["machine_name", "ip_address"])
    return out.select("column_name", "unique_count", "sample_values")


def _profile_sql(source: str, columns: dict[str, str], k: int = 8) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} GROUP BY ALL"
        for c, t in columns.items()
    ]
    return f"""
SELECT column_name, data_type,
       CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing_count,
       round(100.0 * CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS DOUBLE) / sum(n), 6) AS missing_pct,
       count(v) AS unique_count,
       string_agg(v, ', ' ORDER BY v) FILTER (WHERE r <= {k} AND v IS NOT NULL) AS sample_values
FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v NULLS LAST) AS r
      FROM ({' UNION ALL '.join(parts)}))
GROUP BY column_name, data_type"""


ORDER_TYPES = dict(zip(ORDERS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]))


@query("agg03_column_profile", _profile_sql("orders", ORDER_TYPES))
def _(spark, sf):
    return profile.column_profile(binding.table(spark, sf, "orders"))


GOLD_STATES = {c: "string" for c in fixed.GOLD_COLUMNS if c.endswith(tuple(fixed.COMPONENTS))}


@query("agg03_gold_state_profile", _profile_sql("gold", GOLD_STATES), "gold")
def _(spark, sf):
    return profile.column_profile(tables.gold(spark, sf).select(*GOLD_STATES))


DELL_TYPES = {
    "id": ("bigint", "id"), "vendor_code": ("string", "status"),
    **{c: ("string", c) for c in ["ip_address", "status", "issues_detected"]},
    **{c: ("string", c) for c in ["overall_status", "fans", "cpu", "memory", "storage", "temperature", "power"]},
    "server_name": ("string", "machine_name"), "current_problems": ("string", "current_problems"),
}


def _role_sql() -> str:
    source = "(SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in DELL_TYPES.items()) + ", CAST(NULL AS VARCHAR) AS comments FROM dell)"
    types = {c: t for c, (t, _) in DELL_TYPES.items()} | {"comments": "string"}
    lists = [("Identifier", fixed.IDENTIFIER_COLUMNS), ("Time", fixed.TIME_COLUMNS),
             ("Categorical feature", fixed.STATE_COLUMNS), ("Text feature", fixed.TEXT_COLUMNS)]
    case = "CASE " + " ".join(
        f"WHEN column_name IN ({', '.join(repr(n) for n in names)}) THEN '{role}'" for role, names in lists
    ) + " ELSE 'Review' END"
    keep = "CASE role " + " ".join(f"WHEN '{r}' THEN '{d}'" for r, d in fixed.ROLE_DECISIONS.items()) + " END"
    return f"""
SELECT *, {keep} AS keep_decision FROM (SELECT *, {case} AS role FROM ({_profile_sql(source, types)}))"""


@query("agg04_column_roles", _role_sql(), "dell")
def _(spark, sf):
    raw = binding.raw_export(spark, sf, "dell").withColumn("vendor_code", F.col("status")).drop("timestamp")
    role, keep = profile.column_role(F.col("column_name"))
    return profile.column_profile(raw).select("*", role.alias("role"), keep.alias("keep_decision"))


def _distribution_sql(source: str, column: str) -> str:
    return f"""
WITH counted AS (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY 1)
SELECT '{column}' AS column_name, value, n,
       round(100.0 * CAST(n AS DOUBLE) / (SELECT sum(n) FROM counted), 6) AS pct,
       CAST((SELECT sum(n) FROM counted) AS BIGINT) AS total_rows,
       (SELECT count(*) FROM counted) AS unique_values,
       CAST((SELECT coalesce(sum(n), 0) FROM counted WHERE value IS NULL) AS BIGINT) AS null_count
FROM counted ORDER BY n DESC, value ASC NULLS LAST LIMIT 10"""


@query("agg05_value_distribution", _distribution_sql("gold", "dell_cpu"), "gold")
def _(spark, sf):
    return profile.value_distribution(tables.gold(spark, sf), "dell_cpu")


@query("agg05_part_distribution", _distribution_sql("lineitem", "l_partkey"))
def _(spark, sf):
    return profile.value_distribution(binding.table(spark, sf, "lineitem"), "l_partkey")


SPREAD_FEATURES = (fixed.WORST_COLUMNS + fixed.COUNT_COLUMNS + ["has_active_problem"] + fixed.LAG_COLUMNS
                   + ["problems_active_sum_6slot"] + fixed.TARGETS)


@query("agg06_feature_distribution", f"""
SELECT feature, value, n, round(pct, 6) AS pct, CASE WHEN pct > 0 AND pct < 0.01 THEN '<0.01%' ELSE '' END AS mark
FROM (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY feature) AS pct FROM (
  {' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM master GROUP BY ALL" for f in SPREAD_FEATURES)}))
""", "master")
def _(spark, sf):
    return profile.feature_distribution(tables.master(spark, sf), SPREAD_FEATURES)


def _mapping_sql(source: str, left: str, right: str) -> str:
    return f"""
WITH pairs AS (SELECT DISTINCT CAST({left} AS VARCHAR) AS l, CAST({right} AS VARCHAR) AS r FROM {source}),
by_left AS (SELECT l, count(r) AS p FROM pairs WHERE l IS NOT NULL GROUP BY l),
by_right AS (SELECT r, count(l) AS p FROM pairs WHERE r IS NOT NULL GROUP BY r)
SELECT (SELECT count(*) FROM by_left) AS unique_left, (SELECT count(*) FROM by_right) AS unique_right,
       (SELECT count(*) FROM by_left WHERE p > 1) AS left_with_many,
       (SELECT count(*) FROM by_right WHERE p > 1) AS right_with_many,
       CASE WHEN (SELECT count(*) FROM by_left WHERE p > 1) = 0 AND (SELECT count(*) FROM by_right WHERE p > 1) = 0
            THEN 'one-to-one' ELSE 'one-to-many' END AS mapping_type,
       coalesce((SELECT string_agg(l || ':' || p, ', ' ORDER BY l || ':' || p) FROM
         (SELECT * FROM by_left WHERE p > 1 ORDER BY l LIMIT 5)), '') AS examples"""


@query("agg07_machine_ip_mapping", _mapping_sql("ping_raw", "machine_name", "ip_address"), "ping_raw")
def _(spark, sf):
    return profile.mapping_check(binding.ping_raw(spark, sf), "machine_name", "ip_address")


@query("agg07_customer_priority_mapping", _mapping_sql("orders", "o_custkey", "o_orderpriority"))
def _(spark, sf):
    return profile.mapping_check(binding.table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


def _parse_sql(day_first: bool = True) -> str:
    form = "%d/%m/%Y %H:%M" if day_first else "%m/%d/%Y %H:%M"
    return f"coalesce(try_strptime(txt, '{form}'), try_strptime(txt, '%Y-%m-%d %H:%M:%S'))"


TEXT_SQL = """
txt_rows AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'n/a'
    WHEN event_id % 50 = 0 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S')
    ELSE CAST(day(event_time) AS VARCHAR) || '/' || CAST(month(event_time) AS VARCHAR) || '/' ||
         CAST(year(event_time) AS VARCHAR) || ' ' || CAST(hour(event_time) AS VARCHAR) || ':' ||
         lpad(CAST(minute(event_time) AS VARCHAR), 2, '0') END AS txt FROM ping_raw)"""


@query("agg08_time_range", f"""
WITH {TEXT_SQL}, parsed AS (SELECT event_id, {_parse_sql()} AS t FROM txt_rows)
SELECT {stamp('min(t)')} AS start_time, {stamp('max(t)')} AS end_time,
       round((epoch(max(t)) - epoch(min(t))) / 86400.0, 6) AS duration_days,
       count(DISTINCT CAST(t AS DATE)) AS unique_dates,
       count(*) FILTER (WHERE t IS NULL) AS invalid_timestamps,
       (SELECT string_agg({stamp('t')}, ', ' ORDER BY event_id) FROM
          (SELECT * FROM parsed WHERE t IS NOT NULL ORDER BY event_id LIMIT 3)) AS sample_timestamps
FROM parsed""", "ping_raw")
def _(spark, sf):
    return profile.time_range(binding.ping_text(spark, sf), "timestamp", "event_id")


def _score_sql(day_first: bool, name: str) -> str:
    return f"""count(*) FILTER (WHERE {name} IS NULL) AS {name}_invalid,
      coalesce(count(*) FILTER (WHERE {name} IS NULL) * 1000
        + abs((epoch(max({name})) - epoch(min({name}))) / 86400.0 - 30), 'infinity'::DOUBLE) AS {name}_s"""


@query("scl04_day_month_order", f"""
WITH {TEXT_SQL}, parsed AS (SELECT {_parse_sql(True)} AS dmy, {_parse_sql(False)} AS mdy FROM txt_rows),
scored AS (SELECT {_score_sql(True, 'dmy')}, {_score_sql(False, 'mdy')} FROM parsed)
SELECT round(dmy_s, 6) AS dmy_score, round(mdy_s, 6) AS mdy_score, dmy_invalid, mdy_invalid,
       CASE WHEN dmy_s <= mdy_s THEN 'day/month/year' ELSE 'month/day/year' END AS selected_format FROM scored
""", "ping_raw")
def _(spark, sf):
    return profile.day_month_order(binding.ping_text(spark, sf), "timestamp")


@query("scl01_parse_time", f"""
WITH {TEXT_SQL}
SELECT event_id, txt AS raw_text, {stamp(_parse_sql())} AS parsed_time FROM txt_rows""", "ping_raw")
def _(spark, sf):
    parsed = slots.parse_time(F.col("timestamp"))
    return binding.ping_text(spark, sf).select(
        "event_id", F.col("timestamp").alias("raw_text"), slots.time_text(parsed).alias("parsed_time")
    )


@query("agg09_monitoring_frequency", f"""
WITH s AS (SELECT machine_name, {shifted('event_time')} AS slot FROM ping_raw),
per AS (SELECT machine_name, count(*) AS n FROM s GROUP BY 1)
SELECT (SELECT count(DISTINCT slot) FROM s) AS unique_slots,
       (SELECT string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) FROM (SELECT DISTINCT hour(slot) AS h FROM s)) AS slot_hours,
       (SELECT count(DISTINCT hour(slot)) FROM s) AS slots_per_day,
       min(n) AS obs_per_machine_min, max(n) AS obs_per_machine_max, CAST(median(n) AS DOUBLE) AS obs_per_machine_median,
       min(n) = max(n) AS all_equal FROM per""", "ping_raw")
def _(spark, sf):
    return profile.monitoring_frequency(binding.ping_raw(spark, sf), "machine_name", "event_time")


@query("agg10_daily_frequency", """
WITH per AS (SELECT machine_name, CAST(event_time AS DATE) AS d, count(*) AS n FROM ping_raw GROUP BY 1, 2)
SELECT min(n) AS obs_per_day_min, max(n) AS obs_per_day_max, CAST(median(n) AS DOUBLE) AS obs_per_day_median,
       (SELECT string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) FROM (SELECT DISTINCT hour(event_time) AS h FROM ping_raw)) AS raw_hours
FROM per""", "ping_raw")
def _(spark, sf):
    return profile.daily_frequency(binding.ping_raw(spark, sf), "machine_name", "event_time")


@query("agg10_rows_per_slot_hour", f"""
SELECT hour({shifted('event_time')}) AS slot_hour, count(*) AS n FROM ping_raw GROUP BY 1""", "ping_raw")
def _(spark, sf):
    return profile.rows_per_slot_hour(binding.ping_raw(spark, sf), "event_time")


@query("agg11_wrong_count_machines", """
WITH e AS (SELECT count(DISTINCT CAST(event_time AS DATE)) * 6 AS expected FROM ping_raw)
SELECT machine_name, count(*) AS observations, any_value(expected) AS expected
FROM ping_raw, e GROUP BY machine_name HAVING count(*) <> any_value(expected)""", "ping_raw")
def _(spark, sf):
    return profile.wrong_counts(binding.ping_raw(spark, sf), "machine_name", "event_time")


@query("agg12_wrong_hours_machines", f"""
SELECT machine_name, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS slot_hours
FROM (SELECT DISTINCT machine_name, hour({shifted('event_time')}) AS h FROM hpe)
GROUP BY machine_name HAVING list_sort(list(h)) <> [2, 6, 10, 14, 18, 22]""", "hpe")
def _(spark, sf):
    return profile.wrong_hours(binding.hpe(spark, sf), "machine_name", "event_time")


@query("agg12_wrong_hours_activities", f"""
SELECT machine_name, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS slot_hours
FROM (SELECT DISTINCT user_id || '|' || event_type AS machine_name, hour({shifted('ts')}) AS h FROM events)
GROUP BY machine_name HAVING list_sort(list(h)) <> [2, 6, 10, 14, 18, 22]""")
def _(spark, sf):
    """The same rule on series that do miss hours: each kind of event of each user."""
    each = binding.table(spark, sf, "events").withColumn("series", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return profile.wrong_hours(each, "series", "ts")


def _duplicates_sql(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS key_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows,
 CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS member_rows
 FROM (SELECT count(*) AS n FROM ping_raw GROUP BY {key})"""


@query("agg13_duplicate_counts", " UNION ALL ".join([
    _duplicates_sql("machine, minute", "machine_name, date_trunc('minute', event_time)"),
    _duplicates_sql("machine, ip, hour", "machine_name, ip_address, date_trunc('hour', event_time)"),
    _duplicates_sql("machine, ip, slot", "machine_name, ip_address, monitoring_slot"),
]), "ping_raw")
def _(spark, sf):
    m, ip, t = F.col("machine_name"), F.col("ip_address"), F.col("event_time")
    return profile.duplicates(binding.ping_raw(spark, sf), {
        "machine, minute": [m, F.date_trunc("minute", t)],
        "machine, ip, hour": [m, ip, F.date_trunc("hour", t)],
        "machine, ip, slot": [m, ip, F.col("monitoring_slot")],
    })


@query("agg14_machine_ip_pairs", """
SELECT count(*) AS pairs FROM (SELECT DISTINCT machine_name, ip_address FROM ping_raw)""", "ping_raw")
def _(spark, sf):
    return binding.ping_raw(spark, sf).agg(F.countDistinct("machine_name", "ip_address").alias("pairs"))


@query("agg33_data_freshness", f"""
WITH a AS (SELECT round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(event_time)))) / 3600.0, 1) AS age FROM ping_raw)
SELECT age AS data_age_hours, age > 8 AS is_stale,
       CASE WHEN age > 8 THEN 'Dataset is ' || CAST(CAST(round(age, 0) AS BIGINT) AS VARCHAR)
         || ' hours old (threshold: 8.0h). Results may not reflect current state.' END AS message FROM a""", "ping_raw")
def _(spark, sf):
    return profile.freshness(binding.ping_raw(spark, sf), "event_time", AS_OF)


def audit_log(spark, sf):
    """The event table read as a log of tool calls."""
    return binding.table(spark, sf, "events").select(
        F.col("event_id").alias("step"), F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("tool_name"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("tool_status"),
    )


@query("agg34_session_metrics", """
WITH t AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 0),
p AS (SELECT user_id, value AS p95 FROM t WHERE r = 1 + CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))
SELECT e.user_id AS session_id, count(*) AS total_steps, count(e.event_type) AS total_tool_calls,
       count(*) FILTER (WHERE e.event_type = 'error') AS total_errors,
       round(100.0 * CAST(count(*) FILTER (WHERE e.event_type = 'error') AS DOUBLE) / count(*), 6) AS error_rate_pct,
       round(coalesce(avg(e.value) FILTER (WHERE e.value > 0), 0.0), 6) AS avg_latency_ms,
       coalesce(any_value(p.p95), 0.0::DOUBLE) AS p95_latency_ms
FROM events e LEFT JOIN p USING (user_id) GROUP BY e.user_id""")
def _(spark, sf):
    return profile.session_metrics(audit_log(spark, sf))


@query("agg34_tool_usage", """
SELECT user_id AS session_id, event_type AS tool_name, count(*) AS calls FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return profile.tool_usage(audit_log(spark, sf))


@query("win08_irregular_intervals", f"""
WITH s AS (SELECT machine_name, event_id, {shifted('event_time')} AS slot, event_time FROM ping_raw),
g AS (SELECT machine_name, (epoch(slot) - epoch(lag(slot) OVER (PARTITION BY machine_name ORDER BY event_time, event_id))) / 3600.0 AS gap FROM s),
d AS (SELECT DISTINCT machine_name, CAST(gap AS BIGINT) AS gap FROM g)
SELECT machine_name, coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY gap) FILTER (WHERE gap IS NOT NULL), '') AS interval_hours
FROM d GROUP BY machine_name
HAVING coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY gap) FILTER (WHERE gap IS NOT NULL), '') <> '4'""", "ping_raw")
def _(spark, sf):
    irregular = profile.irregular_machines(binding.ping_raw(spark, sf), "machine_name", "event_time")
    hours = F.array_join(F.col("hours").cast("array<bigint>").cast("array<string>"), ",")
    return irregular.select("machine_name", hours.alias("interval_hours"))
