"""Null rules and edge cases on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotward.functions import fixed, health, slots
from slotward.operators import audits, gold, profile, ranking, screening, temporal, transitions, vendors


def ts(text):
    return dt.datetime.fromisoformat(text)


def series(spark, values, columns=("ping_status_binary", "critical_component_count")):
    rows = [("m", "ip", f"2024-01-{d // 6 + 1:02d}_Slot-{d % 6 * 4 + 2:02d}", None, str(d), *v) for d, v in enumerate(values)]
    names = ["machine_name", "ip_address", "monitoring_slot", "event_time_ping", "observation_id", *columns]
    kinds = "string, ip_address string, monitoring_slot string, event_time_ping timestamp_ntz, observation_id string, "
    return spark.createDataFrame(rows, f"machine_name {kinds}" + ", ".join(f"{c} int" for c in names[5:]))


def test_two_grids_disagree_outside_shared_hours(spark):
    rows = [(ts("2024-01-02 00:30:00"),), (ts("2024-01-02 02:10:00"),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    out = df.select(slots.slot_label(F.col("t")), slots.time_text(slots.shifted_slot(F.col("t")))).collect()
    assert [tuple(r) for r in out] == [
        ("2024-01-02_Slot-02", "2024-01-01 22:00:00"), ("2024-01-02_Slot-02", "2024-01-02 02:00:00"), (None, None)]


def test_parse_is_day_first_and_tolerant(spark):
    df = spark.createDataFrame([("1/7/2026 10:00",), ("2026-07-02 03:04:05",), ("n/a",), (None,)], "s string")
    got = [r[0] for r in df.select(slots.time_text(slots.parse_time(F.col("s")))).collect()]
    assert got == ["2026-07-01 10:00:00", "2026-07-02 03:04:05", None, None]


def test_slot_time_is_the_middle_of_the_slot(spark):
    df = spark.createDataFrame([("2024-01-02_Slot-06",)], "s string")
    assert df.select(slots.time_text(slots.slot_time(F.col("s")))).first()[0] == "2024-01-02 06:00:00"


def test_observation_id_is_null_when_a_part_is(spark):
    ping = spark.createDataFrame([(None, "ip", ts("2024-01-01 01:00:00"), "Reachable", "s")],
                                 "machine_name string, ip_address string, event_time timestamp_ntz, status string, monitoring_slot string")
    hw = ping.limit(0).select("machine_name", "ip_address", "event_time", *[F.lit("OK").alias(c) for c in fixed.EXPORT_COMPONENTS],
                              F.lit("").alias("current_problems"), "monitoring_slot")
    dell = hw.withColumnRenamed("current_problems", "issues_detected").withColumns({"status": F.lit("OK"), "overall_status": F.lit("OK")})
    row = gold.build_gold(ping, hw, dell).first()
    assert row.observation_id is None and row.telemetry_source == "Ping Only" and list(row.asDict()) == fixed.GOLD_COLUMNS


def test_unknown_states_map_to_null_and_worst_ignores_nulls(spark):
    df = spark.createDataFrame([("OK", "NOT OK"), (None, "Odd"), ("Critical", None), ("Warning", "Degraded")], "hpe_cpu string, dell_cpu string")
    out = df.select(F.greatest(health.severity("hpe_cpu"), health.severity("dell_cpu"))).collect()
    assert [r[0] for r in out] == [2, None, 3, 2]


def test_missing_differs_from_everything(spark):
    rows = [(True, True, "OK", "OK"), (True, True, None, "OK"), (True, True, None, None), (True, False, "OK", None)]
    df = spark.createDataFrame(rows, "has_hpe boolean, has_dell boolean, hpe_cpu string, dell_cpu string")
    assert [r[0] for r in df.select(health.disagreement("cpu")).collect()] == [0, 1, 1, 0]


def test_counts_ignore_nulls(spark):
    df = spark.createDataFrame([(3, 3, None), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(health.count_at(["a", "b", "c"], 3)).collect()] == [2, 0]


def test_labels_need_one_future_value(spark):
    rows = series(spark, [(0, 0), (None, 0), (1, 0), (0, 0)])
    out = temporal.labels(rows).orderBy("monitoring_slot").collect()
    assert [r.target_failure_3slot for r in out] == [1, 1, 0, None]
    assert [r.target_hardware_failure_3slot for r in out] == [0, 0, 0, None]
    assert [r.helper_current_failure_state for r in out] == [0, None, 1, 0]


def test_rolling_windows_skip_nulls(spark):
    rows = series(spark, [(1, 0), (None, 0), (0, 0)]).withColumn("has_active_problem", F.coalesce("ping_status_binary", F.lit(0)))
    out = temporal.history_features(rows).orderBy("monitoring_slot").collect()
    assert [r.ping_timeout_rate_3slot for r in out] == [1.0, 1.0, 0.5]
    assert [r.ping_status_binary_lag1 for r in out] == [None, 1, None]


def test_duplicate_variants(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "k string")
    row = profile.duplicates(df, {"k": [F.col("k")]}).first()
    assert (row.extra_rows, row.member_rows) == (3, 5)


def test_intervals_of_a_hot_slot_and_of_a_single_row(spark):
    rows = [("hot", ts("2024-01-01 02:00:00"))] * 3 + [("hot", ts("2024-01-01 06:00:00")), ("one", ts("2024-01-01 02:00:00"))]
    rows += [("fine", ts("2024-01-01 02:00:00")), ("fine", ts("2024-01-01 06:00:00"))]
    df = spark.createDataFrame(rows, "m string, t timestamp_ntz")
    got = {r.machine_name: r.hours for r in profile.irregular_machines(df, "m", "t").collect()}
    assert got == {"hot": [0.0, 4.0], "one": []}


def test_null_counts_as_a_value_for_constants(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, None)], "a int, b int, c int")
    got = {r.feature for r in screening.constant_features(df, ["a", "b", "c"]).collect()}
    assert got == {"a", "b"}


def test_day_month_order_prefers_the_month_long_reading(spark):
    df = spark.createDataFrame([(f"{d}/6/2026 10:00",) for d in range(1, 31)], "s string")
    assert profile.day_month_order(df, "s").first().selected_format == "day/month/year"
    empty = spark.createDataFrame([("x",)], "s string")
    row = profile.day_month_order(empty, "s").first()
    assert row.dmy_score == float("inf") and row.selected_format == "day/month/year"


def test_positions_and_percentiles_over_many_blocks(spark):
    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 37) % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    placed = ranking.with_position(df, [F.desc("v")])
    assert placed.filter(F.col("position") != 1000 - F.col("v")).count() == 0
    hot = df.withColumn("k", F.when(F.col("v") < 900, 0).otherwise(F.col("k")))
    sums = ranking.running_totals(hot.groupBy("k").agg(F.count("*").alias("n")), [F.col("k")], {"upto": "n"})
    assert sums.agg(F.max("upto")).first()[0] == 1000
    got = ranking.exact_percentiles(df, "v", {"a": 0.5, "b": 0.98, "c": 1.0})
    assert (got["a"], round(got["b"], 6), got["c"]) == (499.5, 979.02, 999)
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1)], "v double, n long")
    assert ranking.exact_percentiles(weighted, "v", {"a": 0.75, "b": 0.9}, "n") == {"a": 1.25, "b": pytest.approx(1.7)}


def test_p95_is_the_element_at_the_floor_index(spark):
    rows = [(1, i, "t", float(i), "SUCCESS") for i in range(1, 41)] + [(2, 1, "t", 0.0, "ERROR"), (2, 2, None, 9.0, "ERROR")]
    log = spark.createDataFrame(rows, "session_id long, step long, tool_name string, latency_ms double, tool_status string")
    got = {r.session_id: r for r in profile.session_metrics(log).collect()}
    assert got[1].p95_latency_ms == 39.0 and got[2].p95_latency_ms == 0.0
    assert got[2].error_rate_pct == 100.0 and got[2].total_tool_calls == 1


def test_transitions_encode_the_start(spark):
    rows = series(spark, [(0, 0), (1, 0), (1, 0)])
    got = {(r.previous, r.current): r.n for r in transitions.transition_counts(rows, "ping_status_binary").collect()}
    assert got == {(-1, 0): 1, (0, 1): 1, (1, 1): 1}


def test_dominance_ranks_are_a_parameter(spark):
    base = {f"{v}_{c}": "OK" for v in ("hpe", "dell") for c in fixed.COMPONENTS}
    df = spark.createDataFrame([{**base, "dell_cpu": "NOT OK"}])
    assert vendors.dominance(df).first().dell_more_severe == 0
    assert vendors.dominance(df, fixed.SEVERITY_RANKS).first().dell_more_severe == 1


def test_safe_casts(spark):
    df = spark.createDataFrame([("12.75",), ("-3",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(health.whole_number(F.col("s"), 7)).collect()] == [12, -3, 7, 7]


def audit_table(spark, statuses):
    return spark.createDataFrame([(f"c{i}", "1", "1", s) for i, s in enumerate(statuses)], "check_name string, expected string, actual string, status string")


def test_require_raises_only_on_failures(spark):
    audits.require(audit_table(spark, ["PASS", "WARN"]))
    with pytest.raises(audits.AuditFailed, match="c1"):
        audits.require(audit_table(spark, ["PASS", "FAIL"]))


def test_gold_audit_passes_and_fails(spark, sf):
    from slotward.plans import tables

    table = ranking.pinned(tables.gold(spark, sf).filter("monitoring_slot = '2024-01-02_Slot-10'"))
    n, dual = table.count(), table.filter("has_hpe AND has_dell").count()
    sizes = dict(machines=n, slot_count=1, rows=n, rows_per_machine=1, overlap_machines=dual, overlap_rows=dual)
    assert audits.verdict(audits.gold_audit(table, **sizes)).first().verdict == "APPROVED"
    broken = table.unionByName(table.limit(1)).withColumn("ping_status", F.lit(None).cast("string"))
    failed = {r.check_name for r in audits.gold_audit(broken, **sizes).filter("status = 'FAIL'").collect()}
    assert {"1 row count", "4 unique observation ids", "4 unique composite keys", "5 machines off the timeline", "6 lost ping rows"} <= failed
    half = table.withColumn("dell_cpu", F.lit(None).cast("string"))
    assert audits.null_propagation(half).filter("status = 'FAIL'").count() == 2
