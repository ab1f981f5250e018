"""Publication with its audits, and the streamed gold against the batch one."""

import pytest
from pyspark.sql import functions as F

from slotward.functions import fixed
from slotward.operators import audit_log, audits, gold
from slotward.plans import audits as audit_plans, publish, reports as report_plans, tables
from slotward.session import fresh_path
from slotward.sources import binding, sinks
from slotward.streaming import arrivals


def test_failed_audit_stops_the_publication(spark, sf):
    folder = fresh_path(spark, "publish")
    sources = binding.ping(spark, sf), binding.hpe(spark, sf), binding.dell(spark, sf)
    with pytest.raises(audits.AuditFailed, match="machines off the timeline"):
        publish.publish_gold(*sources, folder, audit_plans.sizes(spark, sf), audit_plans.distribution(spark, sf))
    assert spark.read.parquet(f"{folder}/certificate").filter("status = 'FAIL'").count() >= 1


def test_complete_slot_is_published_and_verified(spark, sf):
    folder = fresh_path(spark, "publish")
    one = "monitoring_slot = '2024-01-02_Slot-10'"
    ping, hpe, dell = (f(spark, sf).filter(one) for f in (binding.ping, binding.hpe, binding.dell))
    n, h, d = ping.count(), hpe.count(), dell.count()
    sizes = dict(machines=n, slot_count=1, rows=n, rows_per_machine=1, overlap_machines=h, overlap_rows=h)
    gold = publish.publish_gold(ping, hpe, dell, folder, sizes, {"Ping Only": n - d, "Ping + HPE + Dell": h, "Ping + Dell": d - h})
    assert gold.columns == fixed.GOLD_COLUMNS and gold.count() == n
    master = publish.publish_master(gold, folder)
    assert master.count() == n and len(master.columns) == 67
    check = sinks.verify_written(gold, spark.read.parquet(f"{folder}/gold").drop("slot_date")).first()
    assert check.same_content and check.same_schema


def test_streamed_gold_has_the_batch_rows(spark, sf):
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "streamed")
    ping = binding.ping(spark, sf)
    ping.write.parquet(source)
    stream = spark.readStream.schema(ping.schema).parquet(source)
    hpe, dell = binding.hpe(spark, sf), binding.dell(spark, sf)
    for _ in range(2):  # the second run finds nothing new
        arrivals.append_gold(stream, hpe, dell, out, f"{out}-state").awaitTermination()
    streamed, batch = spark.read.parquet(out), tables.gold(spark, sf)
    assert streamed.count() == batch.count()
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0


def test_earliest_event_wins_in_any_order_of_deliveries(spark, sf):
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "streamed")
    raw = binding.ping_raw(spark, sf).select(*fixed.CANONICAL_COLUMNS["ping"], "monitoring_slot")
    hpe, dell = binding.hpe(spark, sf), binding.dell(spark, sf)
    # Later events are delivered first, and early ones arrive in a second run.
    middle = raw.agg(F.expr("percentile_approx(event_time, 0.5)")).first()[0]
    for part in (raw.filter(F.col("event_time") >= middle), raw.filter(F.col("event_time") < middle), raw.limit(50)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        arrivals.append_gold(stream, hpe, dell, out, f"{out}-state").awaitTermination()
    batch = gold.build_gold(arrivals.earliest(raw, "event_time"), hpe, dell)
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_log_takes_a_step_once(spark, sf):
    path, calls = fresh_path(spark, "audit-log"), report_plans.tool_calls(spark, sf)
    first, rest = calls.filter("step < 300"), calls.filter("step >= 300")
    assert audit_log.read(spark, path).count() == 0
    for part in (first, rest, first, first.union(rest), rest.union(rest)):
        audit_log.append(part, path)
    log = audit_log.read(spark, path)
    assert log.columns == list(audit_log.FIELDS) and dict(log.dtypes) == audit_log.FIELDS
    assert log.count() == calls.count() == log.select("session_id", "step").distinct().count()
    one = log.filter("step = 5").first()
    want = calls.filter("step = 5").first()
    assert (one["tool_args"], one["evidence"].toPython(), one["timestamp"]) == (want["tool_args"], want["evidence"].toPython(), want["timestamp"])


def test_log_of_sparse_and_odd_records(spark):
    path = fresh_path(spark, "audit-log")
    kind = "session_id string, step long, timestamp timestamp_ntz, tool_name string, other int"
    rows = [("a", 1, None, None, 1), ("a", 1, None, "ping", 2), (None, 2, None, "ping", 3), ("a", None, None, "ping", 4), ("b", 1, None, "ping", 5)]
    for _ in range(2):
        audit_log.append(spark.createDataFrame(rows, kind), path)
        audit_log.append(spark.createDataFrame([], kind), path)
    found = {(r["session_id"], r["step"]): r for r in audit_log.read(spark, path).collect()}
    assert sorted(found) == [("a", 1), ("b", 1)] and found["b", 1]["tool_status"] == "SUCCESS" and found["b", 1]["tool_args"] == {}
    assert audit_log.of_tool(audit_log.read(spark, path), "ping").filter("session_id = 'b'").count() == 1
    assert audit_log.sessions(audit_log.read(spark, path)).filter("session_id = 'a'").first()["steps"] == 1
    bare = audit_log.read(spark, path).select(audit_log.evidence_field("$.x", "int").alias("x"))
    assert bare.filter("x is not null").count() == 0
