"""What the physical plans must and must not contain."""

import inspect
import pkgutil
import re

import pytest

import slotward
import __spark_entry__ as entry
from slotward.plans import tables
from slotward.sources import binding


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_machine_windows_share_one_exchange(spark, sf):
    text = plan(tables.master(spark, sf).select("observation_id", "ping_timeout_rate_6slot", "target_failure_6slot", "ping_status_binary_lag2"))
    by_machine = re.findall(r"Exchange hashpartitioning\(machine_name#\d+, \d+\)", text)
    assert len(by_machine) == 1 and len(re.findall(r"\bWindow ", text)) == 1


def test_gold_join_reuses_the_partitioning_of_its_keys(spark, sf):
    text = plan(tables.gold(spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning\(machine_name#\d+, ip_address#\d+, monitoring_slot#\d+", text)) == 3
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns_and_gets_the_filter(spark, sf):
    text = plan(binding.ping_raw(spark, sf).filter("id = 7").select("status"))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text and "EqualTo(user_id,7)" in text


@pytest.mark.parametrize("name", ["rpt12_sort04_recent_alerts", "agg29_incident_profile", "dq11_to_dq16_gold_audit",
                                  "set01_set02_machine_overlaps", "agg03_column_profile", "rpt02_server_history"])
def test_no_pairing_of_whole_tables_and_no_python_rows(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "PythonUDF"):
        assert word not in text


def test_library_has_no_cross_join_local_checkpoint_or_rdd():
    for module in pkgutil.walk_packages(slotward.__path__, "slotward."):
        source = inspect.getsource(__import__(module.name, fromlist=["_"]))
        for word in ("crossJoin", "localCheckpoint", ".rdd", "F.udf"):
            assert word not in source, (module.name, word)


def test_risk_tiers_read_the_fleet_once_and_narrow(spark, sf):
    """Both horizons come from one pass, and the newest rows carry only what the scores need."""
    text = entry.queries()["rpt08_risk_tiers"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and len(re.findall(r"\bWindow \[", text)) == 1
    assert len(tables.fleet(spark, sf).columns) < 12
