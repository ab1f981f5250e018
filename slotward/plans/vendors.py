"""Source comparisons and inventory sets."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import membership, vendors
from ..sources import binding
from . import tables
from .registry import query
from .tables_sql import any_equals, rank_case, shifted, stamp

C = fixed.COMPONENTS
DUAL = "(SELECT * FROM gold WHERE has_hpe AND has_dell)"
DIFFERS = "(" + " OR ".join(f"hpe_{c} IS DISTINCT FROM dell_{c}" for c in C) + ")"


def dual(spark, sf):
    return vendors.dual_monitored(tables.gold(spark, sf))


ALIGNED_SQL = f"""
aligned AS (SELECT machine_name, ip_address, slot, {', '.join(f'h.{c} AS {c}_hpe, d.{c} AS {c}_dell' for c in C)}
 FROM (SELECT *, {shifted('event_time')} AS slot FROM hpe) h
 JOIN (SELECT *, {shifted('event_time')} AS slot FROM dell) d USING (machine_name, ip_address, slot))"""


def aligned(spark, sf):
    return vendors.aligned(binding.hpe(spark, sf), binding.dell(spark, sf))


@query("join03_aligned_sources", f"""
WITH {ALIGNED_SQL} SELECT * REPLACE ({stamp('slot')} AS slot) FROM aligned""", "dell")
def _(spark, sf):
    return aligned(spark, sf).withColumn("slot", F.date_format("slot", fixed.ISO))


@query("agg16_match_rates", f"WITH {ALIGNED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS component, count(*) FILTER (WHERE {c}_hpe = {c}_dell) AS matches, count(*) AS aligned_rows,
    round(100.0 * CAST(count(*) FILTER (WHERE {c}_hpe = {c}_dell) AS DOUBLE) / count(*), 6) AS match_pct FROM aligned"""
    for c in C), "dell")
def _(spark, sf):
    return vendors.match_rates(aligned(spark, sf))


@query("agg17_mismatch_rows", f"""
WITH {ALIGNED_SQL} SELECT * REPLACE ({stamp('slot')} AS slot) FROM aligned
WHERE {' OR '.join(f'{c}_hpe IS DISTINCT FROM {c}_dell' for c in C)}
ORDER BY machine_name, slot, ip_address LIMIT 20""", "dell")
def _(spark, sf):
    return vendors.mismatch_rows(aligned(spark, sf))


@query("agg18_mismatch_pairs", " UNION ALL ".join(
    f"SELECT '{c}' AS component, hpe_{c} AS hpe_value, dell_{c} AS dell_value, count(*) AS n FROM {DUAL} WHERE hpe_{c} <> dell_{c} GROUP BY ALL"
    for c in C), "gold")
def _(spark, sf):
    return vendors.mismatch_pairs(dual(spark, sf))


@query("agg19_disagreement_totals", " UNION ALL ".join(
    f"""SELECT '{c}' AS component, count(*) FILTER (WHERE {p}) AS mismatches, count(*) AS rows,
    round(100.0 * CAST(count(*) FILTER (WHERE {p}) AS DOUBLE) / count(*), 6) AS mismatch_pct,
    round(100.0 * CAST(count(*) FILTER (WHERE NOT {p}) AS DOUBLE) / count(*), 6) AS agreement_pct FROM {DUAL}"""
    for c, p in [(c, f"(hpe_{c} IS DISTINCT FROM dell_{c})") for c in C] + [("any", DIFFERS)]), "gold")
def _(spark, sf):
    return vendors.disagreement_totals(dual(spark, sf))


def _top(v: str) -> str:
    return "greatest(" + ", ".join(f"coalesce({rank_case(f'{v}_{c}', fixed.DOMINANCE_RANKS)}, 0)" for c in C) + ")"


@query("agg20_severity_dominance", f"""
WITH t AS (SELECT {_top('hpe')} AS h, {_top('dell')} AS d FROM {DUAL} WHERE {DIFFERS})
SELECT count(*) AS mismatch_rows, count(*) FILTER (WHERE h > d) AS hpe_more_severe,
       count(*) FILTER (WHERE d > h) AS dell_more_severe,
       round(100.0 * CAST(count(*) FILTER (WHERE h > d) AS DOUBLE) / count(*), 6) AS hpe_pct,
       round(100.0 * CAST(count(*) FILTER (WHERE d > h) AS DOUBLE) / count(*), 6) AS dell_pct FROM t""", "gold")
def _(spark, sf):
    return vendors.dominance(dual(spark, sf))


@query("agg21_component_richness", " UNION ALL ".join(
    f"""SELECT '{v}' AS vendor, '{c}' AS component, count(*) FILTER (WHERE {v}_{c} IS NULL) AS null_cells,
    count(DISTINCT {v}_{c}) AS states, string_agg(DISTINCT {v}_{c}, ',' ORDER BY {v}_{c}) AS state_names FROM {DUAL}"""
    for v in ("hpe", "dell") for c in C), "gold")
def _(spark, sf):
    return vendors.component_richness(dual(spark, sf))


def _cells(v: str) -> str:
    names = [c for c in fixed.GOLD_COLUMNS if c.startswith(f"{v}_")]
    return "CAST(sum(" + " + ".join(f"CAST({c} IS NULL AS INT)" for c in names) + ") AS BIGINT)"


@query("agg21_vendor_totals", f"""
SELECT 'hpe' AS vendor, count(*) AS rows, {_cells('hpe')} AS null_cells, count(hpe_current_problems) AS text_rows FROM {DUAL}
UNION ALL
SELECT 'dell' AS vendor, count(*) AS rows, {_cells('dell')} AS null_cells, count(dell_issues_detected) AS text_rows FROM {DUAL}
""", "gold")
def _(spark, sf):
    return vendors.vendor_totals(dual(spark, sf))


@query("agg21_overall_status_counts", f"""
SELECT dell_overall_status, count(*) AS n FROM {DUAL} GROUP BY 1""", "gold")
def _(spark, sf):
    return dual(spark, sf).groupBy("dell_overall_status").agg(F.count("*").alias("n"))


@query("agg22_mismatches_per_machine", f"""
SELECT machine_name, count(*) AS mismatch_rows FROM {DUAL} WHERE {DIFFERS} GROUP BY 1 ORDER BY 2 DESC, 1""", "gold")
def _(spark, sf):
    return vendors.mismatches_per_machine(dual(spark, sf)).orderBy(F.desc("mismatch_rows"), "machine_name")


TEXT_GOLD = [c for c in fixed.GOLD_COLUMNS if not c.startswith(("event_time", "has_"))]
STATE_GOLD = [c for c in fixed.GOLD_COLUMNS if any(part in c for part in C)]


@query("agg23_value_scan", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 'NOT OK') AS n,
    round(100.0 * CAST(count(*) FILTER (WHERE {c} = 'NOT OK') AS DOUBLE) / count(*), 6) AS pct FROM gold"""
    for c in TEXT_GOLD) + ") WHERE n > 0", "gold")
def _(spark, sf):
    return vendors.value_scan(tables.gold(spark, sf), "NOT OK")


@query("agg24_value_holders", f"""
SELECT machine_name, count(*) AS n, string_agg(DISTINCT telemetry_source, ', ' ORDER BY telemetry_source) AS sources
FROM gold WHERE {any_equals(TEXT_GOLD, 'NOT OK')} GROUP BY 1""", "gold")
def _(spark, sf):
    return vendors.holders_by_machine(tables.gold(spark, sf), "NOT OK")


@query("agg25_co_occurrence", f"""
WITH t AS (SELECT {any_equals(STATE_GOLD, 'Critical')} AS c, {any_equals(STATE_GOLD, 'Degraded')} AS d
           FROM gold WHERE {any_equals(TEXT_GOLD, 'NOT OK')})
SELECT count(*) AS rows, count(*) FILTER (WHERE c AND d) AS both, count(*) FILTER (WHERE c AND NOT d) AS also_critical,
       count(*) FILTER (WHERE d AND NOT c) AS also_degraded, count(*) FILTER (WHERE NOT c AND NOT d) AS neither FROM t""", "gold")
def _(spark, sf):
    return vendors.co_occurrence(tables.gold(spark, sf), "NOT OK")


@query("flt01_dual_monitored", f"""
SELECT observation_id, hpe_cpu, dell_cpu, dell_overall_status FROM {DUAL}""", "gold")
def _(spark, sf):
    return dual(spark, sf).select("observation_id", "hpe_cpu", "dell_cpu", "dell_overall_status")


@query("flt02_any_column_equals", f"""
SELECT observation_id, telemetry_source FROM gold WHERE {any_equals(TEXT_GOLD, 'NOT OK')}""", "gold")
def _(spark, sf):
    return vendors.holding(tables.gold(spark, sf), "NOT OK").select("observation_id", "telemetry_source")


# --- inventories -----------------------------------------------------------------------------

SOURCES = ("ping", "hpe", "dell")


def frames(spark, sf):
    return {"ping": binding.ping(spark, sf), "hpe": binding.hpe(spark, sf), "dell": binding.dell(spark, sf)}


def _overlap_sql(label: str, keys: str) -> str:
    def entry(name, members, k):
        have = " INTERSECT ".join(f"SELECT DISTINCT {keys} FROM {s}" for s in members)
        return f"""SELECT '{name}' AS combination, count(*) AS n,
 coalesce(string_agg(l, ', ' ORDER BY l) FILTER (WHERE r <= {k}), '') AS sample
 FROM (SELECT {label} AS l, row_number() OVER (ORDER BY {label}) AS r FROM ({have}))"""

    parts = [entry(f"{a} & {b}", (a, b), 5) for a, b in combinations(SOURCES, 2)] + [entry("all", SOURCES, 10)]
    return " UNION ALL ".join(parts)


@query("set01_set02_machine_overlaps", _overlap_sql("machine_name", "machine_name"), "dell")
def _(spark, sf):
    return membership.overlaps(frames(spark, sf), ["machine_name"])


@query("set06_pair_overlaps", _overlap_sql("machine_name || '|' || ip_address", "machine_name, ip_address"), "dell")
def _(spark, sf):
    return membership.overlaps(frames(spark, sf), ["machine_name", "ip_address"])


@query("set03_only_in_one_source", """
SELECT machine_name, min(s) AS source FROM (
  SELECT DISTINCT machine_name, 'ping' AS s FROM ping UNION ALL SELECT DISTINCT machine_name, 'hpe' FROM hpe
  UNION ALL SELECT DISTINCT machine_name, 'dell' FROM dell)
GROUP BY machine_name HAVING count(*) = 1""", "dell")
def _(spark, sf):
    return membership.only_in_one(frames(spark, sf), ["machine_name"])


def _containment_sql(part: str, part_key: str, whole: str, whole_key: str) -> str:
    return f"""
WITH missing AS (SELECT DISTINCT {part_key} AS k FROM {part} WHERE {part_key} IS NOT NULL
                 AND {part_key} NOT IN (SELECT {whole_key} FROM {whole} WHERE {whole_key} IS NOT NULL))
SELECT count(*) AS missing_keys, count(*) = 0 AS is_subset,
       coalesce((SELECT string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k) FROM (SELECT k FROM missing ORDER BY k LIMIT 5)), '') AS sample
FROM missing"""


@query("set04_join04_subset_test", _containment_sql("hpe", "ip_address", "ping", "ip_address"), "hpe")
def _(spark, sf):
    return membership.containment(binding.hpe(spark, sf), binding.ping(spark, sf), "ip_address")


@query("set04_subset_violation", _containment_sql("customer", "c_custkey", "orders", "o_custkey"))
def _(spark, sf):
    customers = binding.table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    orders = binding.table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    return membership.containment(customers, orders, "key")


@query("set05_segments", """
SELECT CASE WHEN machine_name IN (SELECT machine_name FROM hpe) AND machine_name IN (SELECT machine_name FROM dell) THEN 'common'
            WHEN machine_name IN (SELECT machine_name FROM dell) THEN 'dell only'
            WHEN machine_name IN (SELECT machine_name FROM hpe) THEN 'hpe only' ELSE 'ping only' END AS segment,
       count(DISTINCT machine_name) AS machines, count(*) AS observations FROM ping GROUP BY 1""", "dell")
def _(spark, sf):
    return membership.segments(**frames(spark, sf))


@query("join05_same_ip", """
WITH a AS (SELECT DISTINCT machine_name, ip_address FROM hpe), b AS (SELECT DISTINCT machine_name, ip_address FROM dell)
SELECT count(*) AS overlapping, count(*) FILTER (WHERE a.ip_address = b.ip_address) AS same,
       count(*) FILTER (WHERE a.ip_address <> b.ip_address) AS different FROM a JOIN b USING (machine_name)""", "dell")
def _(spark, sf):
    return membership.same_partner(binding.hpe(spark, sf), binding.dell(spark, sf), "machine_name", "ip_address")
