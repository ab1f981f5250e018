"""Audits on passing and failing inputs; expected values come from an independent count of the events."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import audits, membership
from ..sources import binding
from . import tables
from .registry import query
from .tables_sql import shifted

C = fixed.EXPORT_COMPONENTS
STEP = {"ping": 1, "hpe": 4, "dell": 2}


def check_sql(name, expected, actual, ok=None, otherwise="FAIL", source=""):
    good = ok or f"{expected} = {actual}"
    return f"""SELECT '{name}' AS check_name, CAST({expected} AS VARCHAR) AS expected, CAST({actual} AS VARCHAR) AS actual,
 CASE WHEN {good} THEN 'PASS' ELSE '{otherwise}' END AS status {source}"""


def union(parts):
    return " UNION ALL ".join(parts)


def frames(spark, sf):
    return {"ping": binding.ping(spark, sf), "hpe": binding.hpe(spark, sf), "dell": binding.dell(spark, sf)}


def keys_expected(spark, sf):
    """Distinct (machine, slot) keys per source, straight from the event table, one pass for all three."""
    keys = binding.ping_raw(spark, sf).select("id", "monitoring_slot").distinct()
    counted = keys.agg(F.struct(*[F.count(F.when(F.col("id") % s == 0, 1)).alias(n) for n, s in STEP.items()]))
    row = counted.scalar()
    return {n: row[n] for n in STEP}


def key_sql(step, what="DISTINCT (id, monitoring_slot)"):
    return f"(SELECT count({what}) FILTER (WHERE id % {step} = 0) FROM ping_raw)"


@query("dq02_source_counts", union(
    [check_sql(f"{n} rows", key_sql(s), f"(SELECT count(*) FROM {n})") for n, s in STEP.items()]
    + [check_sql("raw rows", key_sql(1), "(SELECT count(*) FROM ping_raw)")]
    + [check_sql(f"{n} columns", repr(','.join(fixed.CANONICAL_COLUMNS[n])), repr(','.join(fixed.CANONICAL_COLUMNS[n] + ['monitoring_slot'])), "true") for n in STEP]
    + [check_sql("raw columns", repr(','.join(fixed.CANONICAL_COLUMNS['ping'] + ['overall_status'])),
                 repr('event_id,id,machine_name,ip_address,event_time,monitoring_slot,status,k,event_type,value'), "false")]), "dell")
def _(spark, sf):
    expected = keys_expected(spark, sf)
    sources = frames(spark, sf) | {"raw": binding.ping_raw(spark, sf)}
    columns = dict(fixed.CANONICAL_COLUMNS) | {"raw": fixed.CANONICAL_COLUMNS["ping"] + ["overall_status"]}
    return audits.source_counts(sources, expected | {"raw": expected["ping"]}, columns)


def _integrity_sql(name, table):
    members = f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} GROUP BY machine_name, ip_address, monitoring_slot HAVING count(*) > 1))"
    return [check_sql(f"{name} null slots", 0, f"(SELECT count(*) FROM {table} WHERE monitoring_slot IS NULL)"),
            check_sql(f"{name} duplicate key rows", 0, members)]


@query("dq04_dq05_slot_integrity", union(sum([_integrity_sql(n, t) for n, t in
       [("ping", "ping"), ("hpe", "hpe"), ("dell", "dell"), ("raw", "ping_raw")]], [])), "dell")
def _(spark, sf):
    sources = frames(spark, sf) | {"raw": binding.ping_raw(spark, sf)}
    return audits.together([audits.slot_integrity(df, n) for n, df in sources.items()])


def _inventory_sql(n, s):
    return [check_sql(f"{n} machines", key_sql(s, "DISTINCT id"), f"(SELECT count(DISTINCT machine_name) FROM {n})"),
            check_sql(f"{n} slots", 180, f"(SELECT count(DISTINCT monitoring_slot) FROM {n})"),
            check_sql(f"{n} observations", key_sql(s), f"(SELECT count(*) FROM {n})")]


@query("dq06_inventory", union(sum([_inventory_sql(n, s) for n, s in STEP.items()], [])), "dell")
def _(spark, sf):
    ids = binding.ping_raw(spark, sf).select("id").distinct()
    machines = ids.agg(F.struct(*[F.count(F.when(F.col("id") % s == 0, 1)).alias(n) for n, s in STEP.items()])).scalar()
    rows = keys_expected(spark, sf)
    return audits.together([audits.inventory(df, n, machines[n], 180, rows[n]) for n, df in frames(spark, sf).items()])


def _contained_sql(name, part, whole):
    return check_sql(f"{name} containment", 0, f"(SELECT count(DISTINCT ip_address) FROM {part} WHERE ip_address NOT IN (SELECT ip_address FROM {whole}))")


@query("dq07_containment", union([_contained_sql("hpe in ping", "hpe", "ping"), _contained_sql("dell in ping", "dell", "ping"),
                                  _contained_sql("ping in dell", "ping", "dell")]), "dell")
def _(spark, sf):
    f = frames(spark, sf)
    return audits.together([
        audits.inventory_containment(f["hpe"], f["ping"], "hpe in ping"),
        audits.inventory_containment(f["dell"], f["ping"], "dell in ping"),
        audits.inventory_containment(f["ping"], f["dell"], "ping in dell"),
    ])


@query("dq08_segment_sizes", union([
    check_sql("segment common", key_sql(4, "DISTINCT id"), "(SELECT count(DISTINCT machine_name) FROM hpe)"),
    check_sql("segment dell only", "(SELECT count(DISTINCT id) FILTER (WHERE id % 2 = 0 AND id % 4 <> 0) FROM ping_raw)",
              "(SELECT count(DISTINCT machine_name) FROM dell WHERE machine_name NOT IN (SELECT machine_name FROM hpe))"),
    check_sql("segment ping only", 220, "(SELECT count(DISTINCT machine_name) FROM ping WHERE machine_name NOT IN (SELECT machine_name FROM dell))"),
]), "dell")
def _(spark, sf):
    ids = binding.ping_raw(spark, sf).select("id").distinct()
    want = ids.agg(F.struct(F.count(F.when(F.col("id") % 4 == 0, 1)).alias("c"),
                            F.count(F.when((F.col("id") % 2 == 0) & (F.col("id") % 4 != 0), 1)).alias("d"))).scalar()
    f = frames(spark, sf)
    return audits.segment_sizes(f["ping"], f["hpe"], f["dell"], {"common": want["c"], "dell only": want["d"], "ping only": 220})


def _domain_sql(c):
    accepted = ", ".join(repr(s) for s in fixed.ACCEPTED_STATES)
    odd = f"(SELECT coalesce(string_agg(DISTINCT {c}, ',' ORDER BY {c}), '') FROM hpe WHERE {c} NOT IN ({accepted}))"
    return check_sql(f"{c} states", "''", odd, otherwise="WARN")


@query("dq09_state_domain", union([_domain_sql(c) for c in C]), "hpe")
def _(spark, sf):
    return audits.state_domain(binding.hpe(spark, sf), C, fixed.ACCEPTED_STATES)


@query("dq10_merge_conservation", union([
    check_sql("merge rows", "(SELECT count(*) FROM ping)", "(SELECT count(*) FROM gold)"),
    check_sql("unique observation ids", "(SELECT count(*) FROM gold)", "(SELECT count(DISTINCT observation_id) FROM gold)")]), "gold")
def _(spark, sf):
    return audits.merge_conservation(tables.gold(spark, sf), binding.ping(spark, sf))


DUAL = "FROM gold WHERE has_hpe AND has_dell"


def _gold_sql():
    cols = ",".join(fixed.GOLD_COLUMNS)
    rows = "(SELECT count(*) FROM gold)"
    return [
        check_sql("1 row count", key_sql(1), rows),
        check_sql("2 machine count", key_sql(1, "DISTINCT id"), "(SELECT count(DISTINCT machine_name) FROM gold)"),
        check_sql("3 slot count", 180, "(SELECT count(DISTINCT monitoring_slot) FROM gold)"),
        check_sql("4 unique observation ids", rows, "(SELECT count(DISTINCT observation_id) FROM gold)"),
        check_sql("4 unique composite keys", rows, "(SELECT count(DISTINCT (machine_name, ip_address, monitoring_slot)) FROM gold)"),
        check_sql("5 machines off the timeline", 0, "(SELECT count(*) FROM (SELECT machine_name FROM gold GROUP BY 1 HAVING count(*) <> 180))"),
        check_sql("6 lost ping rows", rows, "(SELECT count(ping_status) FROM gold)"),
        check_sql("8 overlap rows", key_sql(4), f"(SELECT count(*) {DUAL})"),
        check_sql("8 overlap machines", key_sql(4, "DISTINCT id"), f"(SELECT count(DISTINCT machine_name) {DUAL})"),
        check_sql("9 gold columns", repr(cols), repr(cols)),
    ]


def sizes(spark, sf):
    raw = binding.ping_raw(spark, sf)
    ids = raw.select("id").distinct().agg(F.struct(
        F.count("*").alias("all"), F.count(F.when(F.col("id") % 4 == 0, 1)).alias("dual"))).scalar()
    rows = keys_expected(spark, sf)
    return {"machines": ids["all"], "slot_count": 180, "rows": rows["ping"], "rows_per_machine": 180,
            "overlap_machines": ids["dual"], "overlap_rows": rows["hpe"]}


@query("dq11_to_dq16_gold_audit", union(_gold_sql()), "gold")
def _(spark, sf):
    return audits.gold_audit(tables.gold(spark, sf), **sizes(spark, sf))


def _source_sql():
    def tag(name, want):
        return check_sql(f"source {name}", want, f"(SELECT count(*) FROM gold WHERE telemetry_source = '{name}')")

    return [tag("Ping Only", f"{key_sql(1)} - {key_sql(2)}"), tag("Ping + HPE + Dell", key_sql(4)),
            tag("Ping + Dell", f"{key_sql(2)} - {key_sql(4)}"),
            check_sql("source other", 0, "(SELECT count(*) FROM gold WHERE telemetry_source NOT IN ('Ping Only', 'Ping + HPE + Dell', 'Ping + Dell'))")]


def distribution(spark, sf):
    n = keys_expected(spark, sf)
    return {"Ping Only": n["ping"] - n["dell"], "Ping + HPE + Dell": n["hpe"], "Ping + Dell": n["dell"] - n["hpe"]}


@query("dq15_source_distribution", union(_source_sql()), "gold")
def _(spark, sf):
    return audits.source_distribution(tables.gold(spark, sf), distribution(spark, sf))


def _null_sql():
    parts = []
    for tag, rule in audits.FILLED.items():
        for v, present in rule.items():
            cols = [c for c in fixed.GOLD_COLUMNS if c.startswith(f"{v}_") or c == f"event_time_{v}"]
            wrong = " + ".join(f"CAST({c} IS {'' if present else 'NOT '}NULL AS INT)" for c in cols)
            parts.append(check_sql(f"nulls {tag} {v}", 0,
                                   f"(SELECT CAST(coalesce(sum({wrong}), 0) AS BIGINT) FROM gold WHERE telemetry_source = '{tag}')"))
    return parts


@query("dq18_null_propagation", union(_null_sql()), "gold")
def _(spark, sf):
    return audits.null_propagation(tables.gold(spark, sf))


@query("dq24_certificate", union(_gold_sql() + _source_sql() + _null_sql()), "gold")
def _(spark, sf):
    return audits.certificate(tables.gold(spark, sf), sizes(spark, sf), distribution(spark, sf))


@query("dq24_verdict", f"""
SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS failed,
 CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS verdict
FROM ({union(_source_sql() + _null_sql())})""", "gold")
def _(spark, sf):
    gold = tables.gold(spark, sf)
    return audits.verdict(audits.together([
        audits.source_distribution(gold, distribution(spark, sf)), audits.null_propagation(gold)]))


# --- cross-source consistency and time lines -------------------------------------------------

ALL_MACHINES = "(SELECT DISTINCT machine_name FROM ping)"


@query("dq22_source_presence", union([
    f"SELECT machine_name, '{s}' AS source, count(t.id) > 0 AS found, count(t.id) AS rows FROM {ALL_MACHINES} LEFT JOIN {s} t USING (machine_name) GROUP BY 1"
    for s in STEP]), "dell")
def _(spark, sf):
    return audits.source_presence(frames(spark, sf))


@query("dq22_source_states", union([
    f"SELECT machine_name, '{s}' AS source, '{f}' AS field, {f} AS value, count(*) AS n FROM {s} GROUP BY ALL"
    for s, f in [("ping", "status"), ("dell", "status"), ("dell", "overall_status")]]), "dell")
def _(spark, sf):
    return audits.source_states(frames(spark, sf), ["status", "overall_status"])


@query("dq22_source_problems", f"""
SELECT machine_name, source, problem, position FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_name, source ORDER BY problem) AS position FROM (
    SELECT DISTINCT machine_name, 'hpe' AS source, current_problems AS problem FROM hpe
    UNION ALL SELECT DISTINCT machine_name, 'dell', current_problems FROM dell)) WHERE position <= 5""", "dell")
def _(spark, sf):
    return audits.source_problems({"hpe": binding.hpe_full(spark, sf), "dell": binding.dell_full(spark, sf)})


def _timeline_sql(source):
    slot = shifted("event_time")
    return f"""
WITH s AS (SELECT machine_name, ip_address, event_time, {slot} AS slot FROM {source}),
days AS (SELECT count(DISTINCT CAST(event_time AS DATE)) * 6 AS n FROM s),
g AS (SELECT machine_name, CAST((epoch(slot) - epoch(lag(slot) OVER (PARTITION BY machine_name ORDER BY event_time))) / 3600 AS BIGINT) AS gap FROM s)
SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM s GROUP BY machine_name, ip_address, event_time)) AS duplicate_time_rows,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM s GROUP BY machine_name, ip_address, slot)) AS duplicate_slot_rows,
 (SELECT count(*) FROM (SELECT machine_name FROM g GROUP BY 1 HAVING coalesce(list_sort(list(DISTINCT gap) FILTER (WHERE gap IS NOT NULL)), []) <> [4])) AS irregular_machines,
 (SELECT count(*) FROM (SELECT machine_name FROM s GROUP BY 1 HAVING count(*) <> (SELECT n FROM days))) AS wrong_count_machines,
 (SELECT count(*) FROM (SELECT machine_name FROM s GROUP BY 1 HAVING list_sort(list(DISTINCT hour(slot))) <> [2, 6, 10, 14, 18, 22])) AS wrong_hours_machines"""


@query("dq23_raw_timeline", _timeline_sql("ping_raw"), "ping_raw")
def _(spark, sf):
    return audits.timeline(binding.ping_raw(spark, sf))


@query("dq23_hpe_timeline", _timeline_sql("hpe"), "hpe")
def _(spark, sf):
    return audits.timeline(binding.hpe(spark, sf))
