"""Declarative audits: every check is one row (check_name, expected, actual, status)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.numbers import tally, total
from . import membership, profile, shape


class AuditFailed(Exception):
    """At least one audit row is FAIL."""


def check(name: str, expected, actual: Column, ok: Column | None = None, otherwise: str = "FAIL") -> dict[str, Column]:
    want = expected if isinstance(expected, Column) else F.lit(expected)
    good = (want == actual) if ok is None else ok
    return {"check_name": F.lit(name), "expected": want.cast("string"), "actual": actual.cast("string"),
            "status": F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise(otherwise)}


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict(audit: DataFrame) -> DataFrame:
    """Checks, failures and the overall verdict."""
    return audit.agg(
        F.count("*").alias("checks"), tally(F.col("status") == "FAIL").alias("failed"),
        F.when(tally(F.col("status") == "FAIL") == 0, "APPROVED").otherwise("REJECTED").alias("verdict"),
    )


def require(audit: DataFrame) -> None:
    """Stop the run when a check failed, naming the failed checks."""
    failed = audit.filter(F.col("status") == "FAIL").orderBy("check_name").collect()  # as many as there are checks
    if failed:
        raise AuditFailed("; ".join(f"{r.check_name}: expected {r.expected}, got {r.actual}" for r in failed))


def schema_check(name: str, df: DataFrame, columns: list[str], exact: bool = False) -> dict[str, Column]:
    """Columns are compared on the driver; the outcome is an audit row like any other."""
    fine = df.columns == columns if exact else set(columns) <= set(df.columns)
    return check(name, ",".join(columns), F.lit(",".join(df.columns)), F.lit(fine))


def source_counts(frames: dict[str, DataFrame], expected: dict, columns: dict[str, list[str]]) -> DataFrame:
    """Row count per source and presence of the expected columns."""
    parts = []
    for name, df in frames.items():
        counted = df.agg(F.count("*").alias("rows"))
        parts.append(shape.rows_of(counted, [
            check(f"{name} rows", expected[name], F.col("rows")), schema_check(f"{name} columns", df, columns[name])
        ]))
    return together(parts)


def slot_integrity(df: DataFrame, name: str) -> DataFrame:
    """Slots are never null and the key is unique."""
    groups = df.groupBy(*fixed.KEY).agg(F.count("*").alias("n"))
    counted = groups.agg(
        total(F.when(F.col("monitoring_slot").isNull(), F.col("n"))).alias("nulls"),
        total(F.when(F.col("n") > 1, F.col("n"))).alias("members"),
    )
    return shape.rows_of(counted, [
        check(f"{name} null slots", 0, F.col("nulls")), check(f"{name} duplicate key rows", 0, F.col("members"))
    ])


def inventory(df: DataFrame, name: str, machines, slot_count, rows) -> DataFrame:
    """Distinct machines, distinct slots and observations of one source."""
    per = df.groupBy("machine_name").agg(F.count("*").alias("n"))
    slots_seen = df.select("monitoring_slot").distinct().agg(F.count("monitoring_slot")).scalar()
    counted = per.agg(F.count("machine_name").alias("machines"), F.sum("n").alias("rows"))
    return shape.rows_of(counted, [
        check(f"{name} machines", machines, F.col("machines")), check(f"{name} slots", slot_count, slots_seen),
        check(f"{name} observations", rows, F.col("rows")),
    ])


def inventory_containment(part: DataFrame, whole: DataFrame, name: str, key: str = "ip_address") -> DataFrame:
    found = membership.containment(part, whole, key)
    return shape.rows_of(found, [check(f"{name} containment", 0, F.col("missing_keys"))])


def segment_sizes(ping: DataFrame, hpe: DataFrame, dell: DataFrame, expected: dict) -> DataFrame:
    """Machines per segment against the expected sizes; absent segments count 0."""
    sizes = membership.segments(ping, hpe, dell)
    wide = sizes.agg(*[F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("machines"))), F.lit(0)).alias(s) for s in expected])
    return shape.rows_of(wide, [check(f"segment {s}", want, F.col(s)) for s, want in expected.items()])


def state_domain(df: DataFrame, columns: list[str], allowed: list[str]) -> DataFrame:
    """States outside the accepted list; a finding is a warning, not a failure."""
    long = df.unpivot([], columns, "component", "state").filter(F.col("state").isNotNull() & ~F.col("state").isin(allowed))
    odd = long.groupBy("component", "state").agg(F.count("*").alias("n"))
    wide = odd.agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("component") == c, F.col("state")))), ",").alias(c) for c in columns
    ])
    return shape.rows_of(wide, [check(f"{c} states", "", F.col(c), otherwise="WARN") for c in columns])


def merge_conservation(gold: DataFrame, anchor: DataFrame) -> DataFrame:
    """The join keeps the anchor's rows and the observation id stays unique."""
    anchor_rows = anchor.agg(F.count("*")).scalar()
    ids = gold.groupBy("observation_id").agg(F.count("*").alias("n"))
    counted = ids.agg(F.sum("n").alias("rows"), F.count("observation_id").alias("ids"))
    return shape.rows_of(counted, [
        check("merge rows", anchor_rows, F.col("rows")), check("unique observation ids", F.col("rows"), F.col("ids")),
    ])


def _null_cells(columns: list[str], present: bool) -> Column:
    wrong = [F.col(c).isNotNull() if not present else F.col(c).isNull() for c in columns]
    return sum((w.cast("int") for w in wrong), F.lit(0))


# Which vendor families must be filled under each source tag.
FILLED = {"Ping Only": {"hpe": False, "dell": False}, "Ping + Dell": {"hpe": False, "dell": True},
          "Ping + HPE + Dell": {"hpe": True, "dell": True}}


def null_propagation(gold: DataFrame) -> DataFrame:
    """Cells that are filled where they must be null, or null where they must be filled."""
    family = {v: [c for c in gold.columns if c.startswith(f"{v}_") or c == f"event_time_{v}"] for v in ("hpe", "dell")}
    sums = {
        (tag, v): total(F.when(F.col("telemetry_source") == tag, _null_cells(family[v], present)))
        for tag, rule in FILLED.items() for v, present in rule.items()
    }
    wide = gold.agg(*[s.alias(f"{tag}/{v}") for (tag, v), s in sums.items()])
    return shape.rows_of(wide, [check(f"nulls {tag} {v}", 0, F.col(f"`{tag}/{v}`")) for tag, v in sums])


def source_distribution(gold: DataFrame, expected: dict) -> DataFrame:
    """Rows per source tag against the expected map; unexpected tags fail too."""
    counts = gold.groupBy("telemetry_source").agg(F.count("*").alias("n"))
    known = [F.coalesce(F.sum(F.when(F.col("telemetry_source") == t, F.col("n"))), F.lit(0)).alias(t) for t in expected]
    other = total(F.when(~F.col("telemetry_source").isin(list(expected)), F.col("n"))).alias("other")
    wide = counts.agg(*known, other)
    rows = [check(f"source {t}", want, F.col(f"`{t}`")) for t, want in expected.items()]
    return shape.rows_of(wide, rows + [check("source other", 0, F.col("other"))])


def gold_audit(gold: DataFrame, machines, slot_count, rows, rows_per_machine, overlap_machines, overlap_rows) -> DataFrame:
    """Post-merge checks 1-6, 8 and 9: counted per machine and per key, then once over those groups."""
    dual = F.col("has_hpe") & F.col("has_dell")
    per = gold.groupBy("machine_name").agg(
        F.count("*").alias("n"), F.count("ping_status").alias("pings"), tally(dual).alias("dual")
    )
    keys = shape.one_row(gold.groupBy(*fixed.KEY).agg(F.count("*").alias("n")), n=F.count("*"))
    ids = shape.one_row(gold.groupBy("observation_id").agg(F.count("*").alias("n")), n=F.count("observation_id"))
    slots_seen = gold.select("monitoring_slot").distinct().agg(F.count("monitoring_slot")).scalar()
    wide = per.agg(
        F.count("machine_name").alias("machines"), F.sum("n").alias("rows"), F.sum("pings").alias("pings"),
        tally(F.col("n") != rows_per_machine).alias("odd"), F.sum("dual").alias("dual"), tally(F.col("dual") > 0).alias("dual_m"),
    )
    c = F.col
    return shape.rows_of(wide, [
        check("1 row count", rows, c("rows")), check("2 machine count", machines, c("machines")),
        check("3 slot count", slot_count, slots_seen),
        check("4 unique observation ids", c("rows"), ids["n"]), check("4 unique composite keys", c("rows"), keys["n"]),
        check("5 machines off the timeline", 0, c("odd")), check("6 lost ping rows", c("rows"), c("pings")),
        check("8 overlap rows", overlap_rows, c("dual")), check("8 overlap machines", overlap_machines, c("dual_m")),
        schema_check("9 gold columns", gold, fixed.GOLD_COLUMNS, exact=True),
    ])


def certificate(gold: DataFrame, sizes: dict, distribution: dict) -> DataFrame:
    """All post-merge checks as one table."""
    return together([gold_audit(gold, **sizes), source_distribution(gold, distribution), null_propagation(gold)])


def source_presence(frames: dict[str, DataFrame]) -> DataFrame:
    """For every machine: is it in the source and with how many rows."""
    counted = together([
        df.groupBy("machine_name").agg(F.count("*").alias("n")).withColumn("source", F.lit(s)) for s, df in frames.items()
    ])
    wide = counted.groupBy("machine_name").agg(*[
        F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(s) for s in frames
    ])
    return shape.rows_of(wide, [
        {"machine_name": F.col("machine_name"), "source": F.lit(s), "found": F.col(s) > 0, "rows": F.col(s)} for s in frames
    ])


def source_states(frames: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """Counts of every state text per machine and source."""
    parts = [
        df.select("machine_name", F.lit(s).alias("source"), F.lit(f).alias("field"), F.col(f).alias("value"))
        for s, df in frames.items() for f in fields if f in df.columns
    ]
    known = together(parts).filter(F.col("value").isNotNull())
    return known.groupBy("machine_name", "source", "field", "value").agg(F.count("*").alias("n"))


def source_problems(frames: dict[str, DataFrame], keep: int = 5) -> DataFrame:
    """First distinct problem texts per machine and source."""
    parts = [
        df.select("machine_name", F.lit(s).alias("source"), F.col("current_problems").alias("problem"))
        for s, df in frames.items() if "current_problems" in df.columns
    ]
    distinct = together(parts).filter(F.col("problem").isNotNull()).distinct()
    order = Window.partitionBy("machine_name", "source").orderBy("problem")
    return distinct.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)


def timeline(df: DataFrame) -> DataFrame:
    """Repeated timestamps, repeated slots and machines with irregular spacing, in one row."""
    time = F.col("event_time")
    key = [F.col("machine_name"), F.col("ip_address")]
    extras = profile.duplicates(df, {"time": key + [time], "slot": key + [profile.slots.shifted_slot(time)]})
    wide = extras.agg(*[
        F.sum(F.when(F.col("key_name") == k, F.col("extra_rows"))).alias(f"duplicate_{k}_rows") for k in ("time", "slot")
    ])
    irregular = profile.irregular_machines(df, "machine_name", "event_time").agg(F.count("*")).scalar()
    short = [profile.wrong_counts(df, "machine_name", "event_time"), profile.wrong_hours(df, "machine_name", "event_time")]
    return wide.select(
        "*", irregular.alias("irregular_machines"), short[0].agg(F.count("*")).scalar().alias("wrong_count_machines"),
        short[1].agg(F.count("*")).scalar().alias("wrong_hours_machines"),
    )
