"""Gold join, row features, windows, labels and screening."""

from pyspark.sql import functions as F

from ..functions import fixed, health, slots
from ..functions.numbers import tally
from ..operators import gold as gold_ops
from ..operators import neighbours, screening, temporal, transitions
from ..sources import binding
from . import tables
from .registry import query
from .tables_sql import floor_of, rank_case, shifted, slot_of, stamp

C = fixed.COMPONENTS
SPLIT = "2024-01-22 00:00:00"


def stamped(names):
    return ", ".join(f"{stamp(c)} AS {c}" if c.startswith("event_time") else c for c in names)


def with_text_times(df):
    return df.withColumns({c: slots.time_text(F.col(c)) for c in df.columns if c.startswith("event_time")})


@query("prj01_standardize", f"SELECT {stamped(fixed.CANONICAL_COLUMNS['dell'])} FROM dell", "dell")
def _(spark, sf):
    return with_text_times(gold_ops.standardize(binding.raw_export(spark, sf, "dell"), "dell"))


@query("prj02_vendor_names", f"""
SELECT machine_name, ip_address, monitoring_slot, {stamp('event_time')} AS event_time_hpe,
       {', '.join(f'{c} AS hpe_{c}' for c in fixed.EXPORT_COMPONENTS)}, current_problems AS hpe_current_problems FROM hpe""", "hpe")
def _(spark, sf):
    return with_text_times(gold_ops.with_vendor_names(binding.hpe(spark, sf), "hpe"))


@query("join01_join02_prj03_gold", f"SELECT {stamped(fixed.GOLD_COLUMNS)} FROM gold", "gold")
def _(spark, sf):
    return with_text_times(tables.gold(spark, sf))


@query("agg15_telemetry_source", "SELECT telemetry_source, count(*) AS n FROM gold GROUP BY 1", "gold")
def _(spark, sf):
    return tables.gold(spark, sf).groupBy("telemetry_source").agg(F.count("*").alias("n"))


@query("scl02_scl03_scl05_time_parts", f"""
SELECT event_id, {slot_of('event_time')} AS calendar_slot, {stamp(floor_of('event_time'))} AS slot_start,
       {stamp(shifted('event_time'))} AS shifted_slot, strftime(event_time, '%Y-%m-%d') AS event_date,
       hour(event_time) AS event_hour FROM ping_raw""", "ping_raw")
def _(spark, sf):
    t = F.col("event_time")
    return binding.ping_raw(spark, sf).select(
        "event_id", slots.slot_label(t).alias("calendar_slot"), slots.time_text(slots.slot_floor(t)).alias("slot_start"),
        slots.time_text(slots.shifted_slot(t)).alias("shifted_slot"), F.date_format(t, "yyyy-MM-dd").alias("event_date"),
        F.hour(t).cast("bigint").alias("event_hour"),
    )


def _big(names):
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in names)


RANKS = [f"{v}_{c}_rank" for c in C for v in ("hpe", "dell")]


@query("scl06_scl07_severity_codes", f"""
SELECT observation_id, {_big(['ping_status_binary'] + RANKS)} FROM ranked""", "ranked")
def _(spark, sf):
    return tables.stage(spark, sf).select("observation_id", "ping_status_binary", *RANKS)


FLAGS = [f"hardware_{c}_disagreement_flag" for c in C]


@query("scl08_scl09_worst_and_disagreement", f"""
SELECT observation_id, {_big(fixed.WORST_COLUMNS + FLAGS)} FROM worst""", "worst")
def _(spark, sf):
    return tables.stage(spark, sf).select("observation_id", *fixed.WORST_COLUMNS, *FLAGS)


@query("scl10_scl11_counts_and_problem", f"""
SELECT observation_id, {_big(fixed.COUNT_COLUMNS + ['has_active_problem'])} FROM stage""", "stage")
def _(spark, sf):
    return tables.stage(spark, sf).select("observation_id", *fixed.COUNT_COLUMNS, "has_active_problem")


@query("scl12_current_failure", f"""
SELECT observation_id, {_big(['helper_current_failure_state'])} FROM stage""", "stage")
def _(spark, sf):
    return tables.stage(spark, sf).select("observation_id", temporal.failing_now().alias("helper_current_failure_state"))


@query("scl13_scl14_scl15_availability", """
SELECT observation_id, has_ping, has_hpe, has_dell, telemetry_source FROM gold""", "gold")
def _(spark, sf):
    return tables.gold(spark, sf).select("observation_id", "has_ping", "has_hpe", "has_dell", "telemetry_source")


def _imputed_sql(names):
    def one(c):
        if c in fixed.WORST_COLUMNS:
            return f"coalesce(CAST({c} AS DOUBLE), -1.0::DOUBLE)"
        if c in fixed.LAG_COLUMNS:
            return f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE)"
        return f"CAST({c} AS DOUBLE)"
    return [(c, one(c)) for c in names]


@query("scl16_imputed_features", f"""
SELECT observation_id, {', '.join(f'round({e}, 6) AS {c}' for c, e in _imputed_sql(fixed.DETECTOR_FEATURES))} FROM master""", "master")
def _(spark, sf):
    rows = tables.master(spark, sf).select("observation_id", *health.imputed(fixed.DETECTOR_FEATURES))
    return rows.withColumns({c: F.round(c, 6) for c in fixed.DETECTOR_FEATURES})


def label_sql(c):
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.RANK_LABELS.items()) + f" ELSE '{fixed.NO_SENSOR}' END"


@query("scl17_state_labels", f"""
SELECT observation_id, {', '.join(f'{label_sql(w)} AS {c}_label' for c, w in zip(C, fixed.WORST_COLUMNS))} FROM worst""", "worst")
def _(spark, sf):
    labels = [health.rank_label(w).alias(f"{c}_label") for c, w in zip(C, fixed.WORST_COLUMNS)]
    return tables.stage(spark, sf).select("observation_id", *labels)


def joined_sql(parts, glue=","):
    return f"coalesce(concat_ws('{glue}', " + ", ".join(parts) + "), '')"


CRITICAL_NAMES = joined_sql([f"CASE WHEN hardware_{c}_worst_status = 3 THEN '{c}' END" for c in C])


def critical_names():
    return F.array_join(health.named_when([(F.col(f"hardware_{c}_worst_status") == 3, F.lit(c)) for c in C]), ",")


@query("scl18_critical_components", f"""
SELECT observation_id, {CRITICAL_NAMES} AS critical_components FROM counted WHERE critical_component_count > 0""", "counted")
def _(spark, sf):
    rows = tables.stage(spark, sf).filter(F.col("critical_component_count") > 0)
    return rows.select("observation_id", critical_names().alias("critical_components"))


STATE_GOLD = [c for c in fixed.GOLD_COLUMNS if c.startswith(("hpe_", "dell_")) and c.endswith(tuple(C))]
HOLDING = joined_sql([f"CASE WHEN {c} = 'NOT OK' THEN '{c}' END" for c in STATE_GOLD])
OTHERS = joined_sql([f"CASE WHEN {c} NOT IN ('OK', 'NOT OK') THEN '{c}=' || {c} END" for c in STATE_GOLD])


def holding_names(value="NOT OK"):
    return F.array_join(health.named_when([(F.col(c) == value, F.lit(c)) for c in STATE_GOLD]), ",")


def other_states(value="NOT OK"):
    pairs = [(~F.col(c).isin("OK", value), F.concat(F.lit(f"{c}="), F.col(c))) for c in STATE_GOLD]
    return F.array_join(health.named_when(pairs), ",")


@query("scl19_other_states", f"SELECT observation_id, {HOLDING} AS holding, {OTHERS} AS others FROM gold", "gold")
def _(spark, sf):
    return tables.gold(spark, sf).select("observation_id", holding_names().alias("holding"), other_states().alias("others"))


EVIDENCE = joined_sql([f"'{fixed.EVIDENCE_SOURCES['ping']}'", f"CASE WHEN has_dell THEN '{fixed.EVIDENCE_SOURCES['dell']}' END",
                       f"CASE WHEN has_hpe THEN '{fixed.EVIDENCE_SOURCES['hpe']}' END"], ", ")


@query("scl20_evidence_sources", f"SELECT observation_id, {EVIDENCE} AS evidence FROM gold", "gold")
def _(spark, sf):
    return tables.gold(spark, sf).select("observation_id", F.array_join(health.evidence_sources(), ", ").alias("evidence"))


@query("scl21_safe_casts", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 50 = 0 THEN NULL
                 WHEN event_id % 3 = 0 THEN CAST(k AS VARCHAR) || '.75' ELSE CAST(k AS VARCHAR) END AS txt FROM ping_raw)
SELECT event_id, coalesce(CAST(trunc(TRY_CAST(txt AS DOUBLE)) AS BIGINT), 0) AS whole FROM t""", "ping_raw")
def _(spark, sf):
    k = F.col("k").cast("string")
    text = (F.when(F.col("event_id") % 97 == 0, "n/a").when(F.col("event_id") % 50 == 0, F.lit(None).cast("string"))
            .when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".75"))).otherwise(k))
    return binding.ping_raw(spark, sf).select("event_id", health.whole_number(text).alias("whole"))


# --- filters ---------------------------------------------------------------------------------

@query("flt03_rate_thresholds", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {t}::DOUBLE AS threshold, count(*) FILTER (WHERE {c} >= {t}::DOUBLE) AS rows,
    round(100.0 * CAST(count(*) FILTER (WHERE {c} >= {t}::DOUBLE) AS DOUBLE) / count(*), 6) AS pct FROM master"""
    for c in fixed.RATE_COLUMNS for t in screening.RATE_THRESHOLDS), "master")
def _(spark, sf):
    return screening.threshold_counts(tables.master(spark, sf))


@query("flt04_rows_with_sensors", "SELECT observation_id, has_hpe, has_dell FROM gold WHERE has_hpe OR has_dell", "gold")
def _(spark, sf):
    return tables.gold(spark, sf).filter(screening.has_sensors()).select("observation_id", "has_hpe", "has_dell")


ASKED = "2024-01-15_Slot-10"


@query("flt05_row_at_slot", f"""
SELECT machine_name, monitoring_slot, observation_id, telemetry_source FROM gold
QUALIFY row_number() OVER (PARTITION BY machine_name ORDER BY (monitoring_slot = '{ASKED}') DESC, event_time_ping DESC, observation_id DESC) = 1
""", "gold")
def _(spark, sf):
    asked = (F.col("monitoring_slot") == ASKED).cast("int").alias("asked")
    best = F.max(F.struct(asked, "event_time_ping", "observation_id", "monitoring_slot", "telemetry_source")).alias("best")
    return tables.gold(spark, sf).groupBy("machine_name").agg(best).select(
        "machine_name", "best.monitoring_slot", "best.observation_id", "best.telemetry_source")


@query("flt06_present_diagnostics", """
SELECT observation_id, dell_issues_detected FROM gold
WHERE dell_issues_detected IS NOT NULL AND trim(dell_issues_detected) NOT IN ('', 'None', 'nan')""", "gold")
def _(spark, sf):
    rows = tables.gold(spark, sf).filter(health.present_text(F.col("dell_issues_detected")))
    return rows.select("observation_id", "dell_issues_detected")


W = "(PARTITION BY machine_name ORDER BY monitoring_slot, ip_address, event_time_ping, observation_id)"


@query("flt07_win07_known_pairs", f"""
SELECT machine_name, CAST(current AS BIGINT) AS current, CAST(previous AS BIGINT) AS previous FROM (
  SELECT machine_name, hardware_cpu_worst_status AS current, lag(hardware_cpu_worst_status) OVER {W} AS previous FROM worst)
WHERE current IS NOT NULL AND previous IS NOT NULL""", "worst")
def _(spark, sf):
    pairs = transitions.with_previous(tables.stage(spark, sf), "hardware_cpu_worst_status")
    return pairs.dropna(subset=["previous", "current"])


# --- windows and labels ----------------------------------------------------------------------

@query("win01_ping_lags", f"SELECT observation_id, {_big(fixed.LAG_COLUMNS)} FROM master", "master")
def _(spark, sf):
    return tables.master(spark, sf).select("observation_id", *fixed.LAG_COLUMNS)


@query("win02_win03_rolling", """
SELECT observation_id, round(ping_timeout_rate_3slot, 6) AS ping_timeout_rate_3slot,
       round(ping_timeout_rate_6slot, 6) AS ping_timeout_rate_6slot,
       CAST(problems_active_sum_6slot AS BIGINT) AS problems_active_sum_6slot FROM master""", "master")
def _(spark, sf):
    rates = [F.round(c, 6).alias(c) for c in fixed.RATE_COLUMNS]
    return tables.master(spark, sf).select("observation_id", *rates, "problems_active_sum_6slot")


@query("win04_win05_win06_targets", f"SELECT observation_id, {_big(fixed.TARGETS)} FROM master", "master")
def _(spark, sf):
    return tables.master(spark, sf).select("observation_id", *fixed.TARGETS)


# --- transitions -----------------------------------------------------------------------------

@query("agg26_ping_transitions", f"""
SELECT CAST(p AS BIGINT) AS previous, CAST(c AS BIGINT) AS current, count(*) AS n FROM (
  SELECT coalesce(lag(ping_status_binary) OVER {W}, -1) AS p, coalesce(ping_status_binary, -1) AS c FROM ranked) GROUP BY 1, 2""", "ranked")
def _(spark, sf):
    return transitions.transition_counts(tables.stage(spark, sf), "ping_status_binary")


@query("agg26_cpu_transition_matrix", f"""
SELECT CAST(p AS BIGINT) AS previous, {', '.join(f'count(*) FILTER (WHERE c = {s}) AS to_{s}' for s in range(4))} FROM (
  SELECT lag(hardware_cpu_worst_status) OVER {W} AS p, hardware_cpu_worst_status AS c FROM worst)
WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY 1""", "worst")
def _(spark, sf):
    counts = transitions.transition_counts(tables.stage(spark, sf), "hardware_cpu_worst_status", known_only=True)
    return transitions.transition_matrix(counts, [0, 1, 2, 3])


def _volatile_sql(state, known):
    machines = f"count(DISTINCT machine_name) {f'FILTER (WHERE {state} IS NOT NULL)' if known else ''}"
    return f"""SELECT '{state}' AS signal, count(DISTINCT machine_name) FILTER (WHERE {state} <> p) AS volatile,
 {machines} AS machines FROM (SELECT *, lag({state}) OVER {W} AS p FROM worst)"""


@query("agg27_volatile_machines", _volatile_sql("ping_status_binary", False) + " UNION ALL "
       + _volatile_sql("hardware_cpu_worst_status", True), "worst")
def _(spark, sf):
    rows = tables.stage(spark, sf)
    return transitions.volatile_machines(rows, "ping_status_binary").unionByName(
        transitions.volatile_machines(rows, "hardware_cpu_worst_status", known_only=True))


@query("agg28_predecessors", f"""
SELECT CAST(p AS BIGINT) AS previous, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS pct FROM (
  SELECT lag(hardware_cpu_worst_status) OVER {W} AS p, hardware_cpu_worst_status AS c FROM worst)
WHERE p IS NOT NULL AND c = 3 GROUP BY 1""", "worst")
def _(spark, sf):
    return transitions.predecessors(tables.stage(spark, sf), "hardware_cpu_worst_status", 3)


# --- incidents and screening -----------------------------------------------------------------

INCIDENTS = {
    "hardware_critical": "critical_component_count > 0", "network_dropout": "ping_status_binary = 1",
    "chronic_24h": "ping_timeout_rate_6slot = 1.0", "chronic_12h": "ping_timeout_rate_3slot = 1.0",
    "problem_accumulation": "problems_active_sum_6slot >= 3", "current_incident": "helper_current_failure_state = 1",
    "pre_failure_12h": "target_failure_3slot = 1",
}


@query("agg29_incident_profile", " UNION ALL ".join(
    f"""SELECT '{n}' AS incident, count(*) FILTER (WHERE {p}) AS rows, count(DISTINCT machine_name) FILTER (WHERE {p}) AS machines,
    round(100.0 * CAST(count(*) FILTER (WHERE {p}) AS DOUBLE) / count(*), 6) AS pct FROM master""" for n, p in INCIDENTS.items()), "master")
def _(spark, sf):
    return screening.incident_profile(tables.master(spark, sf))


METRICS = {
    "problem sum >= 1": "problems_active_sum_6slot >= 1", "degraded rows": "degraded_component_count > 0",
    "not ok rows": "not_ok_component_count > 0", "critical rows": "critical_component_count > 0",
    "hardware rows": "(has_hpe OR has_dell)",
    **{f"{c} critical": f"(has_hpe OR has_dell) AND hardware_{c}_worst_status = 3" for c in C},
    **{f"{c} not ok": f"(has_hpe OR has_dell) AND hardware_{c}_worst_status = 2" for c in C},
}


@query("agg30_feature_profile", " UNION ALL ".join(
    f"""SELECT '{n}' AS metric, count(*) FILTER (WHERE {p}) AS rows,
    round(100.0 * CAST(count(*) FILTER (WHERE {p}) AS DOUBLE) / count(*), 6) AS pct FROM master""" for n, p in METRICS.items()), "master")
def _(spark, sf):
    return screening.feature_profile(tables.master(spark, sf))


def _means_sql(label, features, floor, base):
    return " UNION ALL ".join(f"""SELECT '{f}' AS feature, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1,
 round(CASE WHEN {base.format('m0')} > {floor} THEN m1 / m0 END, 6) AS lift FROM (
 SELECT avg(CAST({f} AS DOUBLE)) FILTER (WHERE {label} = 0) AS m0, avg(CAST({f} AS DOUBLE)) FILTER (WHERE {label} = 1) AS m1 FROM master)"""
                              for f in features)


@query("agg31_class_means", _means_sql("target_failure_3slot", fixed.LIFT_FEATURES, 0, "{}"), "master")
def _(spark, sf):
    return screening.class_means(tables.master(spark, sf), "target_failure_3slot", fixed.LIFT_FEATURES)


def numeric_flags(rows, features):
    return rows.withColumns({c: F.col(c).cast("int") for c in features if c in fixed.VENDOR_FLAGS + ["has_ping"]})


@query("agg32_sort05_anomaly_drivers", "SELECT * FROM (" + _means_sql("helper_current_failure_state", [f for f in fixed.DETECTOR_FEATURES], 1e-5, "abs({})")
       + ") ORDER BY mean_1 DESC NULLS LAST, feature LIMIT 10", "master")
def _(spark, sf):
    rows = numeric_flags(tables.master(spark, sf), fixed.DETECTOR_FEATURES)
    return screening.anomaly_drivers(rows, "helper_current_failure_state", fixed.DETECTOR_FEATURES)


@query("dq19_constant_features", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(DISTINCT {f}) + CAST(count(*) > count({f}) AS INT) AS values FROM master"
    for f in fixed.CANDIDATE_FEATURES) + ") WHERE values <= 1", "master")
def _(spark, sf):
    return screening.constant_features(tables.master(spark, sf), fixed.CANDIDATE_FEATURES)


@query("dq20_missing_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) - count({f}) AS null_count,
    round(100.0 * CAST(count(*) - count({f}) AS DOUBLE) / count(*), 6) AS null_pct FROM master"""
    for f in fixed.DETECTOR_FEATURES) + ") WHERE null_count > 0", "master")
def _(spark, sf):
    return screening.missing_profile(tables.master(spark, sf), fixed.DETECTOR_FEATURES)


def _mi_sql(label, features):
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round({e}, 6) AS value, {label} AS y, count(*) AS n FROM master WHERE {label} IS NOT NULL GROUP BY ALL"
        for f, e in _imputed_sql(features))
    return f"""
WITH cells AS ({cells}),
t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS s, sum(n) OVER (PARTITION BY feature, value) AS sx,
             sum(n) OVER (PARTITION BY feature, y) AS sy FROM cells)
SELECT feature, round(sum(CAST(n AS DOUBLE) / s * ln(CAST(n AS DOUBLE) * s / (CAST(sx AS DOUBLE) * sy))), 6) AS mi
FROM t GROUP BY feature"""


@query("ml01_sort05_mutual_information", _mi_sql("target_failure_3slot", fixed.DETECTOR_FEATURES), "master")
def _(spark, sf):
    scores = screening.mutual_information(tables.master(spark, sf), "target_failure_3slot", fixed.DETECTOR_FEATURES)
    return scores.orderBy(F.desc("mi"), "feature")


def _digamma_sql(x):
    z = f"({x} + 6.0::DOUBLE)"
    steps = " - ".join(f"1 / ({x} + {j}.0::DOUBLE)" for j in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}**2) + 1 / (120 * {z}**4) - 1 / (252 * {z}**6) - {steps})"


def _neighbour_sql(label, features, k=3):
    """The same estimate by comparing all values of a feature with each other."""
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(round({e} * 1000000) AS BIGINT) AS v, {label} AS y, count(*) AS n FROM master WHERE {label} IS NOT NULL GROUP BY ALL"
        for f, e in _imputed_sql(features))
    share = f"{_digamma_sql('k')} - {_digamma_sql('n_y')} - {_digamma_sql('m')}"
    return f"""
WITH raw AS ({cells}),
c AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY feature, y) AS n_y FROM raw) WHERE n_y > 1),
d AS (SELECT a.feature, a.y, a.v, a.n, a.n_y, least({k}, a.n_y - 1) AS near, abs(b.v - a.v) AS d,
             sum(CASE WHEN a.v = b.v THEN b.n - 1 ELSE b.n END) AS w
      FROM c a JOIN c b ON a.feature = b.feature AND a.y = b.y GROUP BY ALL),
e AS (SELECT *, sum(w) OVER (PARTITION BY feature, y, v ORDER BY d) AS seen FROM d),
r AS (SELECT feature, y, v, n, n_y, near, min(d) AS r FROM e WHERE seen >= near GROUP BY ALL),
m AS (SELECT r.feature, r.y, r.v, r.n, r.n_y, CASE WHEN r.r = 0 THEN r.n - 1 ELSE r.near END AS k,
             sum(CASE WHEN abs(c.v - r.v) < r.r OR c.v = r.v THEN c.n ELSE 0 END) - CASE WHEN r.r = 0 THEN 1 ELSE 0 END AS m
      FROM r JOIN c ON r.feature = c.feature GROUP BY r.feature, r.y, r.v, r.n, r.n_y, r.near, r.r)
SELECT feature, round(greatest({_digamma_sql('sum(n)')} + sum(n * ({share})) / sum(n), 0.0), 6) AS mi FROM m GROUP BY feature"""


@query("ml01_rate_information", _neighbour_sql("target_failure_3slot", fixed.RATE_COLUMNS), "master")
def _(spark, sf):
    """The two rates as continuous columns (ml01_sort05 takes their values as categories)."""
    return neighbours.information(tables.master(spark, sf), "target_failure_3slot", fixed.RATE_COLUMNS)


@query("ml02_standard_scaling", " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, round(avg({e}), 6) AS mean,
    round(CASE WHEN stddev_pop({e}) = 0 THEN 1.0 ELSE stddev_pop({e}) END, 6) AS scale FROM master"""
    for f, e in _imputed_sql(fixed.DETECTOR_FEATURES)), "master")
def _(spark, sf):
    return screening.standard_scaling(tables.master(spark, sf), fixed.DETECTOR_FEATURES)


def split(rows):
    """Rows before and from the out-of-time split."""
    moment = F.to_timestamp(F.lit(SPLIT), fixed.ISO).cast("timestamp_ntz")
    return rows.filter(F.col("event_time_ping") < moment), rows.filter(F.col("event_time_ping") >= moment)


@query("ml09_out_of_time_split", f"""
SELECT CASE WHEN event_time_ping < TIMESTAMP '{SPLIT}' THEN 'train' ELSE 'test' END AS part, count(*) AS rows,
       CAST(coalesce(sum(target_failure_3slot), 0) AS BIGINT) AS positives FROM master GROUP BY 1""", "master")
def _(spark, sf):
    parts = [
        part.agg(F.count("*").alias("rows"), tally(F.col("target_failure_3slot") == 1).alias("positives")).withColumn("part", F.lit(name))
        for name, part in zip(("train", "test"), split(tables.master(spark, sf)))
    ]
    return parts[0].unionByName(parts[1])


def _weights_sql(label):
    return f"""SELECT '{label}' AS label, n AS rows, p AS positives, n - p AS negatives, round(CAST(n AS DOUBLE) / (2 * (n - p)), 6) AS weight_0,
 round(CAST(n AS DOUBLE) / (2 * p), 6) AS weight_1, round(CAST(n - p AS DOUBLE) / greatest(p, 1), 6) AS scale_pos_weight
 FROM (SELECT count(*) AS n, CAST(coalesce(sum({label}), 0) AS BIGINT) AS p FROM master WHERE event_time_ping < TIMESTAMP '{SPLIT}')"""


@query("ml10_class_weights", (_weights_sql("target_failure_3slot") + " UNION ALL " + _weights_sql("target_failure_6slot")), "master")
def _(spark, sf):
    train, _rest = split(tables.master(spark, sf))
    weights = [screening.class_weights(train, t) for t in ("target_failure_3slot", "target_failure_6slot")]
    return weights[0].unionByName(weights[1])
