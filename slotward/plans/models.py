"""Detectors and classifiers. Fitted models have no SQL form; their evaluation does, given scores."""

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, health
from ..operators import attribution, classifiers, density, evaluation, isolation, oneclass, ranking, reconstruction, reports, temporal, vectors
from ..session import folder_state, fresh_path
from . import tables
from .features import SPLIT, _imputed_sql, split
from .registry import query

FEATURES = fixed.DETECTOR_FEATURES
NO_VENDOR = [f for f in FEATURES if f not in fixed.VENDOR_FLAGS]
IDENTITY = ["observation_id", "machine_name", "ip_address", "monitoring_slot", "event_time_ping"]
LABELS = ["target_failure_3slot", "target_failure_6slot", "helper_current_failure_state"]
_FITTED: dict = {}


def model_table(spark, sf):
    """Master columns the models need, written once so that every pass reads columns, not the lineage."""
    return ranking.pinned(tables.master(spark, sf).select(*IDENTITY, *FEATURES, *LABELS))


def remembered(spark, sf, name, build):
    """A model fitted on the present files of the folder, so that queries on one model do not train it again."""
    key, state = (spark.sparkContext.applicationId, sf, name), folder_state(spark, sf)
    if key not in _FITTED or _FITTED[key][0] != state:
        _FITTED[key] = state, build()
    return _FITTED[key][1]


def classifier(spark, sf, kind, label="target_failure_3slot", features=None, rows=None):
    features = features or FEATURES
    name = (kind, label, tuple(features))
    return remembered(spark, sf, name, lambda: classifiers.fit(
        split(rows or tables.master(spark, sf))[0], label, features, kind))


# --- evaluation on scores SQL can reproduce --------------------------------------------------

STANDIN = "round(ping_timeout_rate_6slot + 0.01 * critical_component_count, 6)"
TEST_SQL = f"""test AS (SELECT round({STANDIN} / 1.1, 6) AS p, coalesce(target_failure_3slot, 0) AS y FROM master
 WHERE event_time_ping >= TIMESTAMP '{SPLIT}')"""
CURVE_SQL = f"""{TEST_SQL}, g AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM test GROUP BY p),
t AS (SELECT p, pos, neg, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS fp FROM g)"""


def standin_test(spark, sf):
    _train, test = split(tables.master(spark, sf))
    return test.select(F.expr(f"round({STANDIN} / 1.1, 6)").alias("p"), "target_failure_3slot")


@query("ml15_pr_curve", f"""
WITH {CURVE_SQL}
SELECT round(p, 6) AS threshold, tp, fp, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
       round(tp / CAST(max(tp) OVER () AS DOUBLE), 6) AS recall, round(fp / CAST(max(fp) OVER () AS DOUBLE), 6) AS fpr FROM t""", "master")
def _(spark, sf):
    totals = evaluation.score_totals(standin_test(spark, sf), "target_failure_3slot", "p")
    points = evaluation.curve(totals)
    return points.withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall", "fpr")})


@query("ml15_curve_areas", f"""
WITH {CURVE_SQL}, s AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec, tp - pos AS tp0, fp - neg AS fp0 FROM t)
SELECT round(sum((tp - tp0) * (prec + CASE WHEN tp0 + fp0 > 0 THEN CAST(tp0 AS DOUBLE) / (tp0 + fp0) ELSE 1.0 END) / 2) / max(tp), 6) AS pr_auc,
       round(sum((fp - fp0) * (tp + tp0) / CAST(2 AS DOUBLE)) / (CAST(max(tp) AS DOUBLE) * max(fp)), 6) AS roc_auc FROM s""", "master")
def _(spark, sf):
    return evaluation.areas(evaluation.score_totals(standin_test(spark, sf), "target_failure_3slot", "p"))


@query("ml16_threshold_metrics", f"""
WITH {TEST_SQL}, c AS (SELECT count(*) FILTER (WHERE y = 0 AND p < 0.3) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.3) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < 0.3) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.3) AS tp FROM test)
SELECT *, coalesce(round(100.0 * CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6), 0) AS precision_pct,
  coalesce(round(100.0 * CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6), 0) AS recall_pct,
  coalesce(round(200.0 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1_pct FROM c""", "master")
def _(spark, sf):
    return evaluation.at_threshold(standin_test(spark, sf), "target_failure_3slot", "p", 0.3)


@query("ml17_best_f1_threshold", f"""
WITH {CURVE_SQL}, s AS (SELECT p, CAST(tp AS DOUBLE) / (tp + fp) AS prec, tp / CAST(max(tp) OVER () AS DOUBLE) AS rec FROM t),
f AS (SELECT *, round(2 * prec * rec / (prec + rec + CAST(1e-9 AS DOUBLE)), 12) AS f1 FROM s)
SELECT CASE WHEN f1 > 0 THEN p ELSE 0.5 END AS optimal_threshold, round(f1 * 100, 6) AS optimal_f1_pct,
  round(prec * 100, 6) AS optimal_precision_pct, round(rec * 100, 6) AS optimal_recall_pct FROM f ORDER BY f1 DESC, p LIMIT 1""", "master")
def _(spark, sf):
    return evaluation.best_f1(evaluation.score_totals(standin_test(spark, sf), "target_failure_3slot", "p"))


BASES_SQL = {
    "helper": "helper_current_failure_state = 1", "hw": "critical_component_count > 0", "net": "ping_status_binary = 1",
    "chronic": "ping_timeout_rate_6slot = 1.0", "accum": "problems_active_sum_6slot >= 3", "target": "target_failure_3slot = 1",
}


def _metrics_sql(name, flag, source="m"):
    def pct(part, whole):
        return f"round(100.0 * CAST({part} AS DOUBLE) / nullif({whole}, 0), 6)"

    def both(base):
        return f"count(*) FILTER (WHERE {flag} AND {BASES_SQL[base]})"

    alerts, hits = f"count(*) FILTER (WHERE {flag})", both("helper")
    normal = f"count(*) - count(*) FILTER (WHERE {BASES_SQL['helper']})"
    recalls = ", ".join(f"{pct(both(b), f'count(*) FILTER (WHERE {p})')} AS recall_{b}_pct" for b, p in BASES_SQL.items())
    return f"""SELECT '{name}' AS detector, {alerts} AS alerts, {hits} AS true_positives, {alerts} - {hits} AS false_positives,
 {pct(alerts, 'count(*)')} AS alert_pct, coalesce({pct(hits, alerts)}, 0) AS precision_pct,
 {pct(f'({alerts} - {hits})', f'({normal})')} AS false_positive_rate_pct, {recalls} FROM {source}"""


def collapsed(rows):
    return vectors.collapse(rows, FEATURES, vectors.baselines())


def grid_flags(scored, score="score"):
    """Strict score cuts of the contamination grid from one set of scores."""
    cuts = ranking.exact_percentiles(scored, score, {f"c{i}": 1 - c for i, c in enumerate(fixed.CONTAMINATION_GRID)}, "n")
    return {f"c={c}": F.col(score) > cuts[f"c{i}"] for i, c in enumerate(fixed.CONTAMINATION_GRID)}


@query("ml07_contamination_grid", f"WITH m AS (SELECT *, {STANDIN} AS score FROM master), cuts AS (SELECT "
       + ", ".join(f"quantile_cont(score, {1 - c}) AS c{i}" for i, c in enumerate(fixed.CONTAMINATION_GRID)) + " FROM m) "
       + " UNION ALL ".join(_metrics_sql(f"c={c}", f"(score > (SELECT c{i} FROM cuts))") for i, c in enumerate(fixed.CONTAMINATION_GRID)), "master")
def _(spark, sf):
    scored = ranking.pinned(collapsed(tables.master(spark, sf)).withColumn("score", F.expr(STANDIN)))
    return evaluation.detector_metrics(scored, grid_flags(scored))


STANDIN_FLAGS = {"timeout rate": "ping_timeout_rate_6slot >= 0.5", "problem sum": "problems_active_sum_6slot >= 5",
                 "critical": "critical_component_count > 0"}


@query("ml08_detector_comparison", "WITH m AS (SELECT * FROM master) "
       + " UNION ALL ".join(_metrics_sql(n, f"({f})") for n, f in STANDIN_FLAGS.items()), "master")
def _(spark, sf):
    flags = {n: F.expr(f) for n, f in STANDIN_FLAGS.items()}
    return evaluation.detector_metrics(collapsed(tables.master(spark, sf)), flags)


# --- fitted detectors ------------------------------------------------------------------------

def forest(spark, sf, rows):
    def build():
        nodes = isolation.fit(rows, FEATURES)
        return ranking.pinned(nodes)

    return remembered(spark, sf, "isolation", build)


def forest_vectors(spark, sf):
    rows = model_table(spark, sf)
    found = collapsed(rows)
    return ranking.pinned(isolation.score(found, forest(spark, sf, rows), FEATURES))


def offset_of(scored, score="score", contamination=fixed.CONTAMINATION):
    return ranking.exact_percentiles(scored, score, {"cut": 1 - contamination}, "n")["cut"]


@query("ml03_isolation_scores")
def _(spark, sf):
    rows = model_table(spark, sf)
    nodes = forest(spark, sf, rows)
    scored = forest_vectors(spark, sf)
    cut = offset_of(scored)
    each = rows.select("observation_id", "machine_name", *health.imputed(FEATURES, fill_rest=True))
    flagged = isolation.score(each, nodes, FEATURES)
    return flagged.select("observation_id", "machine_name", "score", (F.col("score") > cut).alias("is_anomaly"))


@query("ml07_forest_grid")
def _(spark, sf):
    scored = forest_vectors(spark, sf)
    return evaluation.detector_metrics(scored, grid_flags(scored))


@query("ml03_sort06_case_studies")
def _(spark, sf):
    rows = model_table(spark, sf)
    cut = offset_of(forest_vectors(spark, sf))
    filled = rows.select("observation_id", "machine_name", "monitoring_slot", "helper_current_failure_state",
                         *health.imputed(FEATURES, fill_rest=True))
    flagged = isolation.score(filled, forest(spark, sf, rows), FEATURES).filter(F.col("score") > cut)
    cases = {"physical fault": "critical_component_count > 0",
             "chronic outage": "ping_timeout_rate_6slot = 1.0 AND critical_component_count = 0",
             "early warning": "problems_active_sum_6slot >= 3 AND helper_current_failure_state = 0"}
    return reports.first_case_per_category(
        flagged, {n: F.expr(p) for n, p in cases.items()}, ["machine_name", "monitoring_slot", "score", "problems_active_sum_6slot"])


def standardized(spark, sf):
    found = ranking.pinned(collapsed(model_table(spark, sf)))
    return ranking.pinned(vectors.scaled(found, FEATURES))


def one_class_flagged(scaled):
    decided = ranking.pinned(oneclass.OneClass(FEATURES).fit(scaled).decide(scaled))
    return decided.withColumn("one_class", F.col("decision") < 0)


@query("ml04_one_class_svm")
def _(spark, sf):
    flagged = one_class_flagged(standardized(spark, sf))
    return flagged.groupBy("one_class").agg(
        F.count("*").alias("vectors"), F.sum("n").alias("rows"), F.sum("helper").alias("incidents"),
        F.round(F.avg("decision"), 6).alias("mean_decision"))


def _density_sql():
    scaled = ", ".join(
        f"(v.{f} - s.{f}_m) / CASE WHEN s.{f}_s < 1e-6 THEN 1.0 ELSE s.{f}_s END AS {f}" for f in FEATURES)
    stats = ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in FEATURES)
    cols = ", ".join(f"{e} AS {f}" for f, e in _imputed_sql(FEATURES))
    distance = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
    eps2 = fixed.DENSITY_EPS ** 2
    return f"""
WITH x AS MATERIALIZED (SELECT {cols}, helper_current_failure_state AS helper FROM master),
g AS (SELECT {', '.join(FEATURES)}, count(*) AS n, sum(helper) AS h FROM x GROUP BY ALL),
v AS (SELECT row_number() OVER () AS vid, * FROM g), s AS (SELECT {stats} FROM x),
z AS MATERIALIZED (SELECT vid, n, h, {scaled} FROM v, s),
core AS MATERIALIZED (SELECT a.vid FROM z a JOIN z b ON {distance} <= {eps2} GROUP BY a.vid HAVING sum(b.n) >= {fixed.DENSITY_MIN_ROWS}),
cz AS MATERIALIZED (SELECT z.* FROM z JOIN core USING (vid)),
near AS (SELECT DISTINCT a.vid FROM z a JOIN cz b ON {distance} <= {eps2})
SELECT vid NOT IN (SELECT vid FROM near) AS is_noise, count(*) AS vectors, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(h) AS BIGINT) AS incidents
FROM z GROUP BY 1"""


@query("ml05_density_noise", _density_sql(), "master")
def _(spark, sf):
    flagged = density.noise(standardized(spark, sf), FEATURES)
    return flagged.groupBy("is_noise").agg(
        F.count("*").alias("vectors"), F.sum("n").alias("rows"), F.sum("helper").alias("incidents"))


def bottleneck_scored(rows, found):
    model = reconstruction.Bottleneck(FEATURES).fit(rows)
    return ranking.pinned(model.error(found))


@query("ml06_reconstruction_error")
def _(spark, sf):
    rows = model_table(spark, sf)
    scored = bottleneck_scored(rows, collapsed(rows))
    cut = ranking.exact_percentiles(scored, "mse", {"cut": 1 - fixed.CONTAMINATION}, "n")["cut"]
    flagged = scored.withColumn("is_anomaly", F.col("mse") >= cut)
    return flagged.groupBy("is_anomaly").agg(
        F.count("*").alias("vectors"), F.sum("n").alias("rows"), F.sum("helper").alias("incidents"), F.round(F.avg("mse"), 6).alias("mean_mse"))


@query("ml08_fitted_detectors")
def _(spark, sf):
    """All four detectors on the same vectors; every flag is a function of the vector."""
    rows = model_table(spark, sf)
    found = ranking.pinned(collapsed(rows))
    scored = isolation.score(found, forest(spark, sf, rows), FEATURES)
    scored = bottleneck_scored(rows, scored)
    scaled = vectors.scaled(scored, FEATURES)
    flagged = ranking.pinned(one_class_flagged(ranking.pinned(scaled)))
    noisy = ranking.pinned(density.noise(flagged, FEATURES))
    cuts = ranking.exact_percentiles(noisy, "score", {"cut": 1 - fixed.CONTAMINATION}, "n")["cut"]
    mse = ranking.exact_percentiles(noisy, "mse", {"cut": 1 - fixed.CONTAMINATION}, "n")["cut"]
    return evaluation.detector_metrics(noisy, {
        "Isolation Forest": F.col("score") > cuts, "One-Class SVM": F.col("one_class"),
        "DBSCAN": F.col("is_noise"), "AutoEncoder": F.col("mse") >= mse,
    })


# --- classifiers -----------------------------------------------------------------------------

def tested(spark, sf, rows, kind, label="target_failure_3slot", features=None):
    model = classifier(spark, sf, kind, label, features, rows)
    _train, test = split(rows)
    keep = ["observation_id", "machine_name", label]
    return classifiers.predict(model, test).select(*keep, "probability_of_failure")


def evaluated(spark, sf, rows, name, kind, label="target_failure_3slot", features=None):
    scored = ranking.pinned(tested(spark, sf, rows, kind, label, features))
    return evaluation.report(scored, label, "probability_of_failure", name)


TARGETS = ["target_failure_3slot", "target_failure_6slot"]  # 12 h and 24 h
WITHOUT_VENDOR = "Boosted Trees (No Vendor Flags)"


def both_targets(spark, sf, models):
    """Evaluations of the (name, kind, features) models for both look-ahead labels.

    A tree learner is a chain of short jobs that leaves executors idle, so the models are fitted side by side.
    """
    rows = model_table(spark, sf)
    with ThreadPoolExecutor(len(TARGETS) * len(models)) as pool:
        list(pool.map(lambda m: classifier(spark, sf, *m, rows=rows), [(k, label, f) for label in TARGETS for _n, k, f in models]))
    parts = [evaluated(spark, sf, rows, n, k, label, f).withColumn("target", F.lit(label)) for label in TARGETS for n, k, f in models]
    return functools.reduce(DataFrame.unionByName, parts)


@query("ml11_logistic_regression")
def _(spark, sf):
    return both_targets(spark, sf, [("Logistic Regression", "logistic", None)])


@query("ml12_random_forest")
def _(spark, sf):
    return both_targets(spark, sf, [("Random Forest", "forest", None)])


@query("ml13_boosted_trees")
def _(spark, sf):
    return both_targets(spark, sf, [("Boosted Trees", "boosted", None)])


@query("ml14_vendor_ablation")
def _(spark, sf):
    """The boosted trees with and without the vendor flags, and the difference, for both labels."""
    both = both_targets(spark, sf, [("Boosted Trees", "boosted", None), (WITHOUT_VENDOR, "boosted", NO_VENDOR)])  # one row per model; a frame with scalar subqueries cannot be checkpointed
    of = lambda c, cut: F.max(F.when((F.col("model") == WITHOUT_VENDOR) == F.lit(cut), F.col(c)))
    names = [c for c in both.columns if c not in ("model", "target")]
    delta = both.groupBy("target").agg(*[(of(c, True) - of(c, False)).alias(c) for c in names]).withColumn("model", F.lit("difference"))
    return both.unionByName(delta)


@query("ml18_model_comparison")
def _(spark, sf):
    return both_targets(spark, sf, [("Logistic Regression", "logistic", None), ("Random Forest", "forest", None),
                                    ("Boosted Trees", "boosted", None), (WITHOUT_VENDOR, "boosted", NO_VENDOR)])


def served(spark, sf, horizon, rows):
    return classifier(spark, sf, "boosted", f"target_failure_{horizon}", fixed.CLASSIFIER_FEATURES, rows)


def _compared(again, name):
    """Rows, changed scores and the largest score of a reloaded model."""
    return again.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("before") != F.col("after"), 1)).alias("changed"),
        F.round(F.max("after"), 6).alias("max_score")).select(F.lit(name).alias("model"), "*")


def saved_classifier(spark, sf, horizon):
    """Train for production, write with its metadata, read back and compare the scores."""
    rows, folder = model_table(spark, sf), fresh_path(spark, "models")
    model = served(spark, sf, horizon, rows)
    scored = ranking.pinned(classifiers.predict(model, split(rows)[1], "before"))
    best = evaluation.best_f1(evaluation.score_totals(scored, f"target_failure_{horizon}", "before"))
    classifiers.save(model, f"{folder}/boosted_{horizon}")
    classifiers.save_metadata(spark, f"{folder}/metadata", {horizon: round(best.first()["optimal_threshold"], 3)})
    again = classifiers.predict(classifiers.load(f"{folder}/boosted_{horizon}"), scored, "after")
    return _compared(again.withColumn("n", F.lit(1)), f"boosted_{horizon}")


@query("ml22_ml23_saved_detector")
def _(spark, sf):
    rows, path = model_table(spark, sf), fresh_path(spark, "models")
    nodes = forest(spark, sf, rows)
    nodes.write.mode("overwrite").parquet(f"{path}/isolation_forest")
    before = isolation.score(collapsed(rows), nodes, FEATURES, name="before")
    after = isolation.score(before, spark.read.parquet(f"{path}/isolation_forest"), FEATURES, name="after")
    return _compared(after, "isolation_forest")


@query("ml22_ml23_saved_classifier_12h")
def _(spark, sf):
    return saved_classifier(spark, sf, "3slot")


@query("ml22_ml23_saved_classifier_24h")
def _(spark, sf):
    return saved_classifier(spark, sf, "6slot")


# --- explanations ----------------------------------------------------------------------------

@query("ml19_tree_contributions")
def _(spark, sf):
    """Contributions of every out-of-time row of the served 12 h model; base plus sum is its log-odds."""
    features = fixed.CLASSIFIER_FEATURES
    rows = model_table(spark, sf)
    model = served(spark, sf, "3slot", rows)
    test = classifiers.predict(model, split(rows)[1])
    explained = attribution.explain(test, model, features)
    total = F.aggregate("contributions", F.col("base_value"), lambda s, x: s + x)
    p = F.col("probability_of_failure")
    gap = F.abs(1 / (1 + F.exp(-total)) - p)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["feature"], F.lit(":"), x["contribution"].cast("string"))), ", ")
    return attribution.drivers(explained, features).select(
        "observation_id", p, F.round("base_value", 4).alias("base_value"), F.round(gap, 6).alias("probability_gap"),
        text("top_drivers").alias("top_drivers"), text("positive_drivers").alias("positive_drivers"), text("protective_factors").alias("protective_factors"))


@query("ml20_global_importance")
def _(spark, sf):
    """Mean absolute contribution over the whole out-of-time set, equal vectors explained once."""
    rows = model_table(spark, sf)
    model = classifier(spark, sf, "boosted", features=NO_VENDOR, rows=rows)
    found = vectors.collapse(split(rows)[1], NO_VENDOR)
    return attribution.global_importance(attribution.explain(found, model, NO_VENDOR), NO_VENDOR)


@query("ml21_case_studies")
def _(spark, sf):
    rows = model_table(spark, sf)
    model = classifier(spark, sf, "boosted", features=NO_VENDOR, rows=rows)
    hits = classifiers.predict(model, split(rows)[1]).filter(
        (F.col("target_failure_3slot") == 1) & (F.col("probability_of_failure") >= 0.5))
    first = hits.orderBy("observation_id").limit(2)
    cases = attribution.case_studies(attribution.explain(first, model, NO_VENDOR), NO_VENDOR, "target_failure_3slot", "probability_of_failure")
    text = F.transform("positive_drivers", lambda x: F.concat(x["feature"], F.lit("="), x["contribution"].cast("string")))
    return cases.withColumn("positive_drivers", F.array_join(text, ", "))


# --- reports on fitted models ----------------------------------------------------------------

def newest(rows):
    return temporal.latest_per_machine(rows)


def fleet_detected(spark, sf, rows):
    """Fleet scores of the fitted detector: the flag uses its own cut-off, the threshold is the fleet's."""
    cut = offset_of(forest_vectors(spark, sf))
    last = newest(rows)
    filled = last.select("machine_name", *health.imputed(FEATURES, fill_rest=True))
    scored = isolation.score(filled, forest(spark, sf, rows), FEATURES)
    relative = scored.withColumn("score", F.round(F.col("score") - cut, 9))
    return reports.classify_anomalies(reports.fleet_scores(relative, offset=F.lit(0.0)))


REPORTED = ["machine_name", "score", "threshold", "is_anomaly", "percentile", "fleet_rank", "score_delta", "total_servers", "tier", "reason"]


@query("rpt03_fitted_fleet_scores")
def _(spark, sf):
    return fleet_detected(spark, sf, model_table(spark, sf)).select(*REPORTED)


def feature_map(features):
    """Human-readable model inputs (SCL-22): states as words, numbers to four digits."""
    def shown(f):
        if f in fixed.WORST_COLUMNS:
            return health.rank_label(f)
        return F.round(F.col(f), 4).cast("string")

    return F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[shown(f) for f in features]))


@query("rpt06_scl22_anomaly_explanation")
def _(spark, sf):
    rows = model_table(spark, sf)
    scored = fleet_detected(spark, sf, rows)
    signals = scored.withColumn("signals", feature_map(FEATURES)).withColumns({v: F.col(v) == 1 for v in fixed.VENDOR_FLAGS})
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return signals.select(
        "machine_name", "score", "threshold", "fleet_rank", "percentile", F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL").alias("decision"),
        "reason", listed.alias("key_observed_signals"), F.array_join(health.evidence_sources(), ", ").alias("evidence_sources"))


def predicted(spark, sf, rows):
    """Latest row per machine with both horizons' probabilities as p12 and p24."""
    last = newest(rows)
    for horizon, name in (("3slot", "p12"), ("6slot", "p24")):
        last = classifiers.predict(served(spark, sf, horizon, rows), last, name)
    return last


@query("rpt07_failure_probability")
def _(spark, sf):
    rated = predicted(spark, sf, model_table(spark, sf))
    tiers = {f"tier_{n}": reports.risk_columns(p, h)["risk_tier"] for n, p, h in [("12h", "p12", "3slot"), ("24h", "p24", "6slot")]}
    return rated.withColumns(tiers).select("machine_name", F.round("p12", 4).alias("p12"), F.round("p24", 4).alias("p24"), "tier_12h", "tier_24h")


@query("rpt09_prediction_explanation")
def _(spark, sf):
    features, rows = fixed.CLASSIFIER_FEATURES, model_table(spark, sf)
    model = served(spark, sf, "3slot", rows)
    last = classifiers.predict(model, newest(rows), "p12")
    explained = attribution.drivers(attribution.explain(last, model, features), features)
    named = lambda c, k: F.array_join(F.slice(F.transform(c, lambda x: x["feature"]), 1, k), ", ")
    risk = reports.risk_columns("p12", "3slot")
    return explained.select(
        "machine_name", risk["probability_pct"].alias("probability_pct"), risk["risk_tier"].alias("risk_tier"),
        F.round("base_value", 4).alias("base_value"), named("top_drivers", 6).alias("top_drivers"),
        named("positive_drivers", 4).alias("positive_drivers"), named("protective_factors", 3).alias("protective_factors"),
        F.array_join(attribution.sensor_notes(), " ").alias("operational_sensor_notes"))


@query("rpt11_fitted_fleet_summary")
def _(spark, sf):
    rows = model_table(spark, sf)
    probabilities = predicted(spark, sf, rows).select("machine_name", "p12", "p24")
    return reports.fleet_summary(fleet_detected(spark, sf, rows).join(probabilities, "machine_name"))
