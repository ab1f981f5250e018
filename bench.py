"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries are warmed once and timed as the median of the runs below, results written to the no-op
sink so that every row and column is computed. Model entries time fit and score on a table written
beforehand, like the published numbers they stand next to, and run once.
"""

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

QUERIES = [
    "rpt01_latest_snapshot", "join01_join02_prj03_gold", "agg15_telemetry_source", "scl16_imputed_features",
    "win04_win05_win06_targets", "dq11_to_dq16_gold_audit", "dq23_raw_timeline", "agg03_column_profile",
    "agg05_part_distribution", "agg29_incident_profile", "agg34_session_metrics", "ml01_sort05_mutual_information",
    "ml07_contamination_grid", "ml15_curve_areas", "rpt02_server_history", "rpt03_win11_win12_fleet_scores",
    "rpt12_sort04_recent_alerts",
]


def run(frame):
    frame.write.format("noop").mode("overwrite").save()


def models(spark):
    from pyspark.sql import functions as F

    from slotward.functions import fixed
    from slotward.operators import classifiers, density, isolation, ranking, vectors
    from slotward.plans import models as plans
    from slotward.plans.features import split

    table = plans.model_table(spark, SF_DIR)
    train, test = split(table)
    features = fixed.DETECTOR_FEATURES

    def detector():
        found = plans.collapsed(table)
        scored = ranking.pinned(isolation.score(found, ranking.pinned(isolation.fit(table, features)), features))
        cut = plans.offset_of(scored)
        run(scored.withColumn("flag", F.col("score") > cut))

    def scaled():
        return ranking.pinned(vectors.scaled(ranking.pinned(plans.collapsed(table)), features))

    def classifier(kind):
        model = classifiers.fit(train, "target_failure_3slot", features, kind)
        run(classifiers.predict(model, test))

    return {
        "model_isolation_forest": detector,
        "model_one_class": lambda: run(plans.one_class_flagged(scaled())),
        "model_density_noise": lambda: run(density.noise(scaled(), features)),
        "model_reconstruction": lambda: run(plans.bottleneck_scored(table, plans.collapsed(table))),
        "model_logistic": lambda: classifier("logistic"),
        "model_random_forest": lambda: classifier("forest"),
        "model_boosted_trees": lambda: classifier("boosted"),
    }


def main():
    from slotward.plans import catalog
    from slotward.session import build_session

    spark, times = build_session(CPUS, "slotward-bench"), {}

    def timed(job):
        start = time.perf_counter()
        job()
        return time.perf_counter() - start

    for name in QUERIES:
        build = catalog.QUERIES[name]
        run(build(spark, SF_DIR))
        times[name] = round(statistics.median(timed(lambda: run(build(spark, SF_DIR))) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    for name, job in models(spark).items():
        times[name] = round(timed(job), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total of query medians", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
