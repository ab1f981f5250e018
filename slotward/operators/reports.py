"""Fleet reports over the newest rows; a machine name is a filter on any of them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, health, slots
from ..functions.numbers import share, tally
from . import ranking, shape, temporal

DIAGNOSTICS = ["hpe_current_problems", "dell_issues_detected"]


def ping_text() -> Column:
    return F.expr("IF(coalesce(ping_status_binary, 0) = 1, 'Unreachable', 'Reachable')")


def latest_snapshot(stage: DataFrame) -> DataFrame:
    """Newest observation of every machine, states as words, diagnostics only when they say something."""
    newest = temporal.latest_per_machine(stage, [
        "event_time_ping", "monitoring_slot", "ip_address", "telemetry_source", "ping_status_binary",
        *fixed.WORST_COLUMNS, *fixed.COUNT_COLUMNS, *DIAGNOSTICS,
    ])
    return newest.select(
        "machine_name", slots.time_text(F.col("event_time_ping")).alias("event_time"), "monitoring_slot", "ip_address",
        "telemetry_source", ping_text().alias("ping_status"),
        *[health.rank_label(f"hardware_{c}_worst_status").alias(f"{c}_status") for c in fixed.COMPONENTS],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in fixed.COUNT_COLUMNS],
        *[F.when(health.present_text(F.col(c)), F.col(c)).alias(c) for c in DIAGNOSTICS],
    )


def trend(first: Column, last: Column, rows: Column) -> Column:
    return (
        F.when(rows < 2, "INSUFFICIENT_DATA").when(last > first, "INCREASING")
        .when(last < first, "DECREASING").otherwise("STABLE")
    )


def history(master: DataFrame, n: int = 6) -> DataFrame:
    """Last n observations of every machine as an ordered array, with first-to-last trends."""
    entry = F.struct(
        (-F.col("age")).alias("order"), slots.time_text(F.col("event_time_ping")).alias("event_time"),
        F.col("monitoring_slot").alias("slot"), ping_text().alias("ping_status"),
        F.round("ping_timeout_rate_3slot", 3).alias("rate3"), F.round("ping_timeout_rate_6slot", 3).alias("rate6"),
        F.coalesce("problems_active_sum_6slot", F.lit(0)).alias("problems"),
        F.coalesce("critical_component_count", F.lit(0)).alias("critical"),
        F.coalesce("degraded_component_count", F.lit(0)).alias("degraded"),
    )
    rows = temporal.recent_rows(master, n)
    lines = rows.groupBy("machine_name").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))
    first, last, size = F.col("timeline")[0], F.element_at("timeline", -1), F.size("timeline")
    return lines.select(
        "machine_name", size.alias("slots_returned"), "timeline",
        trend(first["rate6"], last["rate6"], size).alias("ping_timeout_trend"),
        trend(first["problems"], last["problems"], size).alias("problem_accumulation_trend"),
    )


def timeline_text(timeline: str = "timeline") -> Column:
    """The timeline array as one text, an observation per `;`."""
    line = lambda x: F.concat_ws(  # noqa: E731 - lambda of a higher-order function
        "|", x["event_time"], x["slot"], x["ping_status"], F.format_string("%.3f", x["rate3"]),
        F.format_string("%.3f", x["rate6"]), x["problems"].cast("string"), x["critical"].cast("string"),
        x["degraded"].cast("string"))
    return F.array_join(F.transform(timeline, line), ";")


def fleet_scores(latest: DataFrame, score: str = "score", offset: Column | None = None,
                 contamination: float = fixed.CONTAMINATION) -> DataFrame:
    """Threshold, flag, percentile, rank and delta for one scored row per machine.

    The flag compares with `offset` (the detector's own cut-off) or, without one, with the fleet
    threshold; both comparisons are strict.
    """
    latest = ranking.pinned(latest)
    counted = latest.groupBy(score).agg(F.count("*").alias("n"))
    upto = ranking.running_totals(counted, [F.col(score)], {"upto": "n"})
    cut = F.lit(ranking.percentiles_of(upto, score, {"cut": 1.0 - contamination})["cut"])
    fleet = F.lit(latest.count())
    ranked = ranking.with_position(latest, [F.desc(F.round(score, 4)), F.col("machine_name")], "fleet_rank")
    return ranked.join(upto.select(score, "upto"), score).select(
        "*", F.round(cut, 6).alias("threshold"), (F.col(score) > (cut if offset is None else offset)).alias("is_anomaly"),
        share(F.col("upto"), fleet, 100).alias("percentile"), F.round(F.col(score) - cut, 6).alias("score_delta"),
        fleet.alias("total_servers"),
    ).drop("upto")


def score_distribution(scored: DataFrame, score: str = "score") -> DataFrame:
    """Spread of the fleet's scores and how many machines are flagged."""
    scored = ranking.pinned(scored)
    median = ranking.exact_percentiles(scored, score, {"median": 0.5})["median"]
    return scored.agg(
        F.count("*").alias("total_servers"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.round(F.avg(score), 6).alias("mean_score"), F.round(F.stddev_pop(score), 6).alias("std_score"),
        tally(F.col("is_anomaly")).alias("total_anomalies"), F.max("threshold").alias("threshold"),
        share(tally(F.col("is_anomaly")), F.count("*"), 100).alias("anomaly_rate_pct"),
    ).withColumn("median_score", F.round(F.lit(median), 6))


def anomaly_reason() -> Column:
    """Why a machine was or was not flagged, from the columns of fleet_scores."""
    distance = (
        F.when(F.col("score_delta") < -0.3, "well below").when(F.col("score_delta") < -0.1, "below").otherwise("near but below")
    )
    flagged = F.format_string(
        "Anomaly score (%.2f) exceeded fleet threshold (%.2f). Server is in the %.1fth percentile, "
        "ranked #%d of %d most anomalous.", "score", "threshold", "percentile", "fleet_rank", "total_servers")
    normal = F.format_string(
        "Anomaly score (%.2f) is %s the fleet threshold (%.2f). Server operates within normal fleet behavior.",
        F.col("score"), distance, F.col("threshold"))
    return F.when(F.col("is_anomaly"), flagged).otherwise(normal)


def classify_anomalies(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "tier": F.when(F.col("is_anomaly"), "ANOMALOUS").otherwise("NORMAL"), "reason": anomaly_reason(),
    })


def risk_columns(probability: str, horizon: str) -> dict[str, Column]:
    """Tier, action and cut-off comparison of a failure probability; 1.0 and above is CRITICAL."""
    policy, p = fixed.RISK_POLICY[horizon], F.col(probability)
    tier, action = F.when(p >= 1.0, "CRITICAL"), F.when(p >= 1.0, policy["tiers"][-1][3])
    for name, low, high, text in policy["tiers"]:
        inside = (p >= low) & (p < high)
        tier, action = tier.when(inside, name), action.when(inside, text)
    calm = policy["tiers"][0]
    return {
        "risk_tier": tier.otherwise(calm[0]), "action": action.otherwise(calm[3]),
        "probability_pct": F.round(p * 100, 1), "exceeds_optimal_f1": p >= policy["optimal_f1"],
        "optimal_f1_threshold": F.lit(policy["optimal_f1"]), "lookahead_window": F.lit(policy["lookahead_window"]),
    }


def composite_risk(scored: DataFrame) -> DataFrame:
    """Join of three verdicts per machine: is_anomaly, tier_12h, tier_24h (with score, p12, p24)."""
    anomalous, t12, t24 = F.col("is_anomaly"), F.col("tier_12h"), F.col("tier_24h")
    raised = lambda t: t.isin("WARNING", "CRITICAL")
    pct = lambda c: F.format_string("%.1f", F.round(F.col(c) * 100, 1))
    signals = health.named_when([
        (anomalous, F.format_string("Isolation Forest: ANOMALOUS (score=%.4f)", "score")),
        (raised(t12), F.concat(F.lit("XGBoost 12h: "), t12, F.lit(" ("), pct("p12"), F.lit("%)"))),
        (raised(t24), F.concat(F.lit("XGBoost 24h: "), t24, F.lit(" ("), pct("p24"), F.lit("%)"))),
    ])
    both = anomalous & (t12 == "CRITICAL")
    critical = (t12 == "CRITICAL") | (t24 == "CRITICAL")
    warning = anomalous | (t12 == "WARNING") | (t24 == "WARNING")
    return scored.withColumns({
        "composite_risk": F.when(both | critical, "CRITICAL").when(warning, "WARNING").otherwise("NORMAL"),
        "contributing_signals": signals,
        "summary": F.when(both, "Server is both anomalous AND predicted to fail within 12 hours. Immediate intervention required.")
        .when(critical, "High failure probability detected. Dispatch SRE remediation ticket.")
        .when(warning, "Elevated risk signals detected. Schedule preventative inspection within 24 hours.")
        .otherwise("All engines report normal operating conditions."),
    })


def top_anomalies(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.filter(F.col("is_anomaly")).orderBy("fleet_rank").limit(n).select(
        "machine_name", "score", "fleet_rank", "percentile", "score_delta")


def top_at_risk(rated: DataFrame, n: int = 5) -> DataFrame:
    """Most probable failures among machines in a raised tier."""
    return rated.filter(F.col("risk_tier").isin("WARNING", "CRITICAL")).orderBy(F.desc("probability_pct"), "machine_name").limit(n).select(
        "machine_name", "probability_pct", "risk_tier")


def _joined(rows: DataFrame, order: list[str], text: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ")).scalar()


def fleet_summary(scored: DataFrame, probability: str = "p12", horizon: str = "3slot") -> DataFrame:
    """One row: tier counts, anomaly counts and the two ranked lists (10 and 5 machines)."""
    scored = ranking.pinned(scored)
    risk = risk_columns(probability, horizon)
    rated = scored.select("machine_name", risk["risk_tier"].alias("risk_tier"), risk["probability_pct"].alias("probability_pct"))
    tiers = rated.agg(
        F.count("*").alias("total_servers"),
        *[tally(F.col("risk_tier") == t.upper()).alias(t) for t in ("normal", "warning", "critical")],
    )
    stats = shape.one_row(scored, n=tally(F.col("is_anomaly")), rows=F.count("*"), cut=F.max("threshold"),
                          low=F.min("score"), high=F.max("score"), mean=F.avg("score"))
    top = top_anomalies(scored)
    risk = top_at_risk(rated).withColumn("order", -F.col("probability_pct"))
    return tiers.select(
        "*", stats["n"].alias("anomalies_detected"), stats["cut"].alias("anomaly_threshold"),
        share(stats["n"], stats["rows"], 100).alias("anomaly_rate_pct"), stats["low"].alias("min_score"),
        stats["high"].alias("max_score"), F.round(stats["mean"], 6).alias("mean_score"),
        _joined(top, ["fleet_rank"], F.col("machine_name")).alias("top_anomalies"),
        _joined(risk, ["order", "machine_name"], F.col("machine_name")).alias("top_at_risk"),
    )


def recent_alerts(master: DataFrame, n: int = 6, keep: int = 20) -> DataFrame:
    """Alerting rows among the last n per machine, with reasons, strongest `keep` shown of the total."""
    rate = F.coalesce("ping_timeout_rate_6slot", F.lit(0.0))
    critical, problems = F.coalesce("critical_component_count", F.lit(0)), F.coalesce("problems_active_sum_6slot", F.lit(0))
    down = F.coalesce("ping_status_binary", F.lit(0)) == 1
    reasons = health.named_when([
        (critical > 0, F.concat(F.lit("Critical hardware: "), critical, F.lit(" component(s)"))),
        (rate > 0.5, F.concat(F.lit("High ping timeout: "), F.format_string("%.0f", rate * 100), F.lit("%"))),
        (problems >= 3, F.concat(F.lit("Sustained problems: "), problems, F.lit(" active over 24h"))),
        (down, F.lit("Server unreachable")),
    ])
    alerts = temporal.recent_rows(master, n).filter((critical > 0) | (rate > 0.5) | (problems >= 3) | down).select(
        "machine_name", slots.time_text(F.col("event_time_ping")).alias("event_time"), F.col("monitoring_slot").alias("slot"),
        F.array_join(reasons, "; ").alias("alert_reasons"), ping_text().alias("ping_status"),
        F.round(rate, 3).alias("ping_timeout_rate_6slot"), critical.alias("critical_components"),
        problems.alias("problems_active_sum_6slot"),
    )
    alerts = ranking.pinned(alerts)  # counted and ranked: the history behind it is walked once
    shown = alerts.orderBy(F.desc("ping_timeout_rate_6slot"), "machine_name", "slot").limit(keep)
    return shown.withColumn("total_alerts", F.lit(alerts.count()))


def first_case_per_category(rows: DataFrame, cases: dict[str, Column], columns: list[str]) -> DataFrame:
    """First row (by observation id) of each case, all cases in one pass."""
    row = F.struct("observation_id", *columns)
    firsts = rows.agg(*[F.min(F.when(test, row)).alias(name) for name, test in cases.items()])
    long = shape.rows_of(firsts, [{"case_type": F.lit(name), "row": F.col(f"`{name}`")} for name in cases])
    return long.filter(F.col("row").isNotNull()).select("case_type", "row.*")


def machine_by_ip(gold: DataFrame) -> DataFrame:
    """Address to machine, the newest observation winning."""
    newest = F.max_by("machine_name", F.struct("event_time_ping", "observation_id")).alias("machine_name")
    return gold.groupBy("ip_address").agg(newest)


def find_by_ip(addresses: DataFrame, gold: DataFrame) -> DataFrame:
    found = addresses.join(machine_by_ip(gold), "ip_address", "left")
    return found.withColumn("found", F.col("machine_name").isNotNull())


def latest_trends(master: DataFrame, n: int) -> DataFrame:
    """First-to-last trend of the timeout rate in the last n rows, without the timeline."""
    rows = temporal.recent_rows(master, n)
    rate = F.round("ping_timeout_rate_6slot", 3)
    return rows.groupBy("machine_name").agg(
        F.count("*").alias("rows"), trend(F.max_by(rate, "age"), F.min_by(rate, "age"), F.count("*")).alias("trend")
    )
