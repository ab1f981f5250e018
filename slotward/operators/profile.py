"""Table, column, key and time-line profiles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, slots
from ..functions.numbers import share, tally, total
from . import ranking, shape


def overview(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table_name"), "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def column_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (column_name, value, n): every distinct value of every column, counted once."""
    names = columns or df.columns
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    return texts.unpivot([], names, "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def smallest_values(counted: DataFrame, k: int) -> DataFrame:
    """The k smallest values of each column joined into one text."""
    order = Window.partitionBy("column_name").orderBy("value")
    picked = (
        counted.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
    joined = F.array_join(F.array_sort(F.collect_list("value")), ", ")
    return picked.groupBy("column_name").agg(joined.alias("sample_values"))


def column_profile(df: DataFrame, samples: int = 8, columns: list[str] | None = None) -> DataFrame:
    """Type, missing and distinct counts and smallest sample values, one row per column."""
    counted = column_values(df, columns)
    missing = total(F.when(F.col("value").isNull(), F.col("n")))
    stats = counted.groupBy("column_name").agg(
        missing.alias("missing_count"),
        share(missing, F.sum("n"), 100).alias("missing_pct"),
        F.count("value").alias("unique_count"),
    )
    joined = stats.join(smallest_values(counted, samples), "column_name", "left")
    kinds = [F.when(F.col("column_name") == c, t) for c, t in df.dtypes]
    return joined.withColumn("data_type", F.coalesce(*kinds))


def column_role(name: Column) -> tuple[Column, Column]:
    role = (
        F.when(name.isin(fixed.IDENTIFIER_COLUMNS), "Identifier")
        .when(name.isin(fixed.TIME_COLUMNS), "Time")
        .when(name.isin(fixed.STATE_COLUMNS), "Categorical feature")
        .when(name.isin(fixed.TEXT_COLUMNS), "Text feature")
        .otherwise("Review")
    )
    keep = F.coalesce(*[F.when(role == r, d) for r, d in fixed.ROLE_DECISIONS.items()])
    return role, keep


def value_distribution(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent values with their share; nulls are a value of their own."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    whole = shape.one_row(
        counted, rows=F.sum("n"), distinct=F.count("*"), nulls=total(F.when(F.col("value").isNull(), F.col("n")))
    )
    top_rows = counted.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)
    return top_rows.select(
        F.lit(column).alias("column_name"), "value", "n",
        share(F.col("n"), whole["rows"], 100).alias("pct"),
        whole["rows"].alias("total_rows"),
        whole["distinct"].alias("unique_values"),
        whole["nulls"].alias("null_count"),
    )


def feature_distribution(df: DataFrame, features: list[str]) -> DataFrame:
    """Counts and shares of every value of every feature; shares under 0.01 % are marked."""
    counted = column_values(df, features)
    pct = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("column_name"))
    return counted.select(
        F.col("column_name").alias("feature"), "value", "n",
        F.round(pct, 6).alias("pct"),
        F.when((pct > 0) & (pct < 0.01), "<0.01%").otherwise("").alias("mark"),
    )


def mapping_check(df: DataFrame, left: str, right: str, examples: int = 5) -> DataFrame:
    """Is left <-> right one-to-one? Distinct partners are counted both ways."""
    pairs = df.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).distinct()
    by_left = pairs.filter(F.col("l").isNotNull()).groupBy("l").agg(F.count("r").alias("partners"))
    by_right = pairs.filter(F.col("r").isNotNull()).groupBy("r").agg(F.count("l").alias("partners"))
    many = F.col("partners") > 1
    first = by_left.filter(many).orderBy("l").limit(examples)
    shown = first.agg(F.array_join(F.array_sort(F.collect_list(F.concat("l", F.lit(":"), "partners"))), ", "))
    right_side = shape.one_row(by_right, n=F.count("*"), many=tally(many))
    counts = by_left.agg(F.count("*").alias("unique_left"), tally(many).alias("left_with_many"))
    return counts.select(
        "unique_left", right_side["n"].alias("unique_right"), "left_with_many",
        right_side["many"].alias("right_with_many"),
        F.when((F.col("left_with_many") == 0) & (right_side["many"] == 0), "one-to-one")
        .otherwise("one-to-many").alias("mapping_type"),
        shown.scalar().alias("examples"),
    )


def time_range(df: DataFrame, text: str, order: str, day_first: bool = True) -> DataFrame:
    parsed = df.select(slots.parse_time(F.col(text), day_first).alias("t"), F.col(order).alias("o"))
    first = parsed.filter(F.col("t").isNotNull()).orderBy("o").limit(3)
    sample = first.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("o", slots.time_text(F.col("t")).alias("s")))), lambda x: x["s"]), ", "))
    return parsed.agg(
        slots.time_text(F.min("t")).alias("start_time"),
        slots.time_text(F.max("t")).alias("end_time"),
        F.round(slots.hours_between(F.max("t"), F.min("t")) / 24, 6).alias("duration_days"),
        F.countDistinct(F.to_date("t")).alias("unique_dates"),
        tally(F.col("t").isNull()).alias("invalid_timestamps"),
    ).withColumn("sample_timestamps", sample.scalar())


def day_month_order(df: DataFrame, text: str) -> DataFrame:
    """Which reading of ambiguous dates fits a month-long export with fewer unreadable values."""

    def score(t: Column) -> Column:
        duration = slots.hours_between(F.max(t), F.min(t)) / 24
        value = tally(t.isNull()) * 1000 + F.abs(duration - 30)
        return F.coalesce(value, F.lit(float("inf")))

    both = df.select(
        slots.parse_time(F.col(text), True).alias("dmy"), slots.parse_time(F.col(text), False).alias("mdy")
    )
    scored = both.agg(
        score(F.col("dmy")).alias("dmy_score"), score(F.col("mdy")).alias("mdy_score"),
        tally(F.col("dmy").isNull()).alias("dmy_invalid"), tally(F.col("mdy").isNull()).alias("mdy_invalid"),
    )
    chosen = F.when(F.col("dmy_score") <= F.col("mdy_score"), "day/month/year").otherwise("month/day/year")
    return scored.select(
        F.round("dmy_score", 6).alias("dmy_score"), F.round("mdy_score", 6).alias("mdy_score"),
        "dmy_invalid", "mdy_invalid", chosen.alias("selected_format"),
    )


def _spread(counts: DataFrame, prefix: str) -> DataFrame:
    """min / max / median of column n through its distinct sizes, few even for many groups."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("groups"))
    return sizes.agg(
        F.min("n").alias(f"{prefix}_min"), F.max("n").alias(f"{prefix}_max"),
        F.percentile("n", 0.5, F.col("groups")).alias(f"{prefix}_median"),
    )


def monitoring_frequency(df: DataFrame, machine: str, time: str) -> DataFrame:
    """Observations per machine and the slot grid they fall on."""
    cells = df.groupBy(F.col(machine).alias("m"), slots.shifted_slot(F.col(time)).alias("slot")).agg(F.count("*").alias("n"))
    grid = shape.one_row(
        cells.groupBy("slot").agg(F.count("*").alias("c")).filter(F.col("slot").isNotNull()),
        slots=F.count("*"), hours=F.array_sort(F.collect_set(F.hour("slot"))),
    )
    spread = _spread(cells.groupBy("m").agg(F.sum("n").alias("n")), "obs_per_machine")
    return spread.select(
        grid["slots"].alias("unique_slots"),
        F.array_join(grid["hours"].cast("array<string>"), ",").alias("slot_hours"),
        F.size(grid["hours"]).alias("slots_per_day"),
        "obs_per_machine_min", "obs_per_machine_max", "obs_per_machine_median",
        (F.col("obs_per_machine_min") == F.col("obs_per_machine_max")).alias("all_equal"),
    )


def daily_frequency(df: DataFrame, machine: str, time: str) -> DataFrame:
    """Observations per machine and day, and the raw hours seen."""
    days = df.groupBy(F.col(machine).alias("m"), F.to_date(time).alias("d")).agg(F.count("*").alias("n"))
    hours = df.agg(F.array_join(F.array_sort(F.collect_set(F.hour(time))).cast("array<string>"), ",")).scalar()
    return _spread(days, "obs_per_day").withColumn("raw_hours", hours)


def rows_per_slot_hour(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.hour(slots.shifted_slot(F.col(time))).alias("slot_hour")).agg(F.count("*").alias("n"))


def wrong_counts(df: DataFrame, machine: str, time: str) -> DataFrame:
    """Machines whose row count is not days * slots per day."""
    days = df.agg(F.countDistinct(F.to_date(time))).scalar()
    counts = df.groupBy(F.col(machine).alias("machine_name")).agg(F.count("*").alias("observations"))
    expected = days * fixed.SLOTS_PER_DAY
    return counts.filter(F.col("observations") != expected).withColumn("expected", expected)


def wrong_hours(df: DataFrame, machine: str, time: str) -> DataFrame:
    """Machines whose set of slot hours is not the full daily schedule."""
    hour = F.hour(slots.shifted_slot(F.col(time)))
    seen = df.groupBy(F.col(machine).alias("machine_name")).agg(F.array_sort(F.collect_set(hour)).alias("hours"))
    full = F.array(*[F.lit(h) for h in fixed.SLOT_HOURS])
    return seen.filter(F.col("hours") != full).select(
        "machine_name", F.array_join(F.col("hours").cast("array<string>"), ",").alias("slot_hours")
    )


def duplicates(df: DataFrame, keys: dict[str, list[Column]]) -> DataFrame:
    """Per key: rows beyond the first, and all rows of repeated keys."""
    parts = []
    for name, columns in keys.items():
        groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
        parts.append(groups.agg(
            total(F.col("n") - 1).alias("extra_rows"), total(F.when(F.col("n") > 1, F.col("n"))).alias("member_rows")
        ).withColumn("key_name", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slot_intervals(df: DataFrame, machine: str, time: str) -> DataFrame:
    """Distinct hours between consecutive observations, per machine.

    Rows of the same slot are counted first: they contribute the interval 0, and the windows then
    run over distinct slots, so a machine with many raw rows still has a short series.
    """
    cells = df.groupBy(F.col(machine).alias("machine_name"), slots.shifted_slot(F.col(time)).alias("slot")).agg(
        F.count("*").alias("n")
    )
    series = Window.partitionBy("machine_name").orderBy("slot")
    gap = slots.hours_between(F.col("slot"), F.lag("slot").over(series))
    gaps = cells.filter(F.col("slot").isNotNull()).select("machine_name", "n", gap.alias("gap"))
    hours = F.collect_set("gap")
    repeated = F.max(F.when(F.col("n") > 1, 1).otherwise(0)) == 1
    with_zero = F.when(repeated, F.array_union(F.array(F.lit(0.0)), hours)).otherwise(hours)
    found = gaps.groupBy("machine_name").agg(F.array_sort(with_zero).alias("hours"))
    everyone = cells.groupBy("machine_name").agg(F.lit(1).alias("seen")).select("machine_name")
    return everyone.join(found, "machine_name", "left").withColumn(
        "hours", F.coalesce("hours", F.array().cast("array<double>"))
    )


def irregular_machines(df: DataFrame, machine: str, time: str) -> DataFrame:
    spaced = slot_intervals(df, machine, time)
    return spaced.filter(F.col("hours") != F.array(F.lit(4.0)))


def freshness(df: DataFrame, time: str, as_of: str) -> DataFrame:
    """Age of the newest row at a given moment, with the staleness warning."""
    moment = F.to_timestamp(F.lit(as_of), fixed.ISO).cast("timestamp_ntz")
    age = F.round(slots.hours_between(moment, F.max(time)), 1)
    aged = df.agg(age.alias("data_age_hours"))
    stale = F.col("data_age_hours") > fixed.STALE_AFTER_HOURS
    text = F.concat(F.lit("Dataset is "), F.round("data_age_hours", 0).cast("bigint").cast("string"),
                    F.lit(" hours old (threshold: 8.0h). Results may not reflect current state."))
    return aged.select("data_age_hours", stale.alias("is_stale"), F.when(stale, text).alias("message"))


def session_metrics(log: DataFrame) -> DataFrame:
    """Steps, errors and latencies per session; p95 is the element at index floor(0.95 n).

    The order statistic uses global positions, so one very long session is spread over tasks.
    """
    called = F.col("tool_name").isNotNull()
    timed = called & (F.col("latency_ms") > 0)
    errors = tally(called & (F.col("tool_status") == "ERROR"))
    summary = log.groupBy("session_id").agg(
        F.count("*").alias("total_steps"), tally(called).alias("total_tool_calls"), errors.alias("total_errors"),
        F.coalesce(share(errors, tally(called), 100), F.lit(0.0)).alias("error_rate_pct"),
        F.round(F.coalesce(F.avg(F.when(timed, F.col("latency_ms"))), F.lit(0.0)), 6).alias("avg_latency_ms"),
    )
    order = [F.col("session_id"), F.col("latency_ms"), F.col("step")]
    placed = ranking.with_position(log.filter(timed).select(*order), order)
    wanted = placed.groupBy("session_id").agg(
        (F.min("position") + F.floor(F.count("*") * F.lit(0.95))).alias("position")
    )
    p95 = wanted.join(placed.select("position", F.col("latency_ms").alias("p95_latency_ms")), "position")
    return summary.join(p95.select("session_id", "p95_latency_ms"), "session_id", "left").withColumn(
        "p95_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0))
    )


def tool_usage(log: DataFrame) -> DataFrame:
    called = log.filter(F.col("tool_name").isNotNull())
    return called.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"))
