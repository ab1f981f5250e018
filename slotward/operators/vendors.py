"""Comparing two sources that describe the same machines."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, health, slots
from ..functions.numbers import share, tally, total
from . import shape


def dual_monitored(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("has_hpe") & F.col("has_dell"))


def aligned(hpe: DataFrame, dell: DataFrame) -> DataFrame:
    """Rows of both sources in the same shifted slot, component columns suffixed."""

    def side(df, name):
        names = [c for c in fixed.COMPONENTS if c in df.columns]
        return df.select("machine_name", "ip_address", slots.shifted_slot(F.col("event_time")).alias("slot"),
                         *[F.col(c).alias(f"{c}_{name}") for c in names])

    return side(hpe, "hpe").join(side(dell, "dell"), ["machine_name", "ip_address", "slot"])


def match_rates(pairs: DataFrame) -> DataFrame:
    hits = {c: tally(F.col(f"{c}_hpe") == F.col(f"{c}_dell")).alias(c) for c in fixed.COMPONENTS}
    counted = pairs.agg(F.count("*").alias("aligned_rows"), *hits.values())
    return shape.rows_of(counted, [
        {"component": F.lit(c), "matches": F.col(c), "aligned_rows": F.col("aligned_rows"),
         "match_pct": F.coalesce(share(F.col(c), F.col("aligned_rows"), 100), F.lit(0.0))}
        for c in fixed.COMPONENTS
    ])


def any_mismatch(left: str = "hpe_{}", right: str = "dell_{}"):
    return reduce(or_, [health.differs(F.col(left.format(c)), F.col(right.format(c))) for c in fixed.COMPONENTS])


def mismatch_rows(pairs: DataFrame, limit: int = 20) -> DataFrame:
    differing = pairs.filter(any_mismatch("{}_hpe", "{}_dell"))
    return differing.orderBy("machine_name", "slot", "ip_address").limit(limit).withColumn("slot", slots.time_text(F.col("slot")))


def mismatch_pairs(dual: DataFrame) -> DataFrame:
    """How often each (hpe, dell) value pair disagrees, per component."""
    long = shape.rows_of(dual, [
        {"component": F.lit(c), "hpe_value": F.col(f"hpe_{c}"), "dell_value": F.col(f"dell_{c}")}
        for c in fixed.COMPONENTS
    ])
    return long.filter(F.col("hpe_value") != F.col("dell_value")).groupBy("component", "hpe_value", "dell_value").agg(
        F.count("*").alias("n")
    )


def disagreement_totals(dual: DataFrame) -> DataFrame:
    names = fixed.COMPONENTS
    counted = dual.agg(
        F.count("*").alias("rows"), tally(any_mismatch()).alias("any"),
        *[tally(health.differs(F.col(f"hpe_{c}"), F.col(f"dell_{c}"))).alias(c) for c in names],
    )
    return shape.rows_of(counted, [
        {"component": F.lit(c), "mismatches": F.col(c), "rows": F.col("rows"),
         "mismatch_pct": share(F.col(c), F.col("rows"), 100),
         "agreement_pct": share(F.col("rows") - F.col(c), F.col("rows"), 100)}
        for c in names + ["any"]
    ])


def dominance(dual: DataFrame, ranks: dict = fixed.DOMINANCE_RANKS) -> DataFrame:
    """On mismatch rows, which source reports the higher worst state."""
    top = {v: F.greatest(*[health.lookup(f"{v}_{c}", ranks, 0) for c in fixed.COMPONENTS]) for v in ("hpe", "dell")}
    hpe, dell = F.col("h"), F.col("d")
    counted = dual.filter(any_mismatch()).select(top["hpe"].alias("h"), top["dell"].alias("d")).agg(
        F.count("*").alias("mismatch_rows"), tally(hpe > dell).alias("hpe_more_severe"),
        tally(dell > hpe).alias("dell_more_severe"),
    )
    return counted.select(
        "*", share(F.col("hpe_more_severe"), F.col("mismatch_rows"), 100).alias("hpe_pct"),
        share(F.col("dell_more_severe"), F.col("mismatch_rows"), 100).alias("dell_pct"),
    )


def component_richness(dual: DataFrame) -> DataFrame:
    """Missing cells and state vocabulary per vendor and component."""
    long = shape.rows_of(dual, [
        {"vendor": F.lit(v), "component": F.lit(c), "value": F.col(f"{v}_{c}")}
        for v in ("hpe", "dell") for c in fixed.COMPONENTS
    ]).groupBy("vendor", "component", "value").agg(F.count("*").alias("n"))
    words = F.array_join(F.array_sort(F.collect_list("value")), ",")
    return long.groupBy("vendor", "component").agg(
        total(F.when(F.col("value").isNull(), F.col("n"))).alias("null_cells"),
        F.count("value").alias("states"), words.alias("state_names"),
    )


def vendor_totals(dual: DataFrame) -> DataFrame:
    """Null cells over all columns of a vendor, and rows with diagnostic text."""
    texts = {"hpe": "hpe_current_problems", "dell": "dell_issues_detected"}
    cells = {v: [c for c in dual.columns if c.startswith(f"{v}_")] for v in texts}
    nulls = {v: sum((F.col(c).isNull().cast("int") for c in cells[v]), F.lit(0)) for v in texts}
    counted = dual.agg(
        F.count("*").alias("rows"),
        *[total(nulls[v]).alias(f"{v}_nulls") for v in texts],
        *[tally(F.col(t).isNotNull()).alias(f"{v}_texts") for v, t in texts.items()],
    )
    return shape.rows_of(counted, [
        {"vendor": F.lit(v), "rows": F.col("rows"), "null_cells": F.col(f"{v}_nulls"), "text_rows": F.col(f"{v}_texts")}
        for v in texts
    ])


def mismatches_per_machine(dual: DataFrame) -> DataFrame:
    return dual.filter(any_mismatch()).groupBy("machine_name").agg(F.count("*").alias("mismatch_rows"))


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def value_scan(df: DataFrame, value: str) -> DataFrame:
    """Which text columns hold the value, how often and in what share of rows."""
    names = text_columns(df)
    counted = df.agg(F.count("*").alias("_rows"), *[tally(F.col(c) == value).alias(c) for c in names])
    long = shape.rows_of(counted, [
        {"column_name": F.lit(c), "n": F.col(c), "pct": share(F.col(c), F.col("_rows"), 100)} for c in names
    ])
    return long.filter(F.col("n") > 0)


def holding(gold: DataFrame, value: str) -> DataFrame:
    """Rows where any text column equals the value."""
    return gold.filter(health.any_equals(text_columns(gold), value))


def holders_by_machine(gold: DataFrame, value: str) -> DataFrame:
    sources = F.array_join(F.array_sort(F.collect_set("telemetry_source")), ", ")
    return holding(gold, value).groupBy("machine_name").agg(F.count("*").alias("n"), sources.alias("sources"))


def state_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(part in c for part in fixed.COMPONENTS)]


def co_occurrence(gold: DataFrame, value: str) -> DataFrame:
    """Rows holding the value, split by what else their components report."""
    columns = state_columns(gold)
    flagged = holding(gold, value).select(
        health.any_equals(columns, "Critical").alias("c"), health.any_equals(columns, "Degraded").alias("d")
    )
    c, d = F.col("c"), F.col("d")
    return flagged.agg(
        F.count("*").alias("rows"), tally(c & d).alias("both"), tally(c & ~d).alias("also_critical"),
        tally(~c & d).alias("also_degraded"), tally(~c & ~d).alias("neither"),
    )
