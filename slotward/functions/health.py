"""Severity encodings, cross-source states and the flags built on them."""

from pyspark.sql import Column, functions as F

from . import fixed


def lookup(name: str, table: dict, default=None) -> Column:
    """Map a column through a small fixed table; anything else gives the default."""
    branches = " ".join(f"WHEN {key!r} THEN {value!r}" for key, value in table.items())
    rest = "NULL" if default is None else repr(default)
    return F.expr(f"CASE {name} {branches} ELSE {rest} END")


def severity(state: str) -> Column:
    return lookup(state, fixed.SEVERITY_RANKS)


def ping_code(status: str) -> Column:
    return lookup(status, fixed.PING_CODES)


def differs(a: Column, b: Column) -> Column:
    """Missing differs from everything, missing included."""
    return F.coalesce(a != b, F.lit(True))


def disagreement(component: str) -> Column:
    return F.expr(f"CAST(has_hpe AND has_dell AND coalesce(hpe_{component} <> dell_{component}, true) AS INT)")


def count_at(columns: list[str], rank: int) -> Column:
    """How many of the columns hold the rank; nulls do not count."""
    return F.expr(" + ".join(f"IF({c} = {rank}, 1, 0)" for c in columns))


def any_equals(columns: list[str], value: str) -> Column:
    """True when at least one column holds the value, null treated as no."""
    return F.expr(" OR ".join(f"({c} <=> {value!r})" for c in columns))


def source_tag(has_hpe: Column, has_dell: Column) -> Column:
    tags = fixed.SOURCE_TAGS
    return (
        F.when(has_hpe & has_dell, tags[(True, True)])
        .when(has_dell, tags[(False, True)])
        .when(has_hpe, tags[(True, False)])
        .otherwise(tags[(False, False)])
    )


def rank_label(rank: str) -> Column:
    return lookup(rank, fixed.RANK_LABELS, fixed.NO_SENSOR)


def present_text(text: Column) -> Column:
    """True when a diagnostic text says something."""
    return text.isNotNull() & ~F.trim(text).isin("", "None", "nan")


def whole_number(text: Column, default: int = 0) -> Column:
    """Integer part of a numeric text, or the default when it is not a number."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def named_when(pairs: list[tuple[Column, object]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, label) for cond, label in pairs]))


def evidence_sources() -> Column:
    names = fixed.EVIDENCE_SOURCES
    return named_when([
        (F.lit(True), F.lit(names["ping"])),
        (F.col("has_dell"), F.lit(names["dell"])),
        (F.col("has_hpe"), F.lit(names["hpe"])),
    ])


def imputed(columns: list[str], fill_rest: bool = False) -> list[Column]:
    """Model inputs as doubles: no sensor is -1, no history is 0."""
    out = []
    for name in columns:
        value = F.col(name).cast("double")
        if name in fixed.WORST_COLUMNS:
            value = F.coalesce(value, F.lit(float(fixed.HARDWARE_FILL)))
        elif name in fixed.LAG_COLUMNS:
            value = F.coalesce(value, F.lit(float(fixed.LAG_FILL)))
        elif fill_rest:
            value = F.coalesce(value, F.lit(0.0))
        out.append(value.alias(name))
    return out
