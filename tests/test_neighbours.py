"""Nearest-neighbour information against a plain implementation over single rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotward.operators import neighbours


def psi(x):
    return np.log(x + 6) - 1 / (2 * (x + 6)) - 1 / (12 * (x + 6) ** 2) + 1 / (120 * (x + 6) ** 4) - sum(1 / (x + j) for j in range(6))


def plain(v, y, k=3):
    keep = np.array([np.sum(y == c) > 1 for c in y], bool)
    v, y, terms = v[keep], y[keep], []
    for i in range(len(v)):
        d = np.abs(v - v[i])
        inside = np.sort(np.delete(d, i)[np.delete(y, i) == y[i]])
        near = min(k, len(inside))
        r = inside[near - 1]
        kept, m = (np.sum(inside == 0), np.sum(d == 0) - 1) if r == 0 else (near, np.sum(d < r))
        terms.append(psi(kept) - psi(np.sum(y == y[i])) - psi(m))
    return max(0.0, psi(len(v)) + np.mean(terms))


def rows_of(spark, v, y):
    names = ["ping_timeout_rate_3slot", "ping_timeout_rate_6slot"]
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(v, y, strict=True)], f"{names[0]} double, {names[1]} double, y int"), names


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equals_plain_rows(spark, k):
    """One column without ties, one with many; a label held once is left out."""
    rng = np.random.default_rng(k)
    y = np.append(rng.integers(0, 2, 250), 7)
    free = rng.permutation(4000)[:251] * 1000 + y * 300_000
    tied = np.round(rng.integers(0, 7, 251) / 6 * 1e6) * (1 + (y == 1) * (rng.random(251) < 0.3))
    rows, names = rows_of(spark, np.column_stack([free, tied]) / 1e6, y)
    got = {r["feature"]: r["mi"] for r in neighbours.information(rows.repartition(5), "y", names, k).collect()}
    for name, column in zip(names, (free, tied), strict=True):
        assert abs(got[name] - plain(np.round(column).astype(np.int64), y, k)) < 2e-6
    assert got[names[0]] > 0.01


def test_odd_tables(spark):
    rows, names = rows_of(spark, [(0.5, 0.1)] * 8 + [(0.5, 0.2)] * 4, [0] * 8 + [1] * 4)
    got = {r["feature"]: r["mi"] for r in neighbours.information(rows, "y", names).collect()}
    assert got[names[0]] < 0.05 < 0.5 < got[names[1]]
    assert neighbours.information(rows.filter("false"), "y", names).count() == 0
    assert neighbours.information(rows.withColumn("y", F.lit(None).cast("int")), "y", names).count() == 0
    nulls = rows.withColumn(names[0], F.lit(None).cast("double"))
    assert neighbours.information(nulls, "y", names).count() == 2


def test_close_to_the_discrete_estimate(spark, sf):
    """On the rates, whose values are few, both estimates agree to 0.002 nats."""
    from slotward.operators import screening
    from slotward.plans import tables

    rows, names = tables.master(spark, "/root/testdata/sf0.01"), ["ping_timeout_rate_3slot", "ping_timeout_rate_6slot"]
    a = {r["feature"]: r["mi"] for r in neighbours.information(rows, "target_failure_3slot", names).collect()}
    b = {r["feature"]: r["mi"] for r in screening.mutual_information(rows, "target_failure_3slot", names).collect()}
    assert a.keys() == b.keys() and all(abs(a[n] - b[n]) < 0.002 for n in names)
