"""Boosted trees against a plain implementation, and their behaviour on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotward.operators import boosting, classifiers, vectors
from slotward.plans import models

NAMES = ["a", "b", "c"]


def table_of(spark, x, y):
    rows = [(*map(float, r), None if label is None else int(label)) for r, label in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 400), rng.integers(-1, 4, 400), rng.normal(size=400).round(2)])
    y = (x[:, 0] + 2 * x[:, 2] + rng.normal(size=400) > 6).astype(int)
    return x, y


def plain_boosting(x, y, rounds, depth, rate):
    """Log-odds by exhaustive search over all rows and thresholds, node by node."""
    weight = np.where(y == 1, (y == 0).sum() / max((y == 1).sum(), 1), 1.0)
    margin = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * weight, p * (1 - p) * weight
        step = np.zeros(len(x))

        def split(members, level):
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
            best = (1e-6, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for v in np.unique(x[members, f])[:-1]:
                        low, high = members[x[members, f] <= v], members[x[members, f] > v]
                        if min(h[low].sum(), h[high].sum()) < 1:
                            continue
                        gain = score(low) + score(high) - score(members)
                        if gain > best[0] + 1e-9:
                            best = (gain, (low, high))
            if best[1] is None:
                step[members] = -rate * g[members].sum() / (h[members].sum() + 1)
            else:
                split(best[1][0], level + 1)
                split(best[1][1], level + 1)

        split(np.arange(len(x)), 0)
        margin += step
    return margin


@pytest.mark.parametrize("depth", [1, 3])
def test_equals_plain_boosting(spark, points, depth):
    x, y = points
    model = boosting.fit(table_of(spark, x, y), "y", NAMES, 4, depth, 0.3, row_share=1.0, column_share=1.0)
    assert np.allclose(model.log_odds(x), plain_boosting(x, y, 4, depth, 0.3), atol=1e-4)


def test_partitions_and_row_order_do_not_matter(spark, points):
    x, y = points
    rows = table_of(spark, x, y)
    one = boosting.fit(rows, "y", NAMES, 4, 3)
    many = boosting.fit(rows.orderBy(F.desc("c")).repartition(7), "y", NAMES, 4, 3, block_rows=40)
    assert one.nodes.equals(many.nodes) and one.nodes.tree.nunique() == 4


def test_equal_rows_weigh_like_their_number(spark, points):
    """A hot vector is one weighted vector and gives the same trees as its copies."""
    x, y = points
    hot = np.repeat(x[:1], 300, axis=0)
    rows = table_of(spark, np.concatenate([x, hot]), np.concatenate([y, np.zeros(300, int)]))
    model = boosting.fit(rows, "y", NAMES, 3, 2, 0.3, row_share=1.0, column_share=1.0)
    want = plain_boosting(np.concatenate([x, hot]), np.concatenate([y, np.zeros(300, int)]), 3, 2, 0.3)
    assert np.allclose(model.log_odds(x), want[:len(x)], atol=1e-4)


def test_a_worker_without_margins_replays_the_trees(points):
    x, y = points
    rng = np.random.default_rng(1)
    block = boosting.Block(("t", 0), rng.integers(0, 5, (200, 3)).astype(np.int16), rng.integers(0, 2**63, 200).astype(np.uint64),
                           np.zeros(200), np.ones(200), np.ones(200))
    trees = []
    for k in range(5):
        tree = boosting.Tree.empty(2)
        tree.feature[0], tree.cut[0] = k % 3, 2
        tree.value[1:3] = rng.normal(size=2)
        trees.append(tree)
    step = [boosting._margin(block, trees[:k], 2) for k in range(6)]
    boosting._margins.clear()
    assert np.array_equal(boosting._margin(block, trees, 2), step[-1])
    assert np.array_equal(boosting._margin(block, trees[:2], 2), step[2])  # an older round, asked again


def test_row_sampling_keeps_its_share():
    key = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    for count in (1, 3, 1000):
        block = boosting.Block(("s", 0), None, key, None, np.full(len(key), float(count)), None)
        drawn = boosting.sampled_counts(block, 0.8, 7)
        assert abs(drawn.mean() / count - 0.8) < 0.01 and drawn.max() <= count and drawn.min() >= 0
        assert count > 1 or 0 < np.mean(drawn == boosting.sampled_counts(block, 0.8, 8)) < 0.75
    used = [tuple(boosting._columns(18, 0.8, 42, k)) for k in range(50)]
    assert {len(u) for u in used} == {14} and len(set(used)) > 40 and set(sum(used, ())) == set(range(18))


def test_cuts_of_many_values_hold_equal_shares(spark):
    rows = spark.range(5000).select((F.col("id") % 1250).cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(2).alias("n"))
    many, none = boosting.cut_points(rows, ["a", "b"], bins=50)
    assert len(many) == 49 and len(none) == 0
    sizes = np.bincount(many.searchsorted(np.arange(1250)))
    assert len(sizes) == 50 and sizes.min() == sizes.max() == 25


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b double, c double, y int, tree int")
    scored = classifiers.predict(boosting.fit(empty, "y", NAMES), spark.createDataFrame([(1.0, None, 2.0, 5)], "a double, b double, c double, tree int"), "p")
    assert scored.columns == ["a", "b", "c", "tree", "p"] and scored.first()["p"] == 0.5
    same = table_of(spark, np.ones((20, 3)), [1, 0] * 10)  # nothing to split: the classes weigh the same
    assert classifiers.predict(boosting.fit(same, "y", NAMES, 3), same, "p").select("p").distinct().collect()[0]["p"] == 0.5
    no_label = table_of(spark, np.arange(60).reshape(20, 3), [None] * 20)
    assert classifiers.predict(boosting.fit(no_label, "y", NAMES, 3), no_label, "p").agg(F.max("p")).first()[0] < 0.5
    wild = np.array([[np.inf, np.nan, 0], [-np.inf, 1, 0], [3, np.nan, 1], [4, 2, 1]] * 30)
    rows = table_of(spark, wild, [1, 0, 1, 0] * 30)
    model = boosting.fit(rows, "y", NAMES, 20, 2, 0.3)
    assert classifiers.predict(model, rows, "p").filter((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0


def test_saved_trees_are_the_same(spark, points, tmp_path):
    x, y = points
    model = boosting.fit(table_of(spark, x, y), "y", NAMES, 3, 3)
    classifiers.save(model, str(tmp_path / "m"))
    again = classifiers.load(str(tmp_path / "m"))
    assert again.features == NAMES and np.array_equal(again.log_odds(x), model.log_odds(x))


def test_more_rounds_are_no_more_jobs(spark, points):
    x, y = points
    rows, jobs = table_of(spark, x, y), []
    for rounds in (2, 9):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "fit")
        boosting.fit(rows, "y", NAMES, rounds, 3, block_rows=100)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_equal_rows_of_a_batch_are_scored_once():
    x = np.array([[1.0, np.nan], [2, 0], [1, np.nan], [2, 0], [np.inf, 0]])
    few, places = vectors.distinct(x)
    assert len(few) == 3 and np.array_equal(few[places], x, equal_nan=True)
    few, places = vectors.distinct(np.empty((0, 2)))
    assert len(few) == len(places) == 0


def test_all_models_are_evaluated_on_one_table(spark, sf, monkeypatch):
    tables, model = [], boosting.BoostedTrees(models.FEATURES, boosting._node_table([], []))
    build = models.model_table
    monkeypatch.setattr(models, "model_table", lambda *a: tables.append(1) or build(*a))
    monkeypatch.setattr(models, "classifier", lambda *a, **k: model)
    assert models.both_targets(spark, sf, [("a", "boosted", None), ("b", "boosted", None)]).count() == 4
    assert len(tables) == 1
