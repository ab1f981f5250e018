"""Properties of the detectors, classifiers and explanations on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotward.functions import fixed, health
from slotward.operators import attribution, classifiers, density, evaluation, isolation, oneclass, ranking, reconstruction, vectors
from slotward.plans import features as feature_plans, tables

FEATURES = fixed.DETECTOR_FEATURES


@pytest.fixture(scope="module")
def weighted(master):
    return ranking.pinned(vectors.collapse(master, FEATURES, vectors.baselines()))


@pytest.fixture(scope="module")
def nodes(master):
    return ranking.pinned(isolation.fit(master, FEATURES, trees=20, sample=64))


def test_collapse_keeps_every_row(master, weighted):
    assert weighted.agg(F.sum("n")).first()[0] == master.count()
    incidents = master.filter("helper_current_failure_state = 1").count()
    assert weighted.agg(F.sum("helper")).first()[0] == incidents


def test_forest_does_not_depend_on_partitioning(master, nodes):
    again = isolation.fit(master.repartition(5), FEATURES, trees=20, sample=64)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(nodes) == key(again)


def test_forest_scores_are_bounded_and_fall_with_depth(weighted, nodes):
    scored = isolation.score(weighted, nodes, FEATURES).toPandas()
    assert len(scored) == weighted.count() and scored.score.between(0, 1, inclusive="neither").all()
    depth = isolation.Forest(nodes.toPandas()).depth(scored[FEATURES].to_numpy(float))
    order = np.argsort(depth)
    assert (np.diff(scored.score.to_numpy()[order]) <= 1e-9).all()


def test_trees_are_bounded(nodes):
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max("node").alias("last")).collect()
    assert len(sizes) == 20 and all(r.n <= 127 and r.last == r.n - 1 for r in sizes)


def brute_noise(x, n, eps, least):
    near = (((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps)
    core = near @ n >= least
    return ~(near & core[None, :]).any(axis=1)


@pytest.mark.parametrize("eps,least", [(4.5, 15), (1.5, 5), (0.4, 3)])
def test_density_equals_brute_force(weighted, eps, least):
    scaled = vectors.scaled(weighted, FEATURES)
    got = density.noise(scaled, FEATURES, eps, least).toPandas()
    want = brute_noise(got[FEATURES].to_numpy(float), got.n.to_numpy(float), eps, least)
    assert (got.is_noise.to_numpy() == want).all()


@pytest.mark.parametrize("spread", [0.0, 0.3, 200.0])
def test_density_of_crowds_and_strays(spark, monkeypatch, spread):
    """Heavy cells under several keys, far strays, equal vectors and no spread at all."""
    monkeypatch.setattr(density, "SPLIT", 5)
    monkeypatch.setattr(density, "FEW", 0)
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, spread, (150, 3)), rng.normal(9, 0.2, (60, 3)), rng.uniform(-30, 30, (25, 3))]).round(3)
    table = spark.createDataFrame([(*map(float, p), int(n)) for p, n in zip(points, rng.integers(1, 3, len(points)))], "x double, y double, z double, n long")
    got = density.noise(table, ["x", "y", "z"], 0.8, 6).toPandas()
    assert len(got) == len(points)
    assert (got.is_noise.to_numpy() == brute_noise(got[["x", "y", "z"]].to_numpy(float), got.n.to_numpy(float), 0.8, 6)).all()
    assert density.noise(table.limit(0), ["x", "y", "z"], 0.8, 6).count() == 0


def test_density_compares_few_pairs(spark, weighted, monkeypatch):
    """Pairs looked at on all levels stay far below all pairs, and their share falls with the vectors."""
    monkeypatch.setattr(density, "FEW", 0)
    counts, sizes = [], []
    for table in (weighted, tables.master(spark, "/root/testdata/sf0.01")):
        found = table if table is weighted else vectors.collapse(table, FEATURES)
        scaled, compared = ranking.pinned(vectors.scaled(ranking.pinned(found), FEATURES)), []
        density.noise(scaled, FEATURES, compared=compared).count()
        sizes.append(scaled.count())
        counts.append(sum(compared))
    shares = [c / n**2 for c, n in zip(counts, sizes, strict=True)]
    assert shares[1] < 0.15 and shares[1] < shares[0]


def test_reconstruction_improves_with_width(master, weighted):
    errors = []
    for k in (1, 3, 6):
        scored = reconstruction.Bottleneck(FEATURES, k).fit(master).error(weighted)
        errors.append(scored.agg(F.sum(F.col("mse") * F.col("n"))).first()[0])
    assert errors[0] >= errors[1] >= errors[2] >= 0


def test_one_class_separates_far_vectors(weighted):
    scaled = ranking.pinned(vectors.scaled(weighted, FEATURES))
    decided = oneclass.OneClass(FEATURES, steps=15).fit(scaled).decide(scaled)
    pdf = decided.toPandas()
    norm = (pdf[FEATURES].to_numpy(float) ** 2).sum(axis=1)
    common, rare = pdf.decision[norm < np.quantile(norm, 0.2)].mean(), pdf.decision[norm > np.quantile(norm, 0.8)].mean()
    assert len(pdf) == weighted.count() and common > rare


def test_one_class_boundary_leaves_nu_outside(spark):
    """The learned offset is a boundary: the share of all rows below it is nu, and equal rows fall on one side."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(3000, 3))
    table = spark.createDataFrame([(*map(float, p), int(n)) for p, n in zip(points, rng.integers(1, 4, 3000))], "x double, y double, z double, n long")
    model = oneclass.OneClass(["x", "y", "z"], steps=12).fit(ranking.pinned(table))
    found = model.decide(table).agg(F.sum(F.when(F.col("decision") < 0, F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    assert abs(found - model.nu) <= 0.1 * model.nu
    again = oneclass.OneClass(["x", "y", "z"], steps=12).fit(ranking.pinned(table.repartition(7)))
    assert np.allclose(again.weights, model.weights) and abs(again.offset - model.offset) < 1e-9
    assert oneclass.OneClass(["x"]).fit(table.limit(0)).offset == 0.0


def test_training_rows_keep_the_weight_and_split_hot_groups(master):
    all_rows = vectors.training_rows(master, FEATURES, "target_failure_3slot")
    assert all_rows.count() == master.count() and all_rows.filter("weight <> 1").count() == 0
    small = vectors.training_rows(master, FEATURES, "target_failure_3slot", target=100)
    assert abs(small.agg(F.sum("weight")).first()[0] - master.count()) < 1e-6
    assert small.agg(F.max("weight")).first()[0] <= -(-master.count() // 100)


def test_leaking_inputs_are_refused(master):
    with pytest.raises(ValueError):
        classifiers.fit(master, "target_failure_3slot", FEATURES + ["target_failure_6slot"], "boosted")


@pytest.fixture(scope="module")
def boosted(master):
    train, _test = feature_plans.split(master)
    return classifiers.fit(train, "target_failure_3slot", fixed.CLASSIFIER_FEATURES, "boosted", maxIter=6, maxDepth=4)


def test_contributions_add_up_to_the_log_odds(master, boosted):
    features = fixed.CLASSIFIER_FEATURES
    scored = classifiers.predict(boosted, master.select("observation_id", *features), "p")
    explained = attribution.explain(scored, boosted, features)
    total = F.aggregate("contributions", F.col("base_value"), lambda s, x: s + x)
    worst = explained.agg(F.max(F.abs(1 / (1 + F.exp(-total)) - F.col("p"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == master.count()


def brute_shapley(explainer, x, features):
    """Shapley values by definition: expectation over the features outside the coalition, leaf by leaf."""
    from itertools import combinations
    from math import factorial

    d = len(features)

    def value(coalition):
        total = 0.0
        for path, leaf in explainer:
            part = leaf
            for f, (low, high, share) in path.items():
                part *= float(low < x[f] <= high) if f in coalition else share
            total += part
        return total

    out = np.zeros(d)
    for i in range(d):
        rest = [f for f in range(d) if f != i]
        for size in range(d):
            for group in combinations(rest, size):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                out[i] += weight * (value(set(group) | {i}) - value(set(group)))
    return out


def test_contributions_equal_the_definition(spark, master):
    features = fixed.CLASSIFIER_FEATURES[:1] + fixed.CLASSIFIER_FEATURES[-5:]
    model = classifiers.fit(master, "target_failure_3slot", features, "boosted", maxIter=3, maxDepth=3)
    nodes = attribution.tree_nodes(model, spark)
    leaves = [(path, 2.0 * v) for _, t in nodes.groupby("tree") for v, path in attribution._leaf_paths(t)]
    x = np.array([list(r) for r in master.select(*health.imputed(features, True)).limit(5).collect()], float)
    got = attribution.Explainer(nodes, features).contributions(x)
    want = np.array([brute_shapley(leaves, row, features) for row in x])
    assert np.allclose(got, want, atol=1e-9)


def test_saved_model_scores_the_same(spark, master, boosted):
    from slotward.session import fresh_path

    path = fresh_path(spark, "test-model")
    classifiers.save(boosted, path)
    both = classifiers.predict(classifiers.load(path), classifiers.predict(boosted, master, "a"), "b")
    assert both.filter("a <> b").count() == 0


def test_perfect_and_useless_scores(spark):
    rows = [(1, 0.9, 0.5), (1, 0.8, 0.5), (0, 0.2, 0.5), (0, 0.1, 0.5), (None, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "y int, good double, flat double")
    good = evaluation.areas(evaluation.score_totals(df, "y", "good")).first()
    flat = evaluation.areas(evaluation.score_totals(df, "y", "flat")).first()
    assert (good.pr_auc, good.roc_auc) == (1.0, 1.0) and (flat.pr_auc, flat.roc_auc) == (0.7, 0.5)
    best = evaluation.best_f1(evaluation.score_totals(df, "y", "good")).first()
    assert best.optimal_threshold == 0.8 and round(best.optimal_f1_pct, 3) == 100.0


def test_every_part_of_the_table_is_sampled(spark):
    """No share of the keys is left out of the forest's samples, however large the table."""
    rows = spark.range(400_000).select(F.col("id").cast("string").alias("observation_id"), *[(F.col("id") % 7).cast("double").alias(c) for c in FEATURES])
    drawn = isolation.tree_samples(rows, FEATURES, "observation_id", 100, 256, 42, 400_000)
    per_part = {r["part"]: r["n"] for r in drawn.groupBy(F.floor(F.col("observation_id").cast("long") / 40_000).alias("part")).agg(F.count("*").alias("n")).collect()}
    assert sum(per_part.values()) == 100 * 256 and len(per_part) == 10
    assert all(0.8 * 2560 < n < 1.2 * 2560 for n in per_part.values())


def test_trees_draw_rows_on_their_own(spark):
    """Numbers of trees per row follow the binomial distribution, no tree is preferred, none draws a row twice."""
    n, trees, share = 60_000, 20, 0.1
    rows = spark.range(n).select(F.col("id").cast("string").alias("k")).withColumn("t", isolation.drawn_trees("k", trees, share, 7))
    assert rows.filter(F.size("t") != F.size(F.array_distinct("t"))).count() == 0
    counts = {r["size"]: r["count"] for r in rows.groupBy(F.size("t").alias("size")).count().collect()}
    for k in range(6):
        want = n * math.comb(trees, k) * share**k * (1 - share) ** (trees - k)
        assert abs(counts[k] - want) < 5 * want**0.5 + 5
    per_tree = [r["count"] for r in rows.select(F.explode("t").alias("t")).groupBy("t").count().collect()]
    assert len(per_tree) == trees and max(abs(c - n * share) for c in per_tree) < 5 * (n * share) ** 0.5
    pairs = rows.filter(F.array_contains("t", 3) & F.array_contains("t", 19)).count()
    assert abs(pairs - n * share**2) < 5 * (n * share**2) ** 0.5
    assert spark.range(3).select(isolation.drawn_trees("id", 4, 1.0, 7).alias("t")).first()["t"] == [0, 1, 2, 3]
