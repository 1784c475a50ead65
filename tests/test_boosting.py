"""Boosted trees against a recursion over plain lists, and against each other alone and together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import boosting, metrics
from basketry.operators.boosting import Boosting

NAMES = ("a", "b", "c")


def drawn(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * (x[:, 1] > 0.3))))
    y = (rng.random(n) < chance).astype(float)
    return [(k, *map(float, r), float(l), 1.0 + float(l), int(k % 3)) for k, (r, l) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(drawn(600), "id long, a double, b double, c double, label double, weight double, fold int").repartition(5)


def grow(rows, margins, cuts, depth, rate):
    """One tree by trying every cut on every node: nested tuples (feature, cut, left, right) or a value."""
    g = [r[5] * (1 / (1 + math.exp(-m)) - r[4]) for r, m in zip(rows, margins)]
    h = [r[5] * (p := 1 / (1 + math.exp(-m))) * (1 - p) for r, m in zip(rows, margins)]

    def worth(members):
        return sum(g[k] for k in members) ** 2 / (sum(h[k] for k in members) + 1)

    def node(members, left):
        best = None
        for d in range(3) if left else ():
            for cut in cuts[d]:
                low = [k for k in members if rows[k][1 + d] <= cut]
                high = [k for k in members if rows[k][1 + d] > cut]
                if sum(h[k] for k in low) >= 1 and sum(h[k] for k in high) >= 1:
                    gain = worth(low) + worth(high) - worth(members)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-6):
                        best = gain, d, cut, low, high
        if best is None:
            return -rate * sum(g[k] for k in members) / (sum(h[k] for k in members) + 1)
        return best[1], best[2], node(best[3], left - 1), node(best[4], left - 1)

    return node(range(len(rows)), depth)


def value_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[1 + tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_are_those_of_a_plain_recursion(rows):
    plain = sorted(tuple(r) for r in rows.collect())
    cuts = boosting.edges(rows, NAMES, 8)
    (found,), _ = boosting.fit_all(rows, NAMES, [Boosting(4, 3, 0.3)], bins=8)
    margins = [0.0] * len(plain)
    for t in range(4):
        tree = grow(plain, margins, [list(c) for c in cuts], 3, 0.3)
        margins = [m + value_of(tree, r) for m, r in zip(margins, plain)]
        x = np.array([r[1:4] for r in plain])
        assert found.first(t + 1).margins(x) == pytest.approx(margins, abs=1e-5)


def test_together_as_alone_and_folds_left_out(rows, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    several = [Boosting(5, 2, 0.3), Boosting(3, 3, 0.1, fold=1), Boosting(5, 4, 0.2, leaves=5)]
    together, held = boosting.fit_all(rows, NAMES, several, report=(2, 5))
    for b, found in zip(several, together):
        source = rows if b.fold < 0 else rows.where(F.col("fold") != b.fold)
        (alone,), _ = boosting.fit_all(rows.withColumn("fold", F.when(F.col("fold") == 1, 1).otherwise(0)), NAMES, [b])
        width = alone.feature.shape[1]
        assert np.array_equal(found.feature[:, :width], alone.feature)
        assert np.array_equal(found.value[:, :width], alone.value) and found.feature.shape[0] == b.trees
        assert source.count()
    inner = (together[2].feature >= 0).sum(1)
    assert (inner + 1 <= 5).all() and (inner + 1 == 5).any()
    counts = {(r.trees, r.fit): r.n for r in held.groupBy("trees", "fit").agg(F.count("*").alias("n")).collect()}
    assert counts == {(2, 1): 200, (5, 1): 200}
    x = np.array([list(r)[1:4] for r in rows.where("fold = 1").collect()])
    assert sorted(r.margin for r in held.where("trees = 5").collect()) == pytest.approx(sorted(together[1].margins(x)))


def test_a_boosting_in_one_task_grows_the_trees_of_jobs_per_level(spark, rows, monkeypatch):
    several = [Boosting(6, 3, 0.3), Boosting(4, 2, 0.1, fold=1), Boosting(6, 4, 0.2, fold=0, leaves=5), Boosting(6, 1, 0.5, fold=7)]

    def fitted(group):
        spark.sparkContext.setJobGroup(group, group)
        found = boosting.fit_all(rows, NAMES, several, report=(2, 6))
        spark.sparkContext._jsc.clearJobGroup()
        return *found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    monkeypatch.setattr(boosting, "SLICE", 70, raising=False)  # several slices of a node
    one, scored, jobs = fitted("boostings-alone")
    assert jobs < 15  # whatever the number of trees and levels
    monkeypatch.setattr(boosting, "WHOLE", 0, raising=False)
    levels, by_level, more = fitted("boostings-by-level")
    assert more > jobs
    for a, b in zip(one, levels):
        assert all(np.array_equal(getattr(a, part), getattr(b, part)) for part in ("feature", "threshold", "value"))
    columns = ("trees", "fit", "margin", "label")
    held = sorted(tuple(r) for r in scored.select(*columns).collect())
    assert held == sorted(tuple(r) for r in by_level.select(*columns).collect()) and len(held) == 2 * 400


def test_best_first_keeps_the_greatest_gains():
    feature, gain = np.array([0, 1, 2, 0, -1, 1, 2] + [-1] * 8), np.array([9., 1, 5, 8, 0, 3, 2] + [0.] * 8)
    boosting._best_first(feature, gain, 4)
    assert np.flatnonzero(feature >= 0).tolist() == [0, 2, 5]  # node 3 waits for its parent


def test_planted_signal_is_learnt_saved_and_loaded(spark, rows, tmp_path):
    train = rows.where("id < 400").withColumn("fold", F.lit(0))
    (model,), _ = boosting.fit_all(train, NAMES, [Boosting(20, 5, 0.2, leaves=31)])
    test = spark.createDataFrame(drawn(600, 8), rows.schema)
    scored = boosting.predict(model, test)
    assert metrics.roc_auc(scored).first().auc > 0.8
    boosting.save(model, spark, str(tmp_path / "trees"))
    again = boosting.predict(boosting.load(spark, str(tmp_path / "trees"), NAMES), test)
    assert sorted(r.score for r in again.collect()) == sorted(r.score for r in scored.collect())


def test_areas_are_those_of_the_single_form(spark, rows):
    scored = rows.select("fold", F.round("a", 1).alias("margin"), "label")
    for r in boosting.areas(scored, ["fold"]).collect():
        part = scored.where(F.col("fold") == r.fold).withColumnRenamed("margin", "score")
        assert r.auc == pytest.approx(metrics.roc_auc(part).first().auc)


def test_search_covers_the_grid_and_its_model_is_the_single_fit(rows):
    train = rows.drop("fold").withColumnRenamed("id", "customer_id").withColumn("Churn", F.col("label").cast("int"))
    found = boosting.search(train, NAMES, {"trees": (1, 4), "depth": (1, 2), "rate": (0.1, 0.3)}, folds=2)
    table = found.table.collect()
    assert len(table) == 8 and sum(r.selected for r in table) == 1
    chosen = next(r for r in table if r.selected)
    assert chosen.mean_auc == max(r.mean_auc for r in table) > 0.6
    assert (found.best.trees, found.best.depth, found.best.rate) == (chosen.trees, chosen.depth, chosen.rate)
    (alone,), _ = boosting.fit_all(train.withColumn("fold", F.lit(0)), NAMES, [found.best])
    width = alone.feature.shape[1]
    assert np.array_equal(found.model.value[:, :width], alone.value)


def test_nulls_nan_one_class_and_no_rows(spark, rows):
    odd = spark.createDataFrame([(None, 1.0, float("nan"), 1.0, 1.0, 0), (2.0, None, 0.5, None, 1.0, 0), (1.0, 1.0, 1.0, 0.0, 1.0, None),
                                 (None, None, None, 1.0, 1.0, 0)], "a double, b double, c double, label double, weight double, fold int")
    (model,), _ = boosting.fit_all(odd, NAMES, [Boosting(2, 2, 0.5)])
    assert (model.feature < 0).all()  # two rows are too few to split
    assert all(r.score > 0.5 for r in boosting.predict(model, odd).collect())
    (model,), _ = boosting.fit_all(odd.limit(0), NAMES, [Boosting(2, 2, 0.5)])
    assert [r.score for r in boosting.predict(model, odd).collect()] == [0.5] * 4
    lows = spark.createDataFrame([(None if k % 2 else 1.0, 0.0, 0.0, float(k % 2), 1.0, 0) for k in range(40)], odd.schema)
    (model,), _ = boosting.fit_all(lows, NAMES, [Boosting(2, 1, 0.5)])
    assert {(r.a is None, r.score > 0.5) for r in boosting.predict(model, lows).collect()} == {(True, True), (False, False)}
