"""Steps whose work, disk or jobs must not grow faster than they have to."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import boosting, cluster_metrics, segments
from basketry.sources import retail


def _labelled(spark, n=130):
    rng = np.random.default_rng(3)
    x, one, two = rng.normal(size=(n, 2)), rng.integers(0, 3, n), rng.integers(5, 7, n)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), int(d)) for i, ((a, b), c, d) in enumerate(zip(x, one, two))],
                               "id long, a double, b double, one int, two int").repartition(3)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def brute(label):
        widths = []
        for i in range(n):
            mine = label == label[i]
            inside = gaps[i, mine].sum() / (mine.sum() - 1)
            nearest = min(gaps[i, label == c].mean() for c in set(label) - {label[i]})
            widths.append((nearest - inside) / max(nearest, inside))
        return np.mean(widths)

    return df, brute(one), brute(two)


@pytest.mark.parametrize("right_blocks", [1000, 4])
def test_labelings_share_distances_over_blocks(spark, right_blocks):
    df, one, two = _labelled(spark)
    found = cluster_metrics.silhouettes_exact(df, ["a", "b"], ["one", "two"], "id", block_rows=9, right_blocks=right_blocks).collect()
    assert [(r.label, r.measure, r.n) for r in found] == [("one", "euclidean", 130), ("two", "euclidean", 130)]
    assert [r.silhouette for r in found] == pytest.approx([one, two])


def test_rows_are_not_written_once_per_block(spark):
    df, one, _ = _labelled(spark)
    few = cluster_metrics.silhouette_exact(df, ["a", "b"], "one", "id", block_rows=5)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and "explode(array(0" not in plan
    assert few.first().silhouette == pytest.approx(one)


def test_silhouette_of_one_cluster_copies_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.5, i % 2) for i in range(10)], "id long, a double, c int")
    assert cluster_metrics.silhouette_exact(df, ["a"], "c", "id").first().silhouette == 0.0
    alone = cluster_metrics.silhouette_exact(df.withColumn("c", F.lit(1)), ["a"], "c", "id").first()
    none = cluster_metrics.silhouette_exact(df.limit(0), ["a"], "c", "id").first()
    assert (alone.silhouette, alone.n, none.silhouette, none.n) == (None, 10, None, 0)


def test_choice_of_k_takes_all_distances_once(spark, monkeypatch):
    df, *_ = _labelled(spark)
    calls, real = [], cluster_metrics.silhouettes_exact
    monkeypatch.setattr(segments, "silhouettes_exact", lambda *a, **o: calls.append(a) or real(*a, **o), raising=False)
    found = segments.segment(df, ("a", "b"), log=False, ks=(2, 3, 4), restarts=2, key="id", measure="euclidean").scores.collect()
    assert len(calls) == 1 and [r.measure for r in found] == ["euclidean"] * 3 and sum(r.selected for r in found) == 1


def test_boosting_adds_a_tree_to_the_margins_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), float(a + b * b > 0.8), 1.0, i % 3) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))],
                               "a double, b double, label double, weight double, fold int").repartition(2)
    added, real = [], boosting._with_margins
    monkeypatch.setattr(boosting, "_with_margins", lambda chunks, tree, levels: added.append(tree) or real(chunks, tree, levels))
    monkeypatch.setattr(boosting, "FEW", 200)  # several tasks
    (model, other), scored = boosting.fit_all(df, ["a", "b"], [boosting.Boosting(6, 3, 0.3), boosting.Boosting(6, 2, 0.3, fold=1)], report=(3, 6))
    assert len(added) == 6  # one addition per tree
    assert scored.groupBy("trees", "fit").count().orderBy("trees").collect() == [(3, 1, 100), (6, 1, 100)]
    margins = sorted(r.margin for r in scored.where("trees = 6").collect())
    rows = df.where("fold = 1").toPandas()
    assert margins == pytest.approx(sorted(other.margins(rows[["a", "b"]].to_numpy())))


def test_csv_fields_are_parsed_once(spark, tmp_path):
    place = tmp_path / "lines.csv"
    place.write_text("quantity,price\n7.0, 2.5\n,\n-3,1e3\n")
    schema = T.StructType([T.StructField("quantity", T.IntegerType()), T.StructField("price", T.DoubleType())])
    read = retail.read_lines(spark, str(place), schema=schema)
    plan = read._jdf.queryExecution().analyzed().toString()
    assert plan.count("trim(price") == 2  # once for the value, once to tell empty fields where there is none
    assert [tuple(r) for r in read.collect()] == [(7, 2.5), (None, None), (-3, 1000.0)]
    for bad in ("2.5,1", "3000000000,1", "x,1", "1,x"):
        place.write_text(f"quantity,price\n{bad}\n")
        with pytest.raises(Exception, match="cannot hold"):
            retail.read_lines(spark, str(place), schema=schema).collect()
        assert sum(retail.count_bad_fields(spark, str(place), schema).first()) == 1
        assert None in tuple(retail.read_lines(spark, str(place), schema=schema, bad_fields="null").first())
