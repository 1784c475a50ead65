import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry import schemas
from basketry.functions.columns import recommended_action, risk_level, segment_description, segment_name
from basketry.operators import churn, cluster_metrics, metrics, segments
from basketry.operators.sampling import stratified_split, with_folds
from basketry.sources import models, retail
from basketry.streaming import scoring


# --- metrics -------------------------------------------------------------------

def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_area_under_the_curve_counts_ties_half(spark):
    rows = [(1, 1, 0.9), (0, 0, 0.5), (1, 1, 0.5), (0, 0, 0.1)]
    assert metrics.roc_auc(scored(spark, rows)).first().auc == 0.875
    assert metrics.roc_auc(scored(spark, [(1, 1, 0.9), (1, 0, 0.1)])).first().auc is None


def test_area_under_the_curve_of_many_distinct_scores(spark):
    rng = np.random.default_rng(3)
    labels, scores = rng.integers(0, 2, 3000), rng.normal(size=3000).round(2)
    pos, neg = scores[labels == 1], scores[labels == 0]
    pairs = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    rows = [(int(y), 0, float(s)) for y, s in zip(labels, scores)]
    assert metrics.roc_auc(scored(spark, rows)).first().auc == pytest.approx(pairs, abs=1e-12)


def test_report_of_a_class_that_is_never_predicted(spark):
    report = {r["class"]: r for r in metrics.classification_report(scored(spark, [(0, 0, 0.1)] * 3 + [(1, 0, 0.1)])).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0, 0, 0, 1)
    assert report["accuracy"].precision == 0.75 and report["macro avg"].recall == 0.5
    assert report["weighted avg"].precision == pytest.approx(0.5625)
    matrix = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(scored(spark, [(0, 0, 0.1), (1, 0, 0.1)])).collect()}
    assert matrix == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_risk_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.4,), (0.4001,), (0.7,), (0.7001,)], "p double")
    rows = df.select(risk_level(F.col("p")).alias("r"), recommended_action(F.col("p")).alias("a")).collect()
    assert [r.r for r in rows] == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk"]
    assert rows[3].a.startswith("Contact")


# --- splits ---------------------------------------------------------------------

def labelled(spark, ones, zeros):
    return spark.range(ones + zeros).select(F.col("id").alias("customer_id"), (F.col("id") < ones).cast("int").alias("Churn"))


@pytest.mark.parametrize("ones,zeros", [(33, 67), (5, 8), (1, 99)])
def test_split_is_stratified_and_repeatable(spark, ones, zeros):
    df = labelled(spark, ones, zeros)
    first = {r.customer_id: r.split for r in stratified_split(df).collect()}
    again = {r.customer_id: r.split for r in stratified_split(df.repartition(7)).collect()}
    assert first == again and len(first) == ones + zeros
    test = [i for i, part in first.items() if part == "test"]
    assert len(test) == -(-(ones + zeros) // 5)
    assert abs(sum(i < ones for i in test) - len(test) * ones / (ones + zeros)) < 1
    other = {r.customer_id for r in stratified_split(df, seed=7).where("split = 'test'").collect()}
    assert ones == 1 or other != set(test)


def test_folds_are_even_within_classes(spark):
    sizes = {(r.Churn, r.fold): r["count"] for r in with_folds(labelled(spark, 12, 31)).groupBy("Churn", "fold").count().collect()}
    assert sorted(v for (c, _), v in sizes.items() if c == 1) == [2, 2, 2, 3, 3]
    assert sorted(v for (c, _), v in sizes.items() if c == 0) == [6, 6, 6, 6, 7]


# --- churn models -----------------------------------------------------------------

def customers(spark, n=400):
    noise = (F.xxhash64("id") % 100) / 50.0
    df = spark.range(n).withColumnRenamed("id", "customer_id").withColumn("id", F.col("customer_id"))
    df = df.withColumns({name: ((F.xxhash64("id", F.lit(name)) % 1000) / 100.0) for name in churn.ALL_FEATURES})
    return df.withColumn("Churn", (F.col("Tenure") + noise > 0).cast("int")).drop("id").coalesce(2)


@pytest.fixture(scope="module")
def fitted(spark):
    split = stratified_split(customers(spark)).persist()
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    return churn.fit_churn(train, churn.Variant(churn.ALL_FEATURES, 5, 3, 0.3)), train, test


def test_model_finds_the_feature_that_drives_the_label(spark, fitted):
    model, _, test = fitted
    found = churn.predict(model, test)
    assert metrics.roc_auc(found, label="Churn").first().auc > 0.85
    assert found.where("score < 0 OR score > 1 OR (prediction = 1) <> (score > 0.5)").count() == 0
    importance = churn.feature_importance(spark, model).collect()
    assert importance[0].feature == "Tenure" and sum(r.importance for r in importance) == pytest.approx(1)


def test_grid_reports_every_combination_and_refits_the_best(fitted):
    _, train, test = fitted
    result = churn.grid_search(train, features=("Tenure", "Monetary"), folds=2,
                               grid={"trees": (1, 3), "depth": (2,), "rate": (0.1,)})
    rows = result.table.collect()
    assert len(rows) == 2 and sum(r.selected for r in rows) == 1
    best = max(rows, key=lambda r: r.mean_auc)
    assert (result.best.trees, best.selected) == (best.trees, True)
    assert churn.predict(result.model, test).count() == test.count()


def test_first_trees_are_the_model_of_so_many_trees(fitted):
    _, train, test = fitted
    more, less = (churn.fit_churn(train, churn.Variant(churn.ALL_FEATURES, n, 2, 0.3)) for n in (4, 2))
    shorter = PipelineModel([more.stages[0], churn.first_trees(more.stages[1], 2)])
    def scores(model):
        return {r.customer_id: r.score for r in churn.predict(model, test).collect()}
    assert scores(shorter) == scores(less) != scores(more)


def test_model_with_the_leaking_feature_is_better(spark):
    df = customers(spark, 200).withColumn("Recency", F.when(F.col("Churn") == 1, 200).otherwise(5))
    split = stratified_split(df).persist()
    variants = {"with": churn.Variant(("Recency", "Monetary"), 2, 2, 0.3), "without": churn.Variant(("Monetary",), 2, 2, 0.3)}
    found = {r.model: r.accuracy for r in churn.leakage_check(
        split.where("split = 'train'"), split.where("split = 'test'"), variants).collect()}
    assert found["with"] == 1.0 > found["without"]


def test_stored_model_scores_a_stream_like_a_batch(spark, fitted, tmp_path):
    model, _, test = fitted
    models.save_model(model, str(tmp_path / "model"))
    loaded = models.load_model(str(tmp_path / "model"))
    requests = test.select(*churn.ALL_FEATURES)
    requests.repartition(3).write.parquet(str(tmp_path / "requests"))
    stream = scoring.request_stream(spark, str(tmp_path / "requests"), schemas.CHURN_REQUEST, files_per_batch=1)
    for _ in range(2):  # the second start finds nothing new
        scoring.churn_scores(stream, loaded, str(tmp_path / "scores"), str(tmp_path / "checkpoint")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "scores"))
    batch = churn.score_requests(model, requests).select(*streamed.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert set(streamed.columns) == {*churn.ALL_FEATURES, "churn_prediction", "churn_probability", "risk_level", "recommended_action"}


# --- segments ----------------------------------------------------------------------

def shoppers(spark):
    """Three plain groups of 40 customers."""
    rng = np.random.default_rng(5)
    rows = []
    for group, (r, f, m) in enumerate(((5, 20, 9000), (300, 1, 50), (40, 2, 300))):
        for i in range(40):
            rows.append((group * 40 + i, int(r + rng.integers(0, 4)), int(f + rng.integers(0, 2)), float(m + rng.integers(0, 30))))
    return spark.createDataFrame(rows, "customer_id long, Recency int, Frequency long, Monetary double").coalesce(2)


@pytest.fixture(scope="module")
def segmentation(spark):
    return segments.segment(shoppers(spark), ks=(2, 3, 4), restarts=2)


def test_number_of_clusters_and_personas(spark, segmentation):
    assert segmentation.k == 3
    assert [r.k for r in segmentation.scores.where("selected").collect()] == [3]
    labelled = segments.assign(segmentation, shoppers(spark))
    named = {r.customer_id: r.Persona for r in segments.customer_personas(labelled).collect()}
    assert len(named) == 120
    assert named[0] == "Champions" and named[45] == "Lost / Hibernating" and named[100] == "Average Customers"
    export = retail.crm_export(segments.customer_personas(labelled))
    assert export.columns == ["customer_id", "Recency", "Frequency", "Monetary", "Persona"]


def test_persona_rules_at_their_bounds(spark):
    rows = [(29.99, 5.01, 2000.01), (30.0, 5.01, 2000.01), (180.01, 2.0, 1.0), (180.0, 2.0, 1.0), (90.01, 5.01, 1.0),
            (59.99, 2.0, 1.0), (60.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "Recency double, Frequency double, Monetary double")
    assert [r.Persona for r in segments.with_persona(df).collect()] == [
        "Champions", "Average Customers", "Lost / Hibernating", "Average Customers", "At Risk (Loyal but inactive)",
        "Recent Customers", "Average Customers"]


def test_segment_names_and_the_unknown(spark):
    rows = spark.range(6).select(segment_name(F.col("id")).alias("n"), segment_description(F.col("id")).alias("d")).collect()
    assert [r.n for r in rows] == [name for _, name, _ in fixed.SEGMENTS] + ["Unknown", "Unknown"]
    assert rows[4].d == "" and rows[1].d == "Highest spend and frequency"


def test_mixture_gives_probabilities(spark):
    pipeline = segments.fit_mixture(shoppers(spark), 3)
    rows = segments.mixture_segments(pipeline, shoppers(spark)).collect()
    assert len(rows) == 120 and all(1 / 3 <= r.GMM_Confidence <= 1 + 1e-9 for r in rows)
    lowest = segments.borderline_customers(segments.mixture_segments(pipeline, shoppers(spark)), 2).collect()
    assert [r.GMM_Confidence for r in lowest] == sorted(r.GMM_Confidence for r in rows)[:2]


def test_segment_requests_on_a_stream(spark, tmp_path):
    df = shoppers(spark).withColumn("Tenure", F.col("Recency") * 2).select(
        "customer_id", *[F.col(c).cast("double").alias(c) for c in ("Frequency", "Monetary", "Tenure")])
    pipeline = segments.segment(df, ("Frequency", "Monetary", "Tenure"), log=False, ks=(3,), restarts=2).pipeline
    models.save_model(pipeline, str(tmp_path / "model"))
    df.drop("customer_id").write.parquet(str(tmp_path / "requests"))
    stream = scoring.request_stream(spark, str(tmp_path / "requests"), schemas.SEGMENT_REQUEST)
    scoring.segment_scores(stream, models.load_model(str(tmp_path / "model")), str(tmp_path / "scores"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "scores"))
    assert found.count() == 120 and {r.segment_id for r in found.collect()} == {0, 1, 2}


def test_cluster_metrics_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(150, 2)), np.append(rng.integers(0, 3, 149), 3)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, label))],
                               "customer_id long, a double, b double, label int")

    def brute(gaps):
        widths = []
        for i in range(len(x)):
            mine = label == label[i]
            if mine.sum() == 1:
                widths.append(0.0)
                continue
            inside = gaps[i, mine].sum() / (mine.sum() - 1)
            nearest = min(gaps[i, label == c].mean() for c in set(label) - {label[i]})
            widths.append((nearest - inside) / max(nearest, inside))
        return np.mean(widths)

    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    exact = cluster_metrics.silhouette_exact(df, ["a", "b"], "label", "customer_id", block_rows=40).first()
    assert exact.silhouette == pytest.approx(brute(gaps)) and exact.n == 150
    squared = cluster_metrics.silhouette_squared(df, ["a", "b"], "label").first()
    assert squared.silhouette == pytest.approx(brute(gaps ** 2)) and squared.measure == "squared_euclidean"
    centres = np.array([x[label == c].mean(0) for c in range(4)])
    spread = [np.sqrt(((x[label == c] - centres[c]) ** 2).sum(1)).mean() for c in range(4)]
    worst = [max((spread[i] + spread[j]) / np.sqrt(((centres[i] - centres[j]) ** 2).sum()) for j in range(4) if j != i) for i in range(4)]
    assert cluster_metrics.davies_bouldin(df, ["a", "b"], "label").first().davies_bouldin == pytest.approx(np.mean(worst))


def test_identical_customers_are_one_cluster(spark):
    alike = spark.createDataFrame([(i, 1, 2, 3.0) for i in range(30)], "customer_id long, Recency int, Frequency int, Monetary double")
    found = segments.segment(alike, ks=(2, 3), restarts=1)
    rows = found.scores.collect()
    assert [r.silhouette for r in rows] == [None, None] and [r.selected for r in rows].count(True) >= 1


def test_one_measure_at_every_size(spark):
    many = spark.range(21_000).selectExpr("id AS customer_id", "cast(id % 7 AS double) AS a", "cast(id % 2 AS int) AS label")
    assert cluster_metrics.silhouette_squared(many, ["a"], "label").first().measure == "squared_euclidean"
    assert cluster_metrics.silhouette_squared(many.limit(100), ["a"], "label").first().measure == "squared_euclidean"


def test_request_schema_follows_the_model():
    assert schemas.CHURN_REQUEST.names == list(churn.ALL_FEATURES)
