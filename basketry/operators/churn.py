"""Churn models: boosted trees on customer features."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.columns import half_even, recommended_action, risk_level
from basketry.operators import metrics
from basketry.operators.sampling import with_folds
from basketry.session import shared_folder


@dataclass(frozen=True)
class Variant:
    """Features and boosting parameters of one model."""

    features: tuple[str, ...]
    trees: int
    depth: int
    rate: float


# --- fixed values: model variants ---------------------------------------------
ALL_FEATURES = ("Frequency", "Monetary", "AvgOrderValue", "TotalQuantity", "UniqueProducts", "Tenure",
                "AvgDaysBetweenPurchases")
VARIANTS = {
    "with_recency": Variant(("Recency", "Frequency", "Monetary"), 100, 4, 0.1),
    "without_recency": Variant(("Frequency", "Monetary"), 100, 4, 0.1),
    "behaviour": Variant(ALL_FEATURES[:5], 100, 4, 0.1),
    "challenger": Variant(ALL_FEATURES[:5], 200, 5, 0.05),
    "all_features": Variant(ALL_FEATURES, 200, 4, 0.05),
    "final": Variant(ALL_FEATURES, 100, 3, 0.03),
}
GRID = {"trees": (100, 200, 300), "depth": (3, 4, 5), "rate": (0.03, 0.05, 0.1)}


def weighted(customers: DataFrame, positive_weight: float = fixed.POSITIVE_WEIGHT) -> DataFrame:
    """Adds `label` as a double and `weight`, the higher one for churned customers."""
    return customers.withColumns({
        "label": F.col("Churn").cast("double"),
        "weight": F.when(F.col("Churn") == 1, positive_weight).otherwise(1.0)})


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def _learner(spark: SparkSession, trees: int, depth: int, rate: float, seed: int) -> GBTClassifier:
    shared_folder(spark)  # long boosting chains are checkpointed there
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, weightCol="weight",
                         checkpointInterval=50, cacheNodeIds=False)


def fit_churn(train: DataFrame, variant: Variant = VARIANTS["final"],
              positive_weight: float = fixed.POSITIVE_WEIGHT, seed: int = fixed.SPLIT_SEED) -> PipelineModel:
    """A saveable pipeline from the variant's feature columns to prediction and probability."""
    assembler = _assembler(variant.features)
    ready = assembler.transform(weighted(train, positive_weight)).select("features", "label", "weight")
    model = _learner(train.sparkSession, variant.trees, variant.depth, variant.rate, seed).fit(ready)
    return PipelineModel([assembler, model])


def predict(model: PipelineModel, customers: DataFrame) -> DataFrame:
    """Adds `prediction` (cut at 0.5) and `score`, the probability of churn."""
    scored = model.transform(customers)
    return (scored.withColumn("score", vector_to_array("probability").getItem(1))
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability"))


def score_requests(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Scoring response per request row: class, probability (3 digits), risk level and action.

    Row-wise, so it serves streams as well. The bands look at the unrounded probability.
    """
    scored = predict(model, requests)
    return scored.withColumns({
        "churn_prediction": F.col("prediction"),
        "churn_probability": half_even(F.col("score"), 3),
        "risk_level": risk_level(F.col("score")),
        "recommended_action": recommended_action(F.col("score")),
    }).drop("prediction", "score")


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Rows (feature, importance), the largest first; as many rows as the model has features."""
    assembler, trees = model.stages
    values = trees.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(assembler.getInputCols(), values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass(frozen=True)
class GridResult:
    best: Variant
    model: PipelineModel
    table: DataFrame


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model that boosting had after `n` trees; the seed of a tree does not depend on their number."""
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k, (tree, weight) in enumerate(zip(model._java_obj.trees()[:n], model.treeWeights)):
        trees[k], weights[k] = tree, weight
    shorter = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{n}", trees, weights))
    return shorter.setFeaturesCol(model.getFeaturesCol())


def grid_search(train: DataFrame, features: Sequence[str] = ALL_FEATURES,
                grid: Mapping[str, Sequence] = GRID, folds: int = fixed.FOLDS,
                positive_weight: float = fixed.POSITIVE_WEIGHT, seed: int = fixed.SPLIT_SEED,
                parallelism: int = 8) -> GridResult:
    """Every combination on stratified folds by area under the ROC curve; the best is fitted on all rows.

    Fewer trees are the first ones of more trees, so a fold is fitted once per depth and rate.
    `table` has one row per combination; the first of equal ones is selected.
    """
    assembler = _assembler(features)
    folded = with_folds(weighted(train, positive_weight), folds=folds, seed=seed)
    ready = assembler.transform(folded).select("features", "label", "weight", "fold").persist()
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")
    most = max(grid["trees"])

    def areas(task: tuple[int, int, float]) -> list[float]:
        fold, depth, rate = task
        model = _learner(train.sparkSession, most, depth, rate, seed).fit(ready.where(F.col("fold") != fold))
        held = ready.where(F.col("fold") == fold)
        return [evaluator.evaluate(first_trees(model, n).transform(held)) for n in grid["trees"]]

    fits = [(fold, depth, rate) for depth in grid["depth"] for rate in grid["rate"] for fold in range(folds)]
    try:
        ready.count()
        with ThreadPool(min(parallelism, len(fits))) as pool:
            found = dict(zip(fits, pool.map(inheritable_thread_target(train.sparkSession)(areas), fits, chunksize=1)))
        rows = [(trees, depth, float(rate), sum(found[fold, depth, rate][k] for fold in range(folds)) / folds)
                for k, trees in enumerate(grid["trees"]) for depth in grid["depth"] for rate in grid["rate"]]
        best = max(rows, key=lambda row: row[3])
        trees, depth, rate, _ = best
        model = _learner(train.sparkSession, trees, depth, rate, seed).fit(ready.drop("fold"))
    finally:
        ready.unpersist()
    table = train.sparkSession.createDataFrame(
        [(*row, row is best) for row in rows],
        "trees int, depth int, rate double, mean_auc double, selected boolean")
    return GridResult(Variant(tuple(features), trees, depth, rate), PipelineModel([assembler, model]), table)


def leakage_check(train: DataFrame, test: DataFrame, variants: Mapping[str, Variant], parallelism: int = 4) -> DataFrame:
    """Rows (model, accuracy, n): the same customers scored by models with and without the leaking feature.

    The models are fitted side by side: one's tasks run while another's driver chooses its splits.
    """
    def fit(variant: Variant) -> PipelineModel:
        return fit_churn(train, variant)

    with ThreadPool(max(1, min(parallelism, len(variants)))) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(fit), variants.values(), chunksize=1)
    results = None
    for name, model in zip(variants, models):
        row = metrics.accuracy(predict(model, test), label="Churn").withColumn("model", F.lit(name))
        results = row if results is None else results.unionByName(row)
    return results.select("model", "accuracy", "n")
