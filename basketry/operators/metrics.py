"""Metrics of forecasts and of binary classifications, as aggregations over prediction rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import share_error
from basketry.functions.ordering import histogram, running_total, value_buckets


def mape(forecasts: DataFrame, by: Sequence[str] = ("stockcode",), actual: str = "quantity",
         forecast: str = "forecast") -> DataFrame:
    """Mean absolute error as a fraction of the actual, over rows with a non-zero actual; 0 if none."""
    error = share_error(F.col(actual), F.col(forecast))
    return forecasts.groupBy(*by).agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("mape"))


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows (actual, predicted, n) of the pairs that occur."""
    return predictions.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows (actual, predicted, n) for every pair of `classes`, 0 where none occurs."""
    hit = {(a, p): F.count_if((F.col(label) == a) & (F.col(prediction) == p)) for a in classes for p in classes}
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), count.alias("n"))
        for (a, p), count in hit.items()])
    return predictions.agg(cells.alias("cells")).select(F.inline("cells"))


def accuracy(predictions: DataFrame, by: Sequence[str] = (), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    right = (F.col(label) == F.col(prediction)).cast("double")
    return predictions.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    A ratio 0/0 counts as 0. Everything after the first aggregation works on classes x classes rows.
    """
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), n.alias("support"), F.lit(0).alias("claimed"), F.lit(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("support"), n.alias("claimed"),
                 F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("hits")))
    classes = (confusion_counts(predictions, label, prediction).select(F.inline(sides)).groupBy("class")
               .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")]))

    def ratio(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    precision, recall = ratio(F.col("hits"), F.col("claimed")), ratio(F.col("hits"), F.col("support"))
    scored = classes.select(
        F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "support", "hits")
    means = scored.agg(
        F.sum("support").alias("support"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
          for c in ("precision", "recall", "f1")])
    summary = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(c) for c in ("precision", "recall", "f1")],
                 F.col("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("class"),
                   *[F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("support"))
          for kind in ("macro", "weighted")])
    return scored.drop("hits").unionByName(means.select(F.inline(summary)))


def roc_auc(predictions: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve, tied scores counted half; null if a class is missing.

    Scores are first counted per distinct value; every value then needs only the number of
    negatives below it, a running total that no single task has to sort.
    """
    counted = histogram(predictions.where(F.col(label).isNotNull()), score,
                        positives=F.count_if(F.col(label) == 1), negatives=F.count_if(F.col(label) != 1))
    ranked = running_total(value_buckets(counted, score), "_bucket", [score], "negatives")
    below = F.col("upto") - F.col("negatives")
    wins = F.sum(F.col("positives") * (below + F.col("negatives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("auc"))
