"""Queries over churn labels, scores and models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import recommended_action, risk_level
from basketry.operators import attribution, boosting, churn, metrics
from basketry.operators.sampling import stratified_split, with_folds
from basketry.plans.fitted import once
from basketry.plans.lines import churn_label, churn_table, rounded
from basketry.session import staged

FINAL = churn.VARIANTS["final"]


def _customers(spark, folder) -> DataFrame:
    return once(spark, folder, "churn-customers", lambda: staged(churn_table(spark, folder), "customers"))


def _split(spark, folder) -> DataFrame:
    return once(spark, folder, "churn-split", lambda: staged(stratified_split(_customers(spark, folder)), "split"))


def _train(spark, folder):
    return _split(spark, folder).where(F.col("split") == "train")


def _test(spark, folder):
    return _split(spark, folder).where(F.col("split") == "test")


def _final(spark, folder):
    return once(spark, folder, "churn-final", lambda: churn.fit_churn(_train(spark, folder), FINAL))


def stratified(spark, folder):
    return stratified_split(churn_label(spark, folder))


def folds(spark, folder):
    return with_folds(churn_label(spark, folder))


def scored_customers(spark, folder) -> DataFrame:
    """A score that no model made, with many ties, against the derived label."""
    score = (F.col("customer_id") * 37 % 101) / 100.0
    return churn_label(spark, folder).select(
        "customer_id", F.col("Churn").alias("label"), score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


def classification_metrics(spark, folder):
    return rounded(metrics.accuracy(scored_customers(spark, folder)), 8, "accuracy")


def classification_report(spark, folder):
    report = metrics.classification_report(scored_customers(spark, folder))
    return rounded(report, 8, "precision", "recall", "f1")


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(scored_customers(spark, folder))


def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored_customers(spark, folder)), 8, "auc")


def risk_bands(spark, folder):
    scored = scored_customers(spark, folder)
    return scored.withColumns({"risk_level": risk_level(F.col("score")),
                               "recommended_action": recommended_action(F.col("score"))})


def churn_predictions(spark, folder):
    """Predicted class and probability of every customer of the test part."""
    scored = churn.predict(_final(spark, folder), _test(spark, folder))
    return scored.select("customer_id", "Churn", "prediction", "score")


def _scored(spark, folder, name: str) -> DataFrame:
    model = once(spark, folder, f"churn-{name}", lambda: churn.fit_churn(_train(spark, folder), churn.VARIANTS[name]))
    return churn.predict(model, _test(spark, folder)).select("customer_id", "Churn", "prediction", "score")


def churn_challenger(spark, folder):
    return _scored(spark, folder, "challenger")


def churn_behaviour(spark, folder):
    return _scored(spark, folder, "behaviour")


def churn_all_features(spark, folder):
    return _scored(spark, folder, "all_features")


def churn_quality(spark, folder):
    """Accuracy and area under the ROC curve of the final model on the test part."""
    scored = staged(churn_predictions(spark, folder), "scored")
    quality = metrics.accuracy(scored, label="Churn")
    auc = metrics.roc_auc(scored, label="Churn")
    return quality.withColumn("auc", auc.scalar())


def churn_second_learner(spark, folder):
    """The challenger's parameters by trees grown best first, with 31 leaves at most."""
    variant = churn.VARIANTS["challenger"]

    def fitted():
        train = churn.weighted(_train(spark, folder)).withColumn("fold", F.lit(0))
        wanted = boosting.Boosting(variant.trees, variant.depth, variant.rate, leaves=31)
        return boosting.fit_all(train, variant.features, [wanted])[0][0]

    model = once(spark, folder, "churn-second", fitted)
    return boosting.predict(model, _test(spark, folder)).select("customer_id", "Churn", "prediction", "score")


def churn_grid(spark, folder):
    """The search over all 27 combinations on 5 folds."""
    return once(spark, folder, "churn-grid", lambda: boosting.search(
        churn.weighted(_train(spark, folder)), churn.ALL_FEATURES, churn.GRID)).table


def feature_importance(spark, folder):
    return churn.feature_importance(spark, _final(spark, folder))


def churn_contributions(spark, folder):
    return once(spark, folder, "churn-contributions",
                lambda: attribution.contributions(_final(spark, folder), _test(spark, folder)))


def contribution_summary(spark, folder):
    return attribution.contribution_summary(churn_contributions(spark, folder), churn.ALL_FEATURES)


def churn_scoring(spark, folder):
    """Scoring responses for all customers."""
    requests = _customers(spark, folder).select("customer_id", *churn.ALL_FEATURES)
    return churn.score_requests(_final(spark, folder), requests)


def leakage_check(spark, folder):
    variants = {name: churn.VARIANTS[name] for name in ("with_recency", "without_recency")}
    return once(spark, folder, "leakage", lambda: staged(churn.leakage_check(
        _train(spark, folder), _test(spark, folder), variants), "leakage"))


QUERIES = {
    "stratified_split": stratified,
    "cv_folds": folds,
    "classification_metrics": classification_metrics,
    "classification_report": classification_report,
    "confusion_matrix": confusion_matrix,
    "roc_auc": roc_auc,
    "risk_bands": risk_bands,
    "churn_predictions": churn_predictions,
    "churn_challenger": churn_challenger,
    "churn_second_learner": churn_second_learner,
    "churn_behaviour": churn_behaviour,
    "churn_all_features": churn_all_features,
    "churn_quality": churn_quality,
    "churn_grid": churn_grid,
    "feature_importance": feature_importance,
    "churn_contributions": churn_contributions,
    "contribution_summary": contribution_summary,
    "churn_scoring": churn_scoring,
    "leakage_check": leakage_check,
}
