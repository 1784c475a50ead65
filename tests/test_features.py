import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import features
from basketry.sources import retail

DAY = dt.datetime(2020, 6, 30, 12)


def lines(spark, *rows):
    return spark.createDataFrame(
        list(rows), "customer_id long, invoice string, stockcode string, quantity int, total_amount double, invoicedate timestamp_ntz")


def before(days, hours=0):
    return DAY - dt.timedelta(days=days, hours=hours)


def sample(spark):
    return lines(
        spark,
        (1, "a", "x", 2, 10.0, before(100)), (1, "a", "y", 1, 5.5, before(100)), (1, "b", "x", 3, 4.5, before(89)),
        (2, "c", "x", 1, 1.0, before(0)), (3, "d", "z", None, None, before(88, 23)), (None, "e", "x", 1, 1.0, before(1)))


def test_features_of_one_customer(spark):
    row = {r.customer_id: r for r in features.customer_features(sample(spark)).collect()}
    one = row[1]
    assert set(row) == {1, 2, 3}
    assert (one.Recency, one.Frequency, one.Monetary, one.Churn) == (90, 2, 20.0, 1)
    assert (one.AvgOrderValue, one.TotalQuantity, one.UniqueProducts, one.Tenure) == (10.0, 6, 2, 11)
    assert one.AvgDaysBetweenPurchases == 5.5
    assert (row[2].Recency, row[2].Churn, row[2].Tenure) == (1, 0, 0)
    assert (row[3].Recency, row[3].Churn, row[3].Monetary, row[3].TotalQuantity) == (89, 0, 0, 0)


def test_labelled_lines_give_the_same_customers(spark):
    labelled = features.label_lines(sample(spark))
    assert labelled.count() == 5
    direct = features.rfm_labelled(sample(spark))
    assert sorted(map(tuple, features.rfm_from_labelled_lines(labelled).collect())) == sorted(map(tuple, direct.collect()))


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_features_survive_writing(spark, tmp_path, format):
    table = features.customer_features(sample(spark))
    retail.write_table(table, str(tmp_path / "features"), format)
    reader = spark.read.schema(table.schema).option("header", format == "csv")
    back = reader.format(format).load(str(tmp_path / "features"))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


def test_a_customer_without_invoices_has_no_ratios(spark):
    row = features.customer_features(lines(spark, (1, None, "x", 1, 2.0, before(1)))).first()
    assert row.Frequency == 0 and row.AvgOrderValue is None and row.AvgDaysBetweenPurchases is None


def test_rfm_leaves_out_customers_without_spending(spark):
    assert sorted(r.customer_id for r in features.rfm(sample(spark)).collect()) == [1, 2]


def test_class_counts_put_the_larger_class_first(spark):
    counts = [tuple(r) for r in features.churn_class_counts(features.churn_label(sample(spark))).collect()]
    assert counts == [(0, 2), (1, 1)]


def test_cutoff_separates_features_from_label(spark):
    table = features.customer_features_before(sample(spark), F.lit(before(95)).cast("timestamp_ntz"), 10)
    row = {r.customer_id: r for r in table.collect()}
    assert set(row) == {1} and (row[1].Frequency, row[1].Churn, row[1].Recency) == (1, 0, 5)


def test_description_per_class(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4), (1, 7)], "Churn int, Recency int")
    row = {r.Churn: r for r in features.describe_by(df, "Churn", "Recency").collect()}
    assert (row[0]["count"], row[0]["mean"], row[0]["q25"], row[0]["q50"], row[0]["q75"]) == (4, 2.5, 1.75, 2.5, 3.25)
    assert row[1]["std"] is None and row[1]["max"] == 7


def test_scaling_uses_the_population_and_keeps_constants_at_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = features.standardised(df, ["a", "b"], log=False).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
