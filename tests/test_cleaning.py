import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry import schemas
from basketry.functions import ordering
from basketry.functions.columns import exact_sum, half_even, whole_days
from basketry.functions.lookups import lookup
from basketry.operators import cleaning
from basketry.sources import retail


def line(invoice="1", code="A", text="thing", quantity=1, when=dt.datetime(2020, 1, 1, 10), price=1.0, who=1, where="a"):
    return (invoice, code, text, quantity, when, price, who, where)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_LINES)


def test_headers_are_tidied(spark):
    df = spark.createDataFrame([(1, 2)], [" Customer ID ", "InvoiceDate"])
    assert retail.tidy_headers(df).columns == ["customer_id", "invoicedate"]


def test_exact_copies_collapse_also_with_nulls(spark):
    df = lines(spark, *[line(text=None)] * 5, line(text=None, invoice="2"))
    assert cleaning.drop_copies(df).count() == 2


def test_median_fills_gaps(spark):
    df = lines(spark, *[line(invoice=str(i), price=p) for i, p in enumerate([1.0, 2.0, None, 100.0])])
    filled = cleaning.fill_median(df)
    assert sorted(r.price for r in filled.collect()) == [1.0, 2.0, 2.0, 100.0]


def test_median_between_two_values_stays_a_half(spark):
    df = lines(spark, line(quantity=1), line(quantity=2), line(quantity=None))
    assert sorted(r.quantity for r in cleaning.fill_median(df).collect()) == [1.0, 1.5, 2.0]


def test_mode_tie_goes_to_the_first_name(spark):
    df = lines(spark, *[line(where=w) for w in ("b", "a", "b", "a", "c", None)])
    assert sorted(r.country for r in cleaning.fill_country(df).collect()) == ["a", "a", "a", "b", "b", "c"]


def test_outlier_fences_and_their_switch(spark):
    df = lines(spark, *[line(quantity=q) for q in (1, 2, 3, 4, 5, 6, 1000)])
    assert sorted(r.quantity for r in cleaning.drop_outliers(df).collect()) == [1, 2, 3, 4, 5, 6]
    assert cleaning.drop_outliers(df, enabled=False).count() == 7


def test_order_of_cleaning_steps(spark):
    # the return counts in the median of prices, but not in the quartiles of quantities
    df = lines(spark, line(invoice="1", price=1.0), line(invoice="2", price=None), line(invoice="3", price=9.0, quantity=-5),
               line(invoice="4", price=7.0, who=None), line(invoice="5", price=2.0), line(invoice="5", price=2.0))
    clean = {r.invoice: r for r in cleaning.clean_lines(df).collect()}
    assert set(clean) == {"1", "2", "5"}
    assert clean["2"].price == 2.0 and clean["2"].total_amount == 2.0
    assert [f.name for f in cleaning.clean_lines(df).schema] == schemas.CLEAN_LINES.names
    assert [f.dataType for f in cleaning.clean_lines(df).schema] == [f.dataType for f in schemas.CLEAN_LINES]


def test_calendar_and_seconds(spark):
    df = lines(spark, line(when=dt.datetime(2020, 2, 29, 23, 59, 59, 900000)))
    row = cleaning.add_calendar(df).first()
    assert (row.year, row.month, row.day, row.day_of_week) == (2020, 2, 29, "Saturday")
    assert row.invoicedate == dt.datetime(2020, 2, 29, 23, 59, 59)


def test_time_zone_of_the_session_plays_no_part(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        moment = dt.datetime(2020, 3, 29, 2, 30, 0, 5)  # an hour that does not exist in that zone
        row = cleaning.add_calendar(lines(spark, line(when=moment))).withColumn(
            "days", whole_days("invoicedate", F.expr("TIMESTAMP_NTZ'2020-03-30 02:29:59'"))).withColumn(
            "back", whole_days(F.expr("TIMESTAMP_NTZ'2020-03-30 02:29:59'"), "invoicedate")).first()
        assert row.invoicedate == moment.replace(microsecond=0) and (row.days, row.back) == (0, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_null_profile_and_stage_counts(spark):
    df = lines(spark, line(), line(), line(invoice="2", who=None), line(invoice="3", quantity=-1), line(invoice="4"))
    assert {r.column: r.nulls for r in cleaning.null_profile(df).collect()}["customer_id"] == 1
    stages = {r.stage: (r.rows, r.columns) for r in cleaning.stage_counts(df).collect()}
    assert stages == {"loaded": (5, 8), "deduplicated": (4, 8), "with_customer": (3, 8), "positive": (2, 13),
                      "within_fences": (2, 13)}


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_clean_lines_survive_writing(spark, tmp_path, format):
    df = cleaning.clean_lines(lines(spark, line(), line(invoice="2", text='a "quoted", text'), line(invoice="3", text=None)))
    path = str(tmp_path / format)
    retail.write_lines(df, path, format)
    back = retail.read_clean_lines(spark, path, format).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_rounding_and_elapsed_days(spark):
    row = spark.sql("""SELECT TIMESTAMP_NTZ'2020-01-01 02:00:00' a, TIMESTAMP_NTZ'2020-01-03 01:00:00' b""").select(
        whole_days("a", "b").alias("days"), half_even(F.lit(0.125), 2).alias("r"), half_even(F.lit(0.375), 2).alias("s")).first()
    assert (row.days, row.r, row.s) == (1, 0.12, 0.38)


def test_sums_do_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e9, 0.25, None]
    up = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v")).alias("s")).first().s
    down = spark.createDataFrame([(v,) for v in values[::-1]], "v double").agg(exact_sum(F.col("v")).alias("s")).first().s
    assert up == down == 1000000001.25
    assert spark.createDataFrame([(None,)], "v double").agg(exact_sum(F.col("v")).alias("s")).first().s == 0


def test_fractions_are_summed_whole(spark):
    total = spark.sql("SELECT explode(array(0.25D, 0.0833325D, 0.5D)) AS v").agg(exact_sum(F.col("v")).alias("s")).first().s
    assert total == 0.8333325


def test_buckets_of_text_and_nan(spark):
    text = spark.range(500).selectExpr("concat('k', id) AS v", "1 AS g")
    placed = ordering.numbered(ordering.value_buckets(text, "v"), "_bucket", ["v"], ["g"]).orderBy("row").collect()
    assert [r.v for r in placed] == sorted(f"k{i}" for i in range(500))
    odd = spark.sql("SELECT explode(array(1D, 2D, 3D, double('NaN'), null)) AS v")
    assert ordering.quantiles(odd, "v", {"q": 0.5}).first().q == 2


def test_quantiles_with_one_value_holding_most_rows(spark):
    values = [5] * 700 + list(range(300))
    df = spark.createDataFrame([(v,) for v in values], "v int")
    row = ordering.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.999}).first()
    plain = df.agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a", 0.25), ("b", 0.5), ("c", 0.999))]).first()
    assert tuple(row) == pytest.approx(tuple(plain))


def test_quantiles_over_many_buckets(spark):
    df = spark.range(1001).select((F.col("id") * 37 % 1001 / 10).alias("v"), (F.col("id") % 3).alias("g"))
    found = {r.g: r.q for r in ordering.quantiles(df, "v", {"q": 0.3}, ["g"]).collect()}
    plain = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("q")).collect()}
    assert found == pytest.approx(plain)


def test_running_totals_across_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 2).alias("g"))
    placed = ordering.numbered(ordering.value_buckets(df, "v"), "_bucket", ["v"], ["g"]).collect()
    for g in (0, 1):
        rows = sorted((r for r in placed if r.g == g), key=lambda r: r.v)
        assert [r.row for r in rows] == list(range(1, 501)) and {r.rows for r in rows} == {500}


def test_lookup_is_a_join(spark):
    facts = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        small = lookup(facts, table, ["k"], how)
        large = facts.join(table, "k", how)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))


def test_ordinary_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("""Country,Customer ID, Price ,InvoiceDate,Quantity,Description,StockCode,Invoice
France,13085.0,2.5,2010-12-01 08:26:00.25,6,"a ""q"" , b",85123A,536365
Spain,,1,2010-12-02 09:00:00,-2,plain,22,C1
""")
    rows = {r.invoice: r for r in retail.read_lines(spark, str(tmp_path)).collect()}
    first = rows["536365"]
    assert (first.customer_id, first.description, first.quantity, first.price) == (13085, 'a "q" , b', 6, 2.5)
    assert first.country == "France" and first.invoicedate.microsecond == 250_000
    assert rows["C1"].customer_id is None and rows["C1"].quantity == -2


def test_bad_fields_fail_or_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("invoice,stockcode,description,quantity,invoicedate,price,customer_id,country\n"
                                    "1,a,b,six,2010-12-01 08:26:00,1.5,12.5,X\n2,a,b,1,soon,2,7,X\n")
    with pytest.raises(Exception, match="cannot hold"):
        retail.read_lines(spark, str(tmp_path)).collect()
    assert retail.read_lines(spark, str(tmp_path), bad_fields="null").where("quantity IS NULL").count() == 1
    counts = retail.count_bad_fields(spark, str(tmp_path)).first()
    assert (counts.quantity, counts.customer_id, counts.invoicedate, counts.price) == (1, 1, 1, 0)


def test_files_with_another_header_are_refused(spark, tmp_path):
    for name, header in (("a", "invoice,stockcode,description,quantity,invoicedate,price,customer_id,country"),
                         ("b", "stockcode,invoice,description,quantity,invoicedate,price,customer_id,country")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,2,d,1,2010-12-01 08:26:00,1,7,X\n")
    with pytest.raises(Exception):
        retail.read_lines(spark, str(tmp_path)).collect()
