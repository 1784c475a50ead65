"""Retail lines derived from a star schema of order, line, part, customer and nation tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = ("invoice", "stockcode", "description", "quantity", "invoicedate", "price",
                "customer_id", "country", "total_amount")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_lines(spark: SparkSession, folder: str, *columns: str, product: str = "l_partkey") -> DataFrame:
    """Clean lines with the asked `columns` (all by default), joining only the tables they need.

    `product` names the column that plays the stock code: a part key, brand or type.
    """
    columns = columns or LINE_COLUMNS
    wanted = set(columns)
    lines = table(spark, folder, "lineitem")
    if wanted & {"invoicedate", "customer_id", "country"}:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & {"description", "price", "total_amount"} or ("stockcode" in wanted and product != "l_partkey"):
        lines = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "country" in wanted:
        customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
        lines = (lines.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                 .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    quantity = F.col("l_quantity").cast("int")
    derived = {
        "invoice": lambda: F.col("l_orderkey").cast("string"),
        "stockcode": lambda: F.col(product).cast("string"),
        "description": lambda: F.col("p_name"),
        "quantity": lambda: quantity,
        "invoicedate": lambda: F.col("o_orderdate"),
        "price": lambda: F.col("p_retailprice"),
        "customer_id": lambda: F.col("o_custkey"),
        "country": lambda: F.col("n_name"),
        "total_amount": lambda: quantity * F.col("p_retailprice"),
    }
    return lines.select(*[derived[c]().alias(c) for c in columns])


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with planted gaps, returns, outliers and exact copies, to be cleaned."""
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation").select("n_nationkey", "n_name"),
              F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"),
              F.col("l_partkey") == F.col("p_partkey"))
    )

    def unless(hit, value):
        return F.when(~hit, value)

    quantity = F.col("l_quantity").cast("int")
    signed = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 5 == 0), -quantity)
              .otherwise(quantity * F.when(F.col("l_partkey") % 97 == 0, 40).otherwise(1)))
    copies = F.when(F.col("l_orderkey") % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return lines.select(
        F.col("o_orderkey").cast("string").alias("invoice"),
        F.col("l_partkey").cast("string").alias("stockcode"),
        unless(F.col("l_partkey") % 41 == 0, F.col("p_name")).alias("description"),
        unless(F.col("l_orderkey") % 19 == 0, signed).alias("quantity"),
        F.col("o_orderdate").alias("invoicedate"),
        unless(F.col("l_partkey") % 23 == 0, F.col("p_retailprice")).alias("price"),
        unless(F.col("o_custkey") % 17 == 0, F.col("o_custkey")).alias("customer_id"),
        unless(F.col("l_suppkey") % 29 == 0, F.col("n_name")).alias("country"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
