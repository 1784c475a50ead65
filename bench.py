"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry.plans import fitted, registry  # noqa: E402
from basketry.session import build_session, staging  # noqa: E402

HEADLINE = [
    "clean_retail", "rfm_reference_date", "customer_features", "churn_label", "rfm_log_scaled", "recency_by_churn",
    "daily_sales", "top_products", "dense_daily_sales", "lag_windows", "minmax_scaled", "forecast_trend_weekday",
    "ensemble_select", "demand_horizon", "stratified_split", "roc_auc", "classification_report",
    "churn_challenger", "churn_contributions", "silhouette_squared", "davies_bouldin", "dbscan_segments",
    "kmeans_k_selection", "gmm_segments",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if "BENCH_CHECKPOINT_DIR" in os.environ:
        settings["spark.checkpoint.dir"] = os.environ["BENCH_CHECKPOINT_DIR"]
    else:
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = [name for name in (sys.argv[1:] or HEADLINE) if name in queries]
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executor
    seconds = {}
    for name in wanted:
        with staging(spark):  # every query builds what it needs by itself
            begun = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
        fitted.forget()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
