"""Registered queries against SQL, and the pipeline against plain rules, on the smallest tables."""

import corpus_pipeline
import duckdb
import pytest

from basketry.llm import queries
from basketry.llm.quality_rules import features_of

from test_operators import classes


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, folder, name):
    rows = queries.queries()[name](spark, folder)
    names = sorted(rows.columns)
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path_rows = stage(spark, docs, folder)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        path_rows.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        old = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        if name != "packed":
            assert after.columns == before.columns
            new = {r["doc_id"]: r["text"] for r in after.collect()}
            assert set(new) <= set(old) and after.where("n_chars != length(text)").count() == 0
        if name == "quality":
            for k, t in old.items():
                n, repeated = features_of(t)[0], features_of(t)[5]
                assert k not in new or (n >= 10 and 100 * repeated <= 20 * n)
            assert len(new) > 0.7 * len(old)
        if name == "near_duplicates":
            assert set(new) == {k for k, v in classes(old).items() if v[1] == k}
        if name == "packed":
            assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(old)
            assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
        docs = after
