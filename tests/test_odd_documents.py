"""Queries over documents with nulls against their SQL."""

import duckdb
from pyspark.sql import functions as F

from tessarium import registry

TABLE = "/root/testdata/sf0.001"


def test_a_changed_document_without_language_has_no_words(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    docs.withColumn("lang", F.when(F.col("doc_id") % 20 != 4, F.col("lang"))).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{TABLE}/benchmark.parquet").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = registry.QUERIES["bm25_index_refreshed"](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.SQL["bm25_index_refreshed"]).df()
    rows = lambda df: sorted(df[["query_id", "doc", "score", "rank"]].itertuples(index=False, name=None))
    assert rows(found) == rows(want)
