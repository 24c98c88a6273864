"""Queries that read whole tables: no row is lost to a subset of ids or a cap on rows."""

from pyspark.sql import functions as F

from tessera.operators.vector import distances_to
from tessera.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_order_nulls_shows_nulls_and_all_else(spark):
    got = [r.quality for r in QUERIES["order_nulls_whole"](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    nulls = sum(x is None for x in got)
    assert 0 < nulls < len(got) and set(got[:nulls]) == {None} and got[nulls:] == sorted(got[nulls:])


def test_null_keys_reach_every_id(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect()}
    met = {i for i in docs & labels if i % 7 and i % 5}
    assert sorted(map(tuple, QUERIES["join_null_keys_whole"](spark, SF).collect())) == [(i, i) for i in sorted(met)]
    assert max(met) >= 60
    assert sorted(r.doc_id for r in QUERIES["not_in_with_nulls_whole"](spark, SF).collect()) == sorted(docs - met)


def test_distances_of_every_row_to_the_stated_set(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = QUERIES["cosine_to_set"](spark, SF)
    assert got.count() == n * -(-n // 50) == got.select("query_id", "base_id").distinct().count()
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, None), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>").repartition(2)
    want = {(a, b): d for a, b, d in [(1, 1, 0), (1, 2, 0.04), (1, 4, 1), (2, 1, 0.04), (2, 2, 0), (2, 4, 1), (4, 1, 1), (4, 2, 1), (4, 4, 1)]}
    for size in (1 << 20, 16):  # one set of queries, and one for each
        monkeypatch.setattr("tessera.operators.vector.QUERY_BYTES", size)
        rows = distances_to(v, "vec_id", "embedding", v, "vec_id", "embedding").collect()
        assert {(r.query_id, r.base_id): round(r.distance, 6) for r in rows} == want and len(rows) == len(want)
    assert distances_to(v.filter(F.col("embedding").isNull()), "vec_id", "embedding", v, "vec_id", "embedding").count() == 0
