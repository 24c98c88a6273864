import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.functions.distance import cosine_distance
from tessera.functions.embedder import hash_embedder, wyhash
from tessera.operators.graph import PropertyGraph
from tessera.operators.vector import VectorSet, knn_batch


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("a, b, d", [([1, 0], [1, 0], 0), ([1, 0], [0, 1], 1), ([1, 0], [-1, 0], 2), ([3, 4], [4, 3], 0.04), ([1, 2], [2, 4], 0), ([0, 0], [1, 2], 1)])
def test_distance(spark, a, b, d):
    row = spark.createDataFrame([([float(x) for x in a],)], "v array<float>").select(cosine_distance("v", b).alias("d")).first()
    assert row.d == pytest.approx(d, abs=1e-9)


def test_dimension_mismatch_raises(spark):
    with pytest.raises(Exception, match="dimensions"):
        spark.createDataFrame([([1.0],)], "v array<float>").select(cosine_distance("v", [1, 2])).collect()


def test_batch_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[7] = data[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, v array<float>").repartition(5)
    got = {}
    for r in knn_batch(df.filter("id < 9"), "id", "v", df, "id", "v", 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.base_id
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    for q in range(9):
        order = sorted(range(300), key=lambda i: (round(1 - unit[q] @ unit[i], 12), i))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == order


def test_batch_search_over_several_batches_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3000, 6)).astype(np.float32)
    data[rng.choice(3000, 600, replace=False)] = data[5]  # more equal vectors than the edge's limit
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(3000, [float("nan")] * 6), (3001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3002, None), (3003, [float("inf")] + [0.0] * 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        df = spark.createDataFrame(rows + odd, "id bigint, v array<float>").repartition(2)
        found = knn_batch(df.filter("id < 40 or id >= 3000"), "id", "v", df, "id", "v", 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = r.base_id
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    assert set(got) == set(range(40))
    for q in range(40):
        distance = np.round(1 - np.clip(unit @ unit[q], -1, 1), 12)
        assert [got[q][1], got[q][2]] == np.lexsort((np.arange(3000), distance))[:2].tolist()


def test_batch_search_with_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [float(i), 1.0]) for i in range(400)], "id bigint, v array<float>").repartition(3)
    got = sorted((r["rank"], r.base_id) for r in knn_batch(df.filter("id = 1"), "id", "v", df, "id", "v", 5).collect())
    assert got == [(1, 1), (2, 3), (3, 5), (4, 7), (5, 9)]


def test_vector_set(spark):
    v = VectorSet(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b")], "id bigint, vector array<float>, node_type string"))
    assert [r.id for r in v.search([1.0, 0.0], 2).collect()] == [1, 2]
    assert [r.id for r in v.search_by_type([1.0, 0.0], 2, "b").collect()] == [3]
    with pytest.raises(E.DuplicateExternalId):
        v.insert(v.nodes.limit(1))
    assert ids(v.remove(1).search([1.0, 0.0], 5)) == [2, 3]
    with pytest.raises(E.NodeNotFound):
        v.remove(99)


def graph(spark, *edges):
    nodes = sorted({n for e in edges for n in e[:2]})
    g = PropertyGraph.empty(spark).insert([{"id": n, "node_type": "t", "content_ref": f"f{n % 2}", "attributes": {"a": n, "b": "x", "c": True}} for n in nodes])
    return g.add_edges(spark.createDataFrame(list(edges), "src bigint, dst bigint, edge_type string, weight float"))


def test_edges(spark):
    g = graph(spark, (1, 2, "references", 0.8), (1, 3, "contains", 0.9), (2, 3, "references", 0.7))
    assert g.edges_of(1).count() == 2 and g.edges_of(1, "references").count() == 1
    assert g.remove_edge(1, 3, "contains").edges_of(1).count() == 1
    assert g.add_edge(1, 2, "references", 0.1).edges.filter("src = 1 and dst = 2").first().weight == pytest.approx(0.1)
    assert ids(g.neighbors(3)) == [1, 2] and g.incoming(3).count() == 2 and g.outgoing(1).count() == 2
    for call, error in ((lambda: g.add_edge(9, 1, "x"), E.SourceNodeNotFound), (lambda: g.add_edge(1, 9, "x"), E.DestinationNodeNotFound), (lambda: g.remove_edge(3, 1, "x"), E.EdgeNotFound), (lambda: g.remove_node(9), E.NodeNotFound)):
        with pytest.raises(error):
            call()
    assert g.remove_node(2).edges.count() == 1


def test_traversal(spark):
    g = graph(spark, (1, 2, "next", 1.0), (2, 3, "next", 1.0), (3, 4, "next", 1.0), (4, 4, "loop", 1.0), (4, 1, "back", 1.0))
    assert [len(ids(g.traverse(1, d, "next"))) for d in (0, 1, 3)] == [1, 2, 4]
    assert ids(g.traverse(1, 1)) == [1, 2, 4] and ids(g.traverse(1, 99)) == [1, 2, 3, 4]
    assert ids(g.neighbors(4, "loop")) == [4]


def test_metadata(spark, tmp_path):
    g = graph(spark, (1, 2, "x", 1.0))
    assert ids(g.nodes_by_path("f0")) == [2] and ids(g.nodes_by_type("t")) == [1, 2]
    assert g.nodes.filter("id = 1").select(F.col("attributes")["a"]["i"]).first()[0] == 1
    g = g.update_metadata(1, node_type="u", attributes={"z": 2.5})
    assert ids(g.nodes_by_type("u")) == [1] and g.nodes.filter("id = 1").select(F.col("attributes")["z"]["f"]).first()[0] == 2.5
    with pytest.raises(E.NodeNotFound):
        g.update_metadata(7, node_type="u")
    g.save(str(tmp_path / "g"))
    assert PropertyGraph.load(spark, str(tmp_path / "g")).edges.count() == 1


def test_search_then_traverse(spark):
    g = PropertyGraph.empty(spark).insert([{"id": i, "vector": v} for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.9, 0.1], [0.1, 0.9]], 1)])
    g = g.add_edge(1, 2, "related").add_edge(3, 4, "related")
    assert ids(g.search_then_traverse([1.0, 0.0], 2, None, 1)) == [1, 2, 3, 4]
    assert ids(g.search_then_traverse([1.0, 0.0], 2, "other", 3)) == [1, 3]


def test_embedder():
    v = hash_embedder("hello", 4)
    assert len(v) == 4 and all(0 <= x <= 1 for x in v) and v == hash_embedder("hello", 4)
    assert len({wyhash(b"x" * n) for n in range(100)}) == 100


def test_bulk_vectors_may_have_a_nullable_type_but_no_nulls(spark):
    from tessera.engine import Engine

    e = Engine(spark)
    e.execute("CREATE TABLE v (id int, v embedding(2))")
    good = spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "id bigint, v array<float>")
    assert e.insert_df("v", good) == 2 and e.table("v").filter("v is null").count() == 1
    with pytest.raises(Exception, match="none of them null"):
        e.insert_df("v", spark.createDataFrame([(3, [0.5, None])], "id bigint, v array<float>"))
