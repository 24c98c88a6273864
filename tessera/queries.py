"""The registered queries over the reference tables: each is a callable (spark, sf_dir) and, where SQL can say it, the
same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.errors import SerializationFailure
from tessera.functions.distance import cosine_distance
from tessera.functions.lineage import shared_folder
from tessera.operators.graph import PropertyGraph
from tessera.operators.vector import VectorSet, distances_to, knn, knn_batch
from tessera.sources.catalog import ROW_ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, tables: str, text: str, oracle: str | None = None, rounded: str = "") -> None:
    """A query in the engine's dialect. ``oracle`` defaults to the same text; ``rounded`` columns (sums to 2
    digits, means as ``name:6``) are cut, since sums of doubles depend on their order."""
    digits = {c.partition(":")[0]: int(c.partition(":")[2] or 2) for c in rounded.split()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(spark).register_parquet(sf_dir, *tables.split()).execute(text)
        return out.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else out

    QUERIES[name] = run
    if oracle != "":
        sql = oracle or text
        ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {n}) AS {c}' for c, n in digits.items())}) FROM ({sql})" if rounded else sql


def _query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# -- scans and projection
_sql("scan_star", "region", "SELECT * FROM region")
_sql("project_columns", "customer", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_sql("project_qualified", "customer", "SELECT c.c_name, c.c_custkey AS k FROM customer c", "SELECT c.c_name AS \"c.c_name\", c.c_custkey AS k FROM customer c")
_sql("project_literal", "region", "SELECT 1 AS one, r_name FROM region", "SELECT 1::bigint AS one, r_name FROM region")
_sql("index_exact", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
_sql("index_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000.0")
_sql("index_between", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 250")

# -- predicates
_sql("filter_eq", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("filter_neq", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'")
_sql("filter_range", "part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
_sql("filter_and_or", "part", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND p_retailprice > 1000.0")
_sql("filter_not", "part", "SELECT p_partkey FROM part WHERE NOT p_size = 7")
_sql("filter_in_list", "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3)")
_sql("filter_between", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 6")
_sql("filter_is_null", "documents labels", "SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
_sql("filter_is_not_null", "documents labels", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
_sql("like_prefix", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
_sql("like_suffix", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'")
_sql("like_infix", "documents", "SELECT doc_id FROM documents WHERE text LIKE '%License%'")
_sql("like_underscore", "part", "SELECT p_partkey FROM part WHERE p_name LIKE 'r_d %'")

# -- sorting and paging
_sql("order_asc", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
_sql("order_desc", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
_sql("order_multi", "customer", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment, c_custkey LIMIT 50")
_sql("order_hidden", "customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
_sql("order_nulls_whole", "documents labels", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id")
_sql("limit", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
_sql("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
_sql("offset_only", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 5")
_sql("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_sql("order_by_vibes", "nation", "SELECT n_name FROM nation ORDER BY VIBES LIMIT 7", "")

# -- aggregation
_sql("agg_count_star", "orders", "SELECT COUNT(*) AS n FROM orders")
_sql("agg_count_col", "documents labels", "SELECT COUNT(*) AS n_rows, COUNT(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("agg_sum", "orders", "SELECT SUM(o_totalprice) AS total FROM orders", rounded="total")
_sql("agg_avg", "orders", "SELECT AVG(o_totalprice) AS mean FROM orders", rounded="mean:6")
_sql("agg_min_max_num", "lineitem", "SELECT MIN(l_quantity) AS low, MAX(l_extendedprice) AS high FROM lineitem")
_sql("agg_min_max_text", "customer", "SELECT MIN(c_name) AS low, MAX(c_mktsegment) AS high FROM customer")
_sql("agg_empty_input", "orders", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0::double) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
_sql("agg_multi", "lineitem", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_discount) AS d, MIN(l_tax) AS t, MAX(l_tax) AS u FROM lineitem WHERE l_returnflag = 'R'", rounded="q d:6")
_sql("agg_default_names", "lineitem", "SELECT COUNT(*), MIN(l_quantity), MAX(l_quantity) FROM lineitem", 'SELECT count(*) AS "COUNT(*)", min(l_quantity) AS "MIN(l_quantity)", max(l_quantity) AS "MAX(l_quantity)" FROM lineitem')
_sql("group_by_one", "orders", "SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000.0 GROUP BY o_orderpriority ORDER BY o_orderpriority", rounded="total")
_sql("group_by_many", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_extendedprice) AS price, AVG(l_discount) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus", rounded="price disc:6")
_sql("group_by_null_key", "documents labels", "SELECT l.quality AS quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality")
_sql("group_where", "events", "SELECT event_type, COUNT(*) AS n, AVG(value) AS mean FROM events WHERE value > 10.0 GROUP BY event_type", rounded="mean:6")
_sql("group_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_sql("group_having_hidden", "orders", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000.0")
_sql("group_having_order_limit", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 5 ORDER BY COUNT(*) DESC, o_custkey LIMIT 15")

# -- joins
_sql("join_inner", "customer orders", "SELECT c.c_name AS c_name, o.o_orderkey AS o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey")
_sql("join_star", "nation region", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
_sql("join_left", "documents labels", "SELECT d.doc_id AS doc_id, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("join_right", "labels documents", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
_sql("join_3way", "customer orders nation", "SELECT o.o_orderkey AS o_orderkey, n.n_name AS n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
_sql("join_4way", "customer orders nation region", "SELECT r.r_name AS r_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
_sql("join_5way", "customer orders nation region lineitem", "SELECT r.r_name AS r_name, COUNT(*) AS n, SUM(l.l_extendedprice) AS price FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY r.r_name", rounded="price")
_sql("join_mixed_inner_left", "documents labels benchmark", "SELECT d.doc_id AS doc_id, b.item_id AS item_id, l.quality AS quality FROM documents d JOIN benchmark b ON d.doc_id = b.item_id LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("join_where_base", "customer orders", "SELECT o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'MACHINERY'")
_sql("join_where_joined", "customer orders", "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 250000.0 AND c.c_acctbal < 0.0")
_sql("join_order_page", "customer orders", "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20 OFFSET 5")
_sql("join_reversed_on", "customer orders", "SELECT o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
_sql("join_many_to_many", "supplier customer", "SELECT s.s_suppkey AS s_suppkey, c.c_custkey AS c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey")
_sql("join_group_by", "customer orders", "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, AVG(o.o_totalprice) AS mean FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", rounded="mean:6")
_sql("join_self", "nation", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")


def _with_null_keys(spark: SparkSession, sf_dir: str) -> Engine:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    engine = Engine(spark)
    engine.register("left_keys", docs.select("doc_id", F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("k")))
    return engine


@_query("WITH left_keys AS (SELECT doc_id, nullif(doc_id % 7, 0) AS k FROM documents) SELECT count(*) AS n FROM left_keys WHERE k IS DISTINCT FROM 3")
def two_valued_not_equal(spark, sf_dir):
    engine = _with_null_keys(spark, sf_dir)
    engine.options.null_semantics = "two_valued"
    return engine.execute("SELECT COUNT(*) AS n FROM left_keys WHERE k != 3")


# joins by ids of which some are null
_WHOLE_KEYS = "WITH left_keys AS (SELECT doc_id, CASE WHEN doc_id % 7 != 0 THEN doc_id END AS k FROM documents), right_keys AS (SELECT doc_id AS label_id, CASE WHEN doc_id % 5 != 0 THEN doc_id END AS k FROM labels) "


def _with_whole_keys(spark: SparkSession, sf_dir: str) -> Engine:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    engine = Engine(spark)
    engine.register("left_keys", docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("k")))
    engine.register("right_keys", labels.select(F.col("doc_id").alias("label_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("k")))
    return engine


@_query(_WHOLE_KEYS + "SELECT l.doc_id, r.label_id FROM left_keys l JOIN right_keys r ON l.k = r.k")
def join_null_keys_whole(spark, sf_dir):
    return _with_whole_keys(spark, sf_dir).execute("SELECT l.doc_id AS doc_id, r.label_id AS label_id FROM left_keys l JOIN right_keys r ON l.k = r.k")


@_query(_WHOLE_KEYS + "SELECT doc_id FROM left_keys l WHERE NOT EXISTS (SELECT 1 FROM right_keys r WHERE r.k = l.k)")
def not_in_with_nulls_whole(spark, sf_dir):
    return _with_whole_keys(spark, sf_dir).execute("SELECT doc_id FROM left_keys WHERE k NOT IN (SELECT k FROM right_keys)")


# -- subqueries
_sql("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000.0)")
_sql("in_subquery_where", "customer orders", "SELECT c_custkey FROM customer WHERE c_acctbal > 0.0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_sql("in_subquery_or", "customer orders", "SELECT c_custkey FROM customer WHERE c_acctbal < -500.0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
_sql("not_in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)")
_sql("not_over_in", "customer orders", "SELECT c_custkey FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0))")
_sql("exists_const", "region orders", "SELECT r_name FROM region WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100.0)")
_sql("not_exists_const", "region orders", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0.0)")
_sql("scalar_gt_avg", "part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
_sql("scalar_eq_max", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")
_sql("scalar_empty_null", "part", "SELECT p_partkey FROM part WHERE p_size > (SELECT MAX(p_size) FROM part WHERE p_size < 0)")
_sql("nested_in_2", "customer orders lineitem", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49.0))")
_sql("nested_in_3", "nation customer orders lineitem", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)))")
_sql("subquery_and_subquery", "customer orders nation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
_sql("subquery_in_join", "customer orders", "SELECT o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > (SELECT AVG(o_totalprice) FROM orders) AND c.c_mktsegment = 'BUILDING'")
_sql("subquery_in_having", "orders", "SELECT o_custkey, AVG(o_totalprice) AS mean FROM orders GROUP BY o_custkey HAVING AVG(o_totalprice) > (SELECT AVG(o_totalprice) FROM orders)", rounded="mean:6")

# -- vectors
_DISTANCE = "round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 6)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(_vectors(spark, sf_dir).filter(F.col("vec_id") == vec_id).first()["embedding"])


@_query(f"SELECT a.vec_id AS query_id, b.vec_id AS base_id, {_DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def cosine_to_set(spark, sf_dir):
    """The whole table against the stated set of vectors."""
    v = _vectors(spark, sf_dir)
    return distances_to(v.filter("vec_id % 50 = 0"), "vec_id", "embedding", v, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@_query(f"SELECT b.vec_id, {_DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY list_cosine_distance(a.embedding::double[], b.embedding::double[]), b.vec_id LIMIT 10")
def knn_exact(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), "embedding", _query_vector(spark, sf_dir, 3), 10, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@_query(f"SELECT b.vec_id, {_DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.label = 2 ORDER BY list_cosine_distance(a.embedding::double[], b.embedding::double[]), b.vec_id LIMIT 5")
def knn_by_type(spark, sf_dir):
    return knn(_vectors(spark, sf_dir).filter("label = 2"), "embedding", _query_vector(spark, sf_dir, 3), 5, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@_query(f"SELECT b.vec_id, {_DISTANCE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 11 AND b.vec_id >= 100 AND b.label != 4 ORDER BY list_cosine_distance(a.embedding::double[], b.embedding::double[]), b.vec_id LIMIT 25")
def knn_filtered(spark, sf_dir):
    return knn(_vectors(spark, sf_dir).filter("vec_id >= 100 and label != 4"), "embedding", _query_vector(spark, sf_dir, 11), 25, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@_query(f"SELECT query_id, base_id, distance, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS base_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id)::int AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10")
def knn_batch_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = knn_batch(v.filter("vec_id % 50 = 0"), "vec_id", "embedding", v, "vec_id", "embedding", 10)
    return found.select("query_id", "base_id", F.round("distance", 6).alias("distance"), "rank")


@_query("SELECT 1.0::double AS to_zero, round(list_cosine_distance([3.0::double, 4], [4.0::double, 3]), 6) AS near, 2.0::double AS opposite FROM region")
def zero_vector_distance(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    return rows.select(cosine_distance("z", [1.0, 0.0]).alias("to_zero"), F.round(cosine_distance("v", [4.0, 3.0]), 6).alias("near"), F.round(cosine_distance("v", [-3.0, -4.0]), 6).alias("opposite"))


_TEXT = [((i * 37) % 64) / 64 for i in range(64)]


@_query(f"SELECT vec_id FROM embeddings WHERE label != 5 ORDER BY list_cosine_distance(embedding::double[], {_TEXT}::double[]), vec_id LIMIT 10")
def similarity_text(spark, sf_dir):
    engine = Engine(spark, embedder=lambda text, dim: _TEXT[:dim])
    v = _vectors(spark, sf_dir)
    engine.register("embeddings", v.withMetadata("embedding", {"dim": 64}))
    return engine.execute("SELECT vec_id FROM embeddings WHERE label != 5 ORDER BY SIMILARITY TO 'any text'")


# -- graph: customers place orders, customers live in nations; nodes of documents by language and source
def _graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Node ids: customers as they are, nations 10^9 up, orders 2 * 10^9 up."""
    c, o, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "nation"))
    placed = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 2_000_000_000).alias("dst"), F.lit("placed").alias("edge_type"), F.lit(1.0).cast("float").alias("weight"))
    lives = c.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 1_000_000_000).cast("long").alias("dst"), F.lit("lives").alias("edge_type"), F.lit(0.5).cast("float").alias("weight"))
    none = [F.lit(None).cast("array<float>").alias("vector")]
    rest = [F.lit(None).cast("string").alias("content_ref"), F.lit(0).cast("bigint").alias("ts"), F.lit(None).cast("map<string, struct<s: string, i: bigint, f: double, b: boolean>>").alias("attributes")]
    nodes = c.select(F.col("c_custkey").alias("id"), *none, F.lit("customer").alias("node_type"), *rest)
    nodes = nodes.unionByName(n.select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), *none, F.lit("nation").alias("node_type"), *rest))
    nodes = nodes.unionByName(o.select((F.col("o_orderkey") + 2_000_000_000).alias("id"), *none, F.lit("order").alias("node_type"), *rest))
    return PropertyGraph(nodes, placed.unionByName(lives))


_EDGES = "edges AS (SELECT o_custkey AS src, o_orderkey + 2000000000 AS dst, 'placed' AS edge_type, 1.0::float AS weight FROM orders UNION ALL SELECT c_custkey, c_nationkey::bigint + 1000000000, 'lives', 0.5::float FROM customer)"


@_query(f"WITH {_EDGES} SELECT * FROM edges WHERE src = 42 OR dst = 42")
def graph_edges_of(spark, sf_dir):
    return _graph(spark, sf_dir).edges_of(42)


@_query(f"WITH {_EDGES} SELECT CASE WHEN src = 1000000003 THEN dst ELSE src END AS id FROM edges WHERE src = 1000000003 OR dst = 1000000003")
def graph_neighbors(spark, sf_dir):
    return _graph(spark, sf_dir).neighbors(1_000_000_003)


@_query(f"WITH {_EDGES} SELECT dst AS id FROM edges WHERE src = 42 AND edge_type = 'placed'")
def graph_neighbors_typed(spark, sf_dir):
    return _graph(spark, sf_dir).neighbors(42, "placed")


@_query(f"WITH {_EDGES} SELECT * FROM edges WHERE dst = 1000000007")
def graph_incoming(spark, sf_dir):
    return _graph(spark, sf_dir).incoming(1_000_000_007)


@_query(f"WITH {_EDGES} SELECT * FROM edges WHERE src = 42 AND edge_type = 'lives'")
def graph_outgoing(spark, sf_dir):
    return _graph(spark, sf_dir).outgoing(42, "lives")


def _bfs(depth: int, kind: str | None = None) -> str:
    only = f" WHERE edge_type = '{kind}'" if kind else ""
    return f"WITH RECURSIVE {_EDGES}, e AS (SELECT src, dst FROM edges{only} UNION ALL SELECT dst, src FROM edges{only}), r(id, depth) AS (SELECT 42::bigint, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < {depth}) SELECT id, min(depth)::int AS depth FROM r GROUP BY id"


for _d in range(4):
    QUERIES[f"bfs_depth{_d}"] = lambda spark, sf_dir, d=_d: _graph(spark, sf_dir).traverse(42, d)
    ORACLES[f"bfs_depth{_d}"] = _bfs(_d)


@_query(_bfs(3, "lives"))
def bfs_typed(spark, sf_dir):
    return _graph(spark, sf_dir).traverse(42, 3, "lives")


def _documents_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nodes = d.select(F.col("doc_id").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.col("lang").alias("node_type"), F.col("source").alias("content_ref"))
    return PropertyGraph(nodes, PropertyGraph.empty(spark).edges)


@_query("SELECT doc_id AS id FROM documents WHERE lang = 'fr'")
def nodes_by_type(spark, sf_dir):
    return _documents_graph(spark, sf_dir).nodes_by_type("fr")


@_query("SELECT doc_id AS id FROM documents WHERE source = 'src3'")
def nodes_by_path(spark, sf_dir):
    return _documents_graph(spark, sf_dir).nodes_by_path("src3")


def _vector_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Vectors as nodes, typed by label; each points to the one of twice its id and to the next but six."""
    v = _vectors(spark, sf_dir)
    nodes = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("node_type"))
    edges = v.select(F.col("vec_id").alias("src"), (F.col("vec_id") * 2).alias("dst"), F.lit("double").alias("edge_type")).unionByName(v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 7).alias("dst"), F.lit("next").alias("edge_type")))
    return PropertyGraph(nodes, edges.withColumn("weight", F.lit(1.0).cast("float")))


@_query("""WITH RECURSIVE q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3),
s AS (SELECT vec_id FROM embeddings, q WHERE label < 8 ORDER BY list_cosine_distance(embedding::double[], qv::double[]), vec_id LIMIT 5),
edges AS (SELECT vec_id AS src, vec_id * 2 AS dst FROM embeddings UNION ALL SELECT vec_id, vec_id + 7 FROM embeddings),
e AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
r(id, depth) AS (SELECT vec_id, 0 FROM s UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 2)
SELECT id, min(depth)::int AS depth FROM r GROUP BY id""")
def search_then_traverse(spark, sf_dir):
    """The flagship: filtered exact k-NN, then a graph expansion."""
    g = _vector_graph(spark, sf_dir)
    seeds = knn(g.nodes.filter("cast(node_type as int) < 8"), "vector", _query_vector(spark, sf_dir, 3), 5, "id").select("id")
    return g.traverse_from(seeds, 2)


# -- managed tables: the state after changes
def _managed(spark: SparkSession, sf_dir: str, **options) -> Engine:
    engine = Engine(spark, **options).register_parquet(sf_dir, "nation", "orders")
    engine.execute("CREATE TABLE cust (key int, name text, nation int, balance float)")
    engine.insert_df("cust", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return engine


_CUST = "SELECT c_custkey AS key, c_name AS name, c_nationkey::bigint AS nation, c_acctbal AS balance FROM customer"


@_query(f"{_CUST} UNION ALL SELECT 999999, 'New', NULL, 1.5")
def insert_visible(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("INSERT INTO cust (key, name, balance) VALUES (999999, 'New', 1.5)")
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT key, name, nation, CASE WHEN balance < 0 THEN 0.0 ELSE balance END AS balance FROM ({_CUST})")
def update_result(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("UPDATE cust SET balance = 0.0 WHERE balance < 0.0")
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT * FROM ({_CUST}) WHERE NOT (nation >= 10 AND nation <= 14)")
def delete_result(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("DELETE FROM cust WHERE nation >= 10 AND nation <= 14")
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT * FROM ({_CUST}) WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def delete_in_subquery(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("DELETE FROM cust WHERE key IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)")
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT key, name AS title, balance, CASE WHEN key <= 10 THEN 'first' END AS tier FROM ({_CUST})")
def alter_add_drop_rename(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in ("ALTER TABLE cust ADD COLUMN tier text", "ALTER TABLE cust DROP COLUMN nation", "ALTER TABLE cust RENAME COLUMN name TO title", "UPDATE cust SET tier = 'first' WHERE key <= 10"):
        e.execute(s)
    return e.execute("SELECT key, title, balance, tier FROM cust")


@_query(_CUST)
def rollback_invisible(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM cust WHERE key > 5", "UPDATE cust SET name = 'x'", "INSERT INTO cust (key) VALUES (-1)", "ROLLBACK"):
        e.execute(s)
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT key, name, nation, CASE WHEN nation = 3 THEN 7.5 ELSE balance END AS balance FROM ({_CUST}) WHERE nation != 4")
def vacuum_preserves(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in ("UPDATE cust SET balance = 7.5 WHERE nation = 3", "DELETE FROM cust WHERE nation = 4", "VACUUM cust"):
        e.execute(s)
    return e.execute("SELECT key, name, nation, balance FROM cust")


@_query(f"SELECT n.n_name AS n_name, count(*) AS n FROM ({_CUST}) c JOIN nation n ON c.nation = n.n_nationkey WHERE c.balance > 0 GROUP BY n.n_name")
def managed_join_external(spark, sf_dir):
    return _managed(spark, sf_dir).execute("SELECT n.n_name AS n_name, COUNT(*) AS n FROM cust c JOIN nation n ON c.nation = n.n_nationkey WHERE c.balance > 0.0 GROUP BY n.n_name")


@_query(f"SELECT count(*) AS n FROM ({_CUST}) WHERE nation = 5")
def index_query(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("CREATE INDEX by_nation ON cust (nation)")
    return e.index_query("by_nation", 5).agg(F.count(F.lit(1)).alias("n"))


# -- transactions, persistence and definitions
def _rooted(spark: SparkSession, sf_dir: str) -> Engine:
    """The customers in a managed table with a log, in the folder that all executors share."""
    engine = Engine(spark, root=f"{shared_folder(spark)}/db-{uuid.uuid4().hex}")
    engine.execute("CREATE TABLE cust (key int, name text, nation int, balance float)")
    engine.insert_df("cust", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return engine


_ALL = "SELECT key, name, nation, balance FROM cust"
_CHANGED = f"SELECT key, CASE WHEN nation = 2 THEN 'two' ELSE name END AS name, nation, balance FROM ({_CUST}) WHERE nation != 6"
_CHANGES = ("UPDATE cust SET name = 'two' WHERE nation = 2", "DELETE FROM cust WHERE nation = 6")


@_query(_CHANGED)
def commit_visible(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in ("BEGIN", *_CHANGES, "COMMIT"):
        e.execute(s)
    return e.execute(_ALL)


@_query(_CHANGED)
def own_changes_visible(spark, sf_dir):
    """Inside its transaction a session sees what it has changed."""
    e = _managed(spark, sf_dir)
    for s in ("BEGIN", *_CHANGES):
        e.execute(s)
    return e.execute(_ALL)


@_query(_CUST)
def snapshot_read(spark, sf_dir):
    """A transaction that began before another session's commits reads the state of its beginning."""
    e = _managed(spark, sf_dir)
    reader, writer = e.session(), e.session()
    reader.execute("BEGIN")
    for s in _CHANGES:
        writer.execute(s)
    return reader.execute(_ALL)


@_query(f"SELECT * FROM ({_CHANGED}) UNION ALL SELECT 0, 'lost', 1, 0.0")
def first_writer_wins(spark, sf_dir):
    """The second of two transactions that change one row fails, the first commits."""
    e = _managed(spark, sf_dir)
    first, second = e.session(), e.session()
    for s in (first, second):
        s.execute("BEGIN")
    for s in _CHANGES:
        first.execute(s)
    lost = 0
    try:
        second.execute("UPDATE cust SET name = 'mine' WHERE nation = 2")
    except SerializationFailure:
        lost = 1
    second.execute("ROLLBACK")
    first.execute("COMMIT")
    e.execute(f"INSERT INTO cust VALUES (0, 'lost', {lost}, 0.0)")
    return e.execute(_ALL)


@_query(_CHANGED)
def recovered_log(spark, sf_dir):
    """A new engine on the root of one that was never closed."""
    e = _rooted(spark, sf_dir)
    for s in ("BEGIN", *_CHANGES, "COMMIT", "BEGIN", "DELETE FROM cust WHERE key > 3"):
        e.execute(s)
    return Engine(spark, root=e.log.root).execute(_ALL)


@_query(_CHANGED)
def saved_and_loaded(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in _CHANGES:
        e.execute(s)
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    e.save(path)
    return Engine.load(spark, path).execute(_ALL)


@_query(f"SELECT * FROM ({_CHANGED}) UNION ALL SELECT 888888, 'b', 1, 2.0")
def two_engines(spark, sf_dir):
    """Two engines on one root: the second takes over what the first has published before its own commit."""
    a = _rooted(spark, sf_dir)
    b = Engine(spark, root=a.log.root)
    for s in _CHANGES:
        a.execute(s)
    b.execute("INSERT INTO cust VALUES (888888, 'b', 1, 2.0)")
    a.refresh()
    return a.execute(_ALL)


@_query("SELECT 'cust' AS name, 1 AS dropped, 0 AS indexes")
def drop_table_and_index(spark, sf_dir):
    e = _managed(spark, sf_dir)
    for s in ("CREATE INDEX by_nation ON cust (nation)", "CREATE INDEX by_key ON cust (key)", "DROP INDEX by_key", "DROP TABLE cust"):
        e.execute(s)
    return spark.createDataFrame([("cust", int("cust" not in e.tables), len(e.indexes))], "name string, dropped int, indexes int")


@_query(f"SELECT 'update' AS what, count(*) AS n FROM ({_CUST}) WHERE nation = 2 UNION ALL SELECT 'delete', count(*) FROM ({_CUST}) WHERE nation = 6")
def change_counts(spark, sf_dir):
    e = _managed(spark, sf_dir)
    return spark.createDataFrame([(w, e.execute(s).first()[0]) for w, s in zip(("update", "delete"), _CHANGES)], "what string, n bigint")


@_query(f"SELECT count(*) AS n, min(balance) AS low, max(balance) AS high FROM ({_CUST}) WHERE balance >= 100 AND balance <= 5000")
def index_range_query(spark, sf_dir):
    e = _managed(spark, sf_dir)
    e.execute("CREATE INDEX by_balance ON cust (balance)")
    ids = e.index_range("by_balance", 100.0, 5000.0)
    return e.table("cust").join(ids, ROW_ID, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.min("balance").alias("low"), F.max("balance").alias("high"))


_sql("filter_and_or_rows", "part", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND p_retailprice > 0.0")
_sql("truthy_column", "part", "SELECT p_partkey FROM part WHERE p_size", "SELECT p_partkey FROM part WHERE p_size <> 0")
_sql("compare_int_float", "part", "SELECT p_partkey FROM part WHERE p_size > 7.5 AND p_size < 20.5")


# -- writes to graphs and vector sets
@_query(f"WITH {_EDGES} SELECT * FROM edges WHERE NOT (src = 7 AND edge_type = 'lives') UNION ALL SELECT 1, 2, 'knows', 0.25::float UNION ALL SELECT 8, 1000000001, 'likes', 1.0::float")
def graph_edges_changed(spark, sf_dir):
    g = _graph(spark, sf_dir)
    lives = g.edges.filter("src = 7 and edge_type = 'lives'").first()
    g = g.add_edge(1, 2, "knows", 0.75).add_edge(1, 2, "knows", 0.25).add_edge(8, 1_000_000_001, "likes", 1.0)
    return (g.remove_edge(7, lives["dst"], "lives") if lives else g).edges


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN 'vip' ELSE 'customer' END AS node_type, CASE WHEN c_custkey = 5 THEN 'crm/5' END AS content_ref FROM customer WHERE c_custkey != 9 UNION ALL SELECT 777777777, 'guest', 'doc/1'")
def graph_nodes_changed(spark, sf_dir):
    g = _graph(spark, sf_dir).insert([{"id": 777_777_777, "vector": [0.5], "node_type": "guest", "content_ref": "doc/1", "attributes": {"age": 3}}])
    g = g.update_metadata(5, node_type="vip", content_ref="crm/5").remove_node(9)
    return g.nodes.filter("id < 1000000000").select("id", "node_type", "content_ref")


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (1, 4) UNION ALL SELECT 900000001")
def vector_insert_remove(spark, sf_dir):
    v = VectorSet(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    new = spark.createDataFrame([(900_000_001, [1.0] * 3)], "id bigint, vector array<float>")
    return v.insert(new).remove(1, 4).nodes.select("id")


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id < 10")
def vector_set_loaded(spark, sf_dir):
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    VectorSet(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).save(path)
    held = VectorSet.load(spark, path)
    return held.get(list(range(10))).select("id")
