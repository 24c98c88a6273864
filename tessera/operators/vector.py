"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.functions.distance import cosine_distance
from tessera.functions.workers import workers_find_package

#: Bytes of query vectors that are broadcast at once; more are searched in several sets.
QUERY_BYTES = 64 << 20
SLACK = np.float32(1e-5)
#: Queries of one matrix product, and groups of columns for each neighbour sought.
CHUNK, GROUPS = 1024, 40


def knn(df: DataFrame, column: str, query, k: int, tie: str) -> DataFrame:
    """The k rows of ``df`` nearest to a literal vector, with ``distance``; ties by ``tie``. One scan, a top-k in each
    task, no shuffle of vectors. Rows without a vector are left out."""
    near = df.withColumn("distance", cosine_distance(column, query)).filter(F.col("distance").isNotNull())
    return near.orderBy("distance", tie).limit(k)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)  # zero vectors stay zero: cosine 0, distance 1


def _best(query: np.ndarray, row: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of each query by distance, then row id."""
    order = np.lexsort((row, np.round(distance, 12), query))
    query, row, distance = query[order], row[order], distance[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], row[keep], distance[keep]


def _edge(rough: np.ndarray, k: int) -> np.ndarray:
    """For each query (row) a cosine that at least k of its columns reach: the k-th greatest of the maxima of disjoint
    groups of columns, which is far cheaper than the k-th greatest of all and nearly as high."""
    columns, groups = rough.shape[1], GROUPS * k
    if columns >= 2 * groups:
        whole = columns // groups * groups
        most = rough[:, :whole].reshape(len(rough), -1, groups).max(axis=1)
        rough = np.concatenate([most, rough[:, whole:]], axis=1)
    top = rough.shape[1] - min(k, rough.shape[1])
    return np.partition(rough, top, axis=1)[:, top : top + 1]


def _nearer(held, q: np.ndarray, q32: np.ndarray, key: np.ndarray, near: np.ndarray, near32: np.ndarray, k: int):
    """(query, row id, distance) of the k best of each of the queries among ``held``, the same of earlier rows, and the
    unit vectors ``near``. Single precision finds who may be among the best (its error is far below SLACK), double
    decides."""
    rough = q32 @ near32
    cut = _edge(rough, k)
    if held is not None and len(held[0]) == k * len(q):  # the k-th best so far is an edge too
        cut = np.maximum(cut, (1 - held[2].reshape(len(q), k)[:, -1:]).astype(np.float32))
    may = rough >= cut - SLACK
    count = may.sum(axis=1)
    many = np.flatnonzero(count > 4 * k + 64)  # queries whose edge many equal vectors share, one by one
    may[many] = False
    at, j = np.divmod(np.flatnonzero(may), rough.shape[1])
    parts = [(at, key[j], 1 - np.clip(np.einsum("nd,nd->n", q[at], near[j]), -1, 1))]
    for t in many.tolist():
        top = len(key) - min(k, len(key))
        own = np.flatnonzero(rough[t] >= np.partition(rough[t], top)[top] - SLACK)
        parts.append(_best(np.full(len(own), t), key[own], 1 - np.clip(near[own] @ q[t], -1, 1), k))
    if held is not None:
        parts.append(held)
    return _best(*(np.concatenate(x) for x in zip(*parts)), k)


def _query_sets(queries: DataFrame, query_id: str, query_column: str, k: int = 0):
    """Broadcasts of (ids, unit vectors): the queries with a vector, in sets of ``QUERY_BYTES``, which is also the most
    that the k neighbours of a set's queries take."""
    rows = queries.filter(F.col(query_column).isNotNull()).select(query_id, F.col(query_column).cast("array<double>").alias("v"))
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v"))).first()
    if size[1] != size[2]:
        raise E.ValidationFailed("query vectors of several dimensions")
    per_set = max(1, QUERY_BYTES // (8 * max(1, size[1] or 0, 3 * k)))
    sets = -(-size[0] // per_set)
    for s in range(sets):
        chosen = rows if sets == 1 else rows.filter(F.pmod(F.xxhash64(query_id), F.lit(sets)) == s)
        got = chosen.toArrow().combine_chunks()
        if got.num_rows:
            ids = got.column(0).to_numpy().astype(np.int64)
            v = got.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield queries.sparkSession.sparkContext.broadcast((ids, _unit(v.reshape(len(ids), -1))))


def _block(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch of rows."""
    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(v) != b.num_rows * dim:
        raise ValueError(f"vectors of other than {dim} dimensions")
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _unit(v.reshape(b.num_rows, -1))


def distances_to(queries: DataFrame, query_id: str, query_column: str, base: DataFrame, base_id: str, base_column: str) -> DataFrame:
    """(query_id, base_id, distance) of every row of ``base`` to every one of the stated ``queries``.

    As in ``knn_batch`` queries are broadcast in sets of ``QUERY_BYTES`` and each batch of ``base`` is one matrix product
    with a block of them; nothing is shuffled. The result has a row for each pair. Null vectors are left out on both
    sides; ids are whole numbers.
    """
    workers_find_package(base.sparkSession)
    schema, parts = "query_id bigint, base_id bigint, distance double", None
    for held in _query_sets(queries, query_id, query_column):

        def run(batches, held=held):
            ids, q = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                key, near = _block(b, q.shape[1])
                step = max(1, (1 << 20) // len(key))
                for i in range(0, len(ids), step):
                    block = ids[i : i + step]
                    d = 1 - np.clip(q[i : i + step] @ near.T, -1, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, len(key))), pa.array(np.tile(key, len(block))), pa.array(d.ravel())], ["query_id", "base_id", "distance"])

        kept = base.filter(F.col(base_column).isNotNull()).select(base_id, base_column).mapInArrow(run, schema)
        parts = kept if parts is None else parts.unionByName(kept)
    return parts if parts is not None else base.sparkSession.createDataFrame([], schema)


def knn_batch(queries: DataFrame, query_id: str, query_column: str, base: DataFrame, base_id: str, base_column: str, k: int) -> DataFrame:
    """(query_id, base_id, distance, rank): the k nearest of ``base`` for each query.

    The stated set of queries meets all rows in blocks: queries are broadcast in sets of ``QUERY_BYTES``, each batch of
    ``base`` is one matrix product with a chunk of them, a task keeps its best k a query over all its batches, and the
    tasks' bests are merged by query. ``base`` isn't shuffled. Null vectors are left out on both sides, as are vectors
    with a null, NaN or infinite element; ids are whole numbers.
    """
    workers_find_package(base.sparkSession)
    schema = "query_id bigint, base_id bigint, distance double"
    parts = None
    for held in _query_sets(queries, query_id, query_column, k):

        def run(batches, held=held):
            ids, q = held.value
            q32 = q.astype(np.float32)
            best = [None] * -(-len(ids) // CHUNK)
            for b in batches:
                if not b.num_rows:
                    continue
                key, near = _block(b, q.shape[1])
                whole = np.isfinite(near).all(axis=1)
                key, near = key[whole], near[whole]
                if not len(key):
                    continue
                near32 = np.ascontiguousarray(near.astype(np.float32).T)
                for c in range(len(best)):
                    chunk = slice(c * CHUNK, (c + 1) * CHUNK)
                    best[c] = _nearer(best[c], q[chunk], q32[chunk], key, near, near32, k)
            for c, found in enumerate(best):
                if found is not None:
                    at, row, d = found
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c * CHUNK + at]), pa.array(row), pa.array(d)], ["query_id", "base_id", "distance"])

        kept = base.filter(F.col(base_column).isNotNull()).select(base_id, base_column).mapInArrow(run, schema)
        parts = kept if parts is None else parts.unionByName(kept)
    if parts is None:
        return base.sparkSession.createDataFrame([], schema + ", rank int")
    ranked = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "base_id")
    return parts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


class VectorSet:
    """Vectors with ids: search, search by type, insert and remove, as new frames."""

    def __init__(self, nodes: DataFrame, id_column: str = "id", vector_column: str = "vector"):
        self.nodes, self.id, self.vector = nodes, id_column, vector_column

    def search(self, query, k: int) -> DataFrame:
        return knn(self.nodes, self.vector, query, k, self.id)

    def search_by_type(self, query, k: int, kind, type_column: str = "node_type") -> DataFrame:
        return knn(self.nodes.filter(F.col(type_column) == kind), self.vector, query, k, self.id)

    def insert(self, rows: DataFrame) -> VectorSet:
        """With more rows; ids must be new."""
        if not rows.groupBy(self.id).count().filter("count > 1").isEmpty() or not rows.join(self.nodes.select(self.id), self.id, "left_semi").isEmpty():
            raise E.DuplicateExternalId(self.id)
        return VectorSet(self.nodes.unionByName(rows, allowMissingColumns=True), self.id, self.vector)

    def remove(self, *ids) -> VectorSet:
        found = {r[0] for r in self.nodes.filter(F.col(self.id).isin(*ids)).select(self.id).collect()}
        if missing := [i for i in ids if i not in found]:
            raise E.NodeNotFound(str(missing[0]))
        return VectorSet(self.nodes.filter(~F.col(self.id).isin(*ids)), self.id, self.vector)

    def get(self, node) -> DataFrame:
        """The rows of an id, or of a list of ids."""
        return self.nodes.filter(F.col(self.id).isin(*node) if isinstance(node, (list, tuple, set)) else F.col(self.id) == node)

    @staticmethod
    def load(spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "vector") -> VectorSet:
        """The vectors that ``save`` has written."""
        return VectorSet(spark.read.parquet(path), id_column, vector_column)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)
