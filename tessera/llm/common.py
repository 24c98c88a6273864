"""Session helpers shared by the operators."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut_lineage
from tessera.functions.workers import workers_find_package

#: Rows of a table that may be broadcast; every table that is broadcast is counted against it first.
BROADCAST_ROWS = 200_000


def shared(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the one in ``spark.checkpoint.dir``; a local one is set only where none is (as in tests). The
    files outlive lost executors, and later stages restart from them.
    """
    return cut_lineage(df)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured size ``rows`` is within the bound, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(expr: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(expr).cast("string").cast("binary")) % modulus


__all__ = ["broadcast_if_small", "fold", "shared", "table", "workers_find_package"]
