"""Versioned tables: immutable parts, read as of a version.

A part is rows that one statement wrote: new rows, new versions of rows (which hide older versions of the same row id)
or ids of deleted rows. Its ``seq`` orders statements. A row version is live if no part with a later seq hides its id;
that is one anti-join on the row id, left out where nothing is hidden. Small parts are kept as values and read through
one local relation; large ones are Parquet segments (or checkpointed frames, in an engine without a folder).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID, SEQ = "_row_id", "_seq"
SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(), "embedding": T.ArrayType(T.FloatType(), True)}


@dataclass
class ColumnDef:
    """``key`` names the column in stored rows for good; ``name`` may change."""

    key: str
    name: str
    kind: str
    dim: int | None = None


@dataclass
class Part:
    kind: str  # insert, update, delete
    seq: int
    count: int
    rows: list[dict[str, Any]] | None = None  # by column key, with the row id
    path: str | None = None
    frame: DataFrame | None = field(default=None, compare=False)
    version: int = 0  # the commit that published it; 0 while its transaction runs

    def plain(self) -> dict:
        return {"kind": self.kind, "seq": self.seq, "count": self.count, "rows": self.rows, "path": self.path, "version": self.version}


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    next_row: int = 1
    next_key: int = 0
    parts: list[Part] = field(default_factory=list)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    def add(self, name: str, kind: str, dim: int | None) -> None:
        self.columns.append(ColumnDef(f"c{self.next_key}", name, kind, dim))
        self.next_key += 1

    def stored_schema(self, keys: set[str] | None = None) -> T.StructType:
        held = [T.StructField(c.key, SPARK_TYPES[c.kind]) for c in self.columns if keys is None or c.key in keys]
        return T.StructType([T.StructField(ROW_ID, T.LongType()), *held])

    def plain(self) -> dict:
        return {"name": self.name, "columns": [vars(c) for c in self.columns], "next_row": self.next_row, "next_key": self.next_key, "parts": [p.plain() for p in self.parts]}

    @staticmethod
    def of(d: dict) -> Table:
        return Table(d["name"], [ColumnDef(**c) for c in d["columns"]], d["next_row"], d["next_key"], [Part(**p) for p in d["parts"]])

    # -- reading
    def _frame(self, spark: SparkSession, parts: list[Part], ids_only: bool = False) -> DataFrame | None:
        """Stored rows of the parts with their seq; columns that a part lacks are null."""
        schema = T.StructType([T.StructField(ROW_ID, T.LongType())]) if ids_only else self.stored_schema()
        names = schema.names
        local = [(*(r.get(n) for n in names), p.seq) for p in parts if p.rows is not None for r in p.rows]
        frames = [spark.createDataFrame(local, T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())]))] if local else []
        for p in parts:
            if p.rows is None:
                df = p.frame if p.frame is not None else spark.read.parquet(p.path)
                frames.append(df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(p.seq).cast("long").alias(SEQ)))
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def versions(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        """All row versions, by column keys."""
        out = self._frame(spark, [p for p in parts if p.kind != "delete"])
        return out if out is not None else spark.createDataFrame([], T.StructType([*self.stored_schema().fields, T.StructField(SEQ, T.LongType())]))

    def live(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        """Live rows as of these parts, by column keys, with the row id."""
        rows = self.versions(spark, parts)
        hiding = [p for p in parts if p.kind != "insert"]
        if hiding:
            hidden = self._frame(spark, hiding, ids_only=True).groupBy(ROW_ID).agg(F.max(SEQ).alias("_hidden")).withColumnRenamed(ROW_ID, "_id")
            rows = rows.join(hidden, (F.col(ROW_ID) == F.col("_id")) & (F.col("_hidden") > F.col(SEQ)), "left_anti")
        return rows.drop(SEQ)

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(ROW_ID, *[F.col(c.key).alias(c.name) for c in self.columns])
