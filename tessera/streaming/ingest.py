"""Continuous ingest into managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.engine import Engine


def append_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch of ``stream`` to a managed table as one commit; start() it. The commit
    records the batch's number under the stream's ``name`` (its checkpoint folder, if none is given), so a batch that is
    replayed after a failure is appended once."""

    def write(batch: DataFrame, number: int) -> None:
        engine.insert_df(table, batch, batch=(name or checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
