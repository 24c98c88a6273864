"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when identical after deleting space and \\t \\n \\v \\f \\r. Pass one writes each row's digest and
builds, per task, one filter of the digests seen and one of those seen twice; merged, the second holds every digest
that occurs at least twice anywhere (two tasks that both saw a digest set its bits in both "seen" filters). Pass two
asks it: rows that it doesn't hold are certainly unique and pass straight through, only the others shuffle, by exact
SHA-256. The filter has at most ``max_bits`` bits, the only thing broadcast in proportion to the input; beyond that size
more unique rows shuffle too, as rows of about 100 bytes without their text, and results stay the same.

Defined cases: a null text counts as empty, and all empty texts are equal. Of equal texts the row with the most code
points stays, then the smallest doc_id (null last), then the first of repeated rows: exactly one row of each group.
An empty table gives an empty result; further columns of any name are ignored (``drop_exact_duplicates`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared

HASHES = 3
BITS_PER_ROW = 16
#: Bits of the filter at most: 128 MB, for 67 million rows at 16 bits each; a cluster with more memory can set more.
MAX_BITS = 1 << 30
SEGMENT_BYTES = 1 << 17
ROWS_PER_FILTER = 2_000_000
#: Groups of over one in HOT of the candidate rows (so fewer than HOT of them) are joined by broadcast.
HOT = 1000
_WHITE = b" \t\n\x0b\x0c\r"


def _digests(texts: pa.Array) -> tuple[list[bytes], pa.Array]:
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = [hashlib.sha256(x.translate(None, _WHITE)).digest() for x in texts.cast(pa.large_binary()).to_pylist()]
    return raw, pc.utf8_length(texts).cast(pa.int64())


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit positions, one row of HASHES for each 32-byte digest."""
    parts = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :HASHES]
    return (parts & np.uint64(bits - 1)).astype(np.int64)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), n_chars of every row, and a number that tells repeated rows apart."""

    def run(batches):
        for b in batches:
            raw, length = _digests(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), length], ["doc_id", "digest", "n_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, n_chars bigint")
    return out.withColumn("row", F.monotonically_increasing_id())


def repeated_filter(keys: DataFrame, rows: int, max_bits: int = MAX_BITS) -> bytes:
    """The merged filter of digests that occur at least twice among ``rows`` rows; never misses one."""
    bits = min(max_bits, max(1 << 16, 1 << (BITS_PER_ROW * rows - 1).bit_length())) if rows else 1 << 16
    size = min(SEGMENT_BYTES, bits // 8)

    def build(batches):
        seen, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            keys = b.column(0).to_pylist()
            for k in range(0, len(keys), 1 << 16):
                at = np.sort(_positions(keys[k : k + (1 << 16)], bits), axis=1)
                fresh = np.ones_like(at, bool)
                fresh[:, 1:] = at[:, 1:] != at[:, :-1]  # a row's own positions may coincide
                at, times = np.unique(at[fresh], return_counts=True)
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                again = (times > 1) | ((seen[byte] & bit) > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(seen, byte, bit)
        pack = zstandard.ZstdCompressor(level=1).compress
        for s in range(0, bits // 8, size):
            if seen[s : s + size].any():
                yield pa.RecordBatch.from_pydict({"segment": [s // size], "seen": [pack(seen[s : s + size].tobytes())], "twice": [pack(twice[s : s + size].tobytes())]})

    def merge(t: pa.Table) -> pa.Table:
        seen, twice, unpack = np.zeros(size, np.uint8), np.zeros(size, np.uint8), zstandard.ZstdDecompressor().decompress
        for a, b in zip(t.column("seen").to_pylist(), t.column("twice").to_pylist()):
            now = np.frombuffer(unpack(a), np.uint8)
            twice |= np.frombuffer(unpack(b), np.uint8) | (seen & now)
            seen |= now
        packed = zstandard.ZstdCompressor(level=1).compress(twice.tobytes())
        return pa.table({"segment": t.column("segment")[:1], "bits": pa.array([packed], pa.binary())})

    parts = keys.select("digest").coalesce(max(1, -(-rows // ROWS_PER_FILTER), min(keys.sparkSession.sparkContext.defaultParallelism, rows // 20_000)))
    merged = parts.mapInArrow(build, "segment bigint, seen binary, twice binary").groupBy("segment").applyInArrow(merge, "segment bigint, bits binary")
    out = bytearray(bits // 8)
    for segment, packed in merged.collect():  # at most max_bits / 8 bytes together
        part = zstandard.ZstdDecompressor().decompress(bytes(packed))
        out[segment * size : segment * size + len(part)] = part
    return bytes(out)


def _may_repeat(digests_: list[bytes], held: np.ndarray) -> np.ndarray:
    at = _positions(digests_, len(held) * 8)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1) if len(at) else np.zeros(0, bool)


def _rank():
    """Of equal texts the row with the least rank stays."""
    return F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))


def exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    spark = docs.sparkSession
    keys = shared(digests(docs))
    rows = keys.count()
    held = spark.sparkContext.broadcast(repeated_filter(keys, rows, max_bits))

    def flag(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            yield b.append_column("maybe", pa.array(_may_repeat(b.column("digest").to_pylist(), bits), pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    marked = keys.mapInArrow(flag, f"{fields}, maybe boolean")
    asked = marked.filter("maybe").drop("maybe")
    groups = shared(asked.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("best")).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    limit = max(HOT, (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT)
    hot, rest = groups.filter(F.col("group_size") > limit), groups.filter(F.col("group_size") <= limit)
    resolved = asked.join(F.broadcast(hot), "digest").unionByName(asked.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest"))
    alone = marked.filter("not maybe").drop("maybe").withColumns({"group_size": F.lit(1).cast("bigint"), "keep_id": F.col("doc_id"), "keep_row": F.col("row")})
    return resolved.unionByName(alone).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def drop_exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns; rows that are certainly unique aren't shuffled."""
    spark, columns = docs.sparkSession, docs.columns
    keys = shared(digests(docs).drop("row"))
    held = spark.sparkContext.broadcast(repeated_filter(keys, keys.count(), max_bits))
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = columns.index("text")

    def flag(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            raw, length = _digests(b.column(text))
            yield b.append_column("digest", pa.array(raw, pa.binary())).append_column("n_chars", length).append_column("maybe", pa.array(_may_repeat(raw, bits), pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    marked = inner.mapInArrow(flag, f"{fields}, digest binary, n_chars bigint, maybe boolean")
    doc = F.col(f"c{columns.index('doc_id')}")
    order = F.struct(-F.col("n_chars"), doc.isNull(), doc)
    best = marked.filter("maybe").groupBy("digest").agg(F.min_by(F.struct(*inner.columns), order).alias("best")).select("best.*")
    return marked.filter("not maybe").select(*inner.columns).unionByName(best).toDF(*columns)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
