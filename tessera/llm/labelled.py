"""Bounded samples of labelled texts, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, fold, shared

#: Rows that a fit uses of each label value, of all values together, and bytes of their texts; everything else runs over
#: all rows.
ROWS_PER_LABEL = 4000
MAX_ROWS = 32_000
FIT_BYTES = 64 << 20
_PLACES = 1 << 30


def _place(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fit"), id_), F.lit(_PLACES))


def usable_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """_id, y of every label that a fit may see: none of the held-out fold, one of each id."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(column).alias("y")).filter(F.col("y").isNotNull() & F.col("_id").isNotNull() & (fold("_id", modulus) != held_out))
    return usable.groupBy("_id").agg(F.max("y").alias("y"))


def sampled(usable: DataFrame, rows: int) -> DataFrame:
    """Of rows with _id and y about ``rows`` of each value of y, and about MAX_ROWS of all: of many values fewer rows
    each, but never a value without any. A hash of the id chooses, so the sample is the same at every run."""
    counts = usable.groupBy("y").agg(F.count(F.lit(1)).alias("_n"), F.min(_place(F.col("_id"))).alias("_least"))
    values = counts.count()
    each = max(1, min(rows, MAX_ROWS // max(1, values)))
    chosen = usable.join(broadcast_if_small(counts, values), "y").filter((_place(F.col("_id")) * F.col("_n").cast("double") <= float(_PLACES * each)) | (_place(F.col("_id")) == F.col("_least")))
    return chosen.drop("_n", "_least")


def labels_for_fit(labels: DataFrame, column: str, modulus: int, held_out: int, rows: int = ROWS_PER_LABEL) -> DataFrame:
    """_id, y: about ``rows`` ids of each value of ``column``, none of the held-out fold. Null labels and ids are left
    out; of several labels of one id the greatest counts."""
    return sampled(usable_labels(labels, column, modulus, held_out), rows)


def texts_for_fit(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows: int = ROWS_PER_LABEL, lang: bool = False) -> DataFrame:
    """_id, y, text (and lang) of the labelled sample, whose rows are bounded, so its ids are broadcast; where its texts
    are of more than FIT_BYTES, a share of them, and none that alone has an eighth of that."""
    chosen = labels_for_fit(labels, column, modulus, held_out, rows)
    more = [F.col("lang")] if lang else []
    sample = shared(docs.select(F.col("doc_id").alias("_id"), F.col("text"), *more).join(F.broadcast(chosen), "_id"))
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    total = sample.agg(F.sum(size)).first()[0] or 0
    if total <= FIT_BYTES:
        return sample
    short = sample.filter(size <= FIT_BYTES // 8)
    total = max(FIT_BYTES, short.agg(F.sum(size)).first()[0] or 0)
    return short.filter(F.pmod(F.xxhash64(F.lit("bytes"), "_id"), F.lit(_PLACES)) * (total / FIT_BYTES) <= _PLACES)
