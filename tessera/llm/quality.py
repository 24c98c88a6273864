"""Quality classifier: hashed word n-grams, logistic regression with follow-the-regularised-leader updates.

A text's tokens are runs of word bytes (letters, digits, anything beyond ASCII) and runs of other visible bytes. Its
n-grams are the tokens, pairs of tokens, and the same over token shapes (case, digits, the sign itself, "same token
again"), hashed to ``1 << BITS`` weights. A text's score is the logistic of a bias plus a sparse dot product: the mean
weight of its n-grams, words and shapes apart. Weights are learnt by FTRL-proximal on a sample of at most about
``labelled.ROWS_PER_LABEL`` rows a label (a hash of the id decides), whose feature rows alone reach the driver; scoring
reads whole texts, in pieces, with the weights (2 MB) broadcast.

Defined cases: null, empty and blank texts score the bias alone; without usable labels all scores are 0.5; rows that
repeat are scored alike; an empty table gives an empty result; all input columns stay and a clashing name is replaced
by the operator's own column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.common import fold
from tessera.llm.labelled import ROWS_PER_LABEL, texts_for_fit

BITS = 18
SCALE = 8.0
EPOCHS = 4
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = ~_WORD & (np.arange(256) > 32) & (np.arange(256) != 127)
_UPPER, _LOWER, _DIGIT = (np.array([a <= i <= b for i in range(256)]) for a, b in ((65, 90), (97, 122), (48, 57)))


#: Gap, word or sign, by byte; tokens never cross a change of kind.
_KIND = _WORD + 2 * _SIGN.astype(np.int8)
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of words and of shapes, shapes before "same token again" is told, and each text's first token."""
    kinds = [tv.bounds(raw, at, ~_WORD)[:2], tv.bounds(raw, at, ~_SIGN)[:2]]
    starts, ends = (np.concatenate([k[i] for k in kinds]) for i in (0, 1))
    is_word = np.zeros(len(starts), bool)
    is_word[: len(kinds[0][0])] = True
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], is_word[order]
    first = np.searchsorted(starts, at, "left")
    word = tv.spans(raw, starts, ends, lower=True)
    count = lambda kind: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)]))
    upper, lower, digit, size = count(_UPPER), count(_LOWER), count(_DIGIT), ends - starts
    shape = np.where(upper == 0, 1, np.where((lower == 0) & (size > 1), 2, 3)) + np.where(digit > 0, 4, 0)
    shape = np.where(is_word, shape.astype(np.uint64), word)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    return word, tv.mix(shape + np.where(again, _AGAIN, np.uint64(0))), shape, first


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words and of shapes, and each text's first of either; one more at the end."""
    raw, at = tv.buffer(texts)
    word, shape, _, first = tokens(raw, at)
    out = []
    for values in (word, shape):
        pairs = tv.runs(values, 2, 3)
        inner = tv.inside(first, 2)
        doc = np.searchsorted(first, np.arange(len(values)), "right") - 1
        all_values = np.concatenate([values, pairs[inner]])
        all_docs = np.concatenate([doc, doc[inner]])
        order = np.argsort(all_docs, kind="stable")
        out += [(all_values[order] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(all_docs[order], np.arange(len(at)))]
    return out[0], out[1], out[2], out[3]


def _rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse feature rows (indexes, values)."""
    word, w_first, shape, s_first = ngrams(texts)
    out = []
    for i in range(len(w_first) - 1):
        parts = [x[f[i] : f[i + 1]] for x, f in ((word, w_first), (shape, s_first))]
        keys = [np.unique(p, return_counts=True) for p in parts]
        out.append((np.concatenate([k for k, _ in keys]).astype(np.int32), np.concatenate([SCALE * c / max(1, c.sum()) for _, c in keys]).astype(np.float32)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in tv.slices(texts):
            if j == i + 1:
                raw, _ = tv.buffer(texts.slice(i, 1))
                if len(raw) > 2 * tv.PIECE:
                    out[i] = self._of_long(raw)
                    continue
            word, w_first, shape, s_first = ngrams(texts.slice(i, j - i))
            for x, first in ((word, w_first), (shape, s_first)):
                n = np.diff(first)
                held = np.flatnonzero(n)
                if len(held):
                    out[i + held] += SCALE * np.add.reduceat(self.weights[x].astype(np.float64), first[:-1][held]) / n[held]
        # rounded, so that equal texts score alike wherever in a batch they stand
        return 1 / (1 + np.exp(-np.clip(np.round(out + self.bias, 6), -30, 30)))


    def _of_long(self, raw: np.ndarray) -> float:
        """The same sum for one long text, piece by piece; the last token of a piece goes on into the next."""
        total, count, last = np.zeros(2), np.zeros(2, np.int64), None
        for a, b in tv.pieces(raw, _KIND):
            word, shape, plain, _ = tokens(raw[a:b], np.array([0, b - a]))
            if not len(word):
                continue
            if last is not None and word[0] == last[0]:
                shape[0] = tv.mix(plain[:1] + _AGAIN)[0]
            for k, values in enumerate((word, shape)):
                pairs = tv.runs(values if last is None else np.concatenate([[last[k]], values]), 2, 3)
                for x in (values, pairs):
                    total[k] += self.weights[(x >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.float64).sum()
                    count[k] += len(x)
            last = word[-1], shape[-1]
        return float(sum(SCALE * t / n for t, n in zip(total, count) if n))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """FTRL-proximal: each coordinate keeps z and n; its weight follows from them when it is next needed."""
    size = (1 << BITS) + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = np.append(rows[k][0], size - 1), np.append(rows[k][1], 1.0)
            i, where = np.unique(i, return_inverse=True)
            x = np.bincount(where, weights=x)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = ROWS_PER_LABEL) -> Model:
    sample = texts_for_fit(docs, labels.filter(F.col(column).isin(0, 1)), column, modulus, held_out, rows)

    def features(batches):
        for b in batches:
            texts = b.column("text")
            for i, j in tv.slices(texts):
                got = _rows(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, j - i).cast(pa.string()), b.column("y").slice(i, j - i).cast(pa.float64()), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["id", "y", "at", "x"])

    got = sorted(sample.mapInArrow(features, "id string, y double, at binary, x binary").collect(), key=lambda r: r.id)
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    return ftrl(data, np.array([r["y"] for r in got])) if data else Model(np.zeros(1 << BITS, np.float32), 0.0)


def with_scores(docs: DataFrame, model, threshold: float) -> DataFrame:
    """``docs`` with score and predicted; the texts are read once, in place. ``model``: anything with scores(texts)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at, held = names.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = held.value.scores(b.column(at))
            yield b.append_column("score", pa.array(score, pa.float64())).append_column("predicted", pa.array((score >= threshold).astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    return inner.mapInArrow(run, f"{fields}, score double, predicted int").toDF(*names, "score", "predicted")


def held_out_column(modulus: int, held_out: int):
    return F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, score (0 to 1, higher: better) and predicted (1 if score >= ``threshold``)."""
    return with_scores(docs, fit(docs, labels), threshold)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs.select("doc_id", "text"), labels).select("doc_id", held_out_column(MODULUS, HELD_OUT), "score", "predicted")


