"""Language identification by error-correcting output codes.

Each language has a codeword of bits, far from the others'. One binary logistic classifier a bit learns it from hashed
byte n-grams (1 to 3 bytes of the text with A-Z lower-cased and signs and digits made spaces), weighted by the square
root of their share. Decoding is loss-weighted: the language whose codeword costs the least logistic loss over all bits
wins; a text is ``ambiguous`` when the second costs little more. Fitted on rows with a language of their own, at most
about ``ROWS_PER_LABEL`` a language and ``labelled.MAX_ROWS`` in all (a hash of the id decides; every language has
one), whose feature rows alone (8 KB each) reach the driver; predictions read whole texts, in
pieces, with the weights (under 1 MB) broadcast.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and ambiguous; without labelled texts all
are; one language alone is always predicted, if the text has a letter; rows that repeat are judged alike; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.common import fold
from tessera.llm.labelled import sampled

DIM = 4096
ROWS_PER_LABEL = 500
EPOCHS = 120
MARGIN = 0.1
MODULUS, HELD_OUT = 3, 1

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of DIM float32 for each text: square roots of n-gram shares, of length 1 (or 0 without n-grams)."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, j in tv.slices(texts, 1 << 20):
        raw, at = tv.buffer(texts.slice(i, j - i))
        if j == i + 1 and len(raw) > 2 * tv.PIECE:  # one long text, piece by piece
            for a in range(0, len(raw), tv.PIECE):
                x = _FOLD[raw[a : a + tv.PIECE + 2]].astype(np.uint32)
                grams = x * np.uint32(2654435761)
                for n in (1, 2, 3):
                    if n > 1:
                        grams = grams[:-1] * np.uint32(16777619) + x[n - 1 :] * np.uint32(2654435761)
                    out[i] += np.bincount(grams[: tv.PIECE] >> np.uint32(20), minlength=DIM)
            continue
        x = _FOLD[raw].astype(np.uint32)
        doc = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(at))
        grams = x * np.uint32(2654435761)
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[:-1] * np.uint32(16777619) + x[n - 1 :] * np.uint32(2654435761)
            if len(grams) <= 0:
                break
            same = doc[: len(grams)] == doc[n - 1 :]
            step = 1 << 22
            for k in range(0, len(grams), step):
                part = slice(k, k + step)
                key = (doc[: len(grams)][part] * DIM + (grams[part] >> np.uint32(20)))[same[part]]
                if len(key):
                    low, high = int(key[0]) // DIM, int(key[-1]) // DIM + 1
                    out[i + low : i + high] += np.bincount(key - low * DIM, minlength=(high - low) * DIM).reshape(-1, DIM)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for i, j in tv.slices(texts):
        raw, at = tv.buffer(texts.slice(i, j - i))
        if j == i + 1:
            out[i] = _ASCII_LETTER[raw].any()
            continue
        total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw], dtype=np.int64)])
        out[i:j] = total[at[1:]] > total[at[:-1]]
    for k in np.flatnonzero(~out).tolist():
        text = texts[k].as_py()
        out[k] = bool(text) and any(c.isalpha() for c in text)
    return out


def codewords(count: int, seed: int = 5) -> np.ndarray:
    """``count`` codewords of -1 and 1. Few languages get all splits (the exhaustive code); more get the best of many
    random codes by the least distance between two codewords."""
    if count <= 5:
        bits = (1 << max(0, count - 1)) - 1
        return np.array([[1] * max(1, bits)] + [[2 * ((b >> (count - 1 - r)) & 1) - 1 for b in range(max(1, bits))] for r in range(1, count)])
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (count, int(np.ceil(8 * np.log2(count)))))
        near = np.max(code @ code.T - 1e9 * np.eye(count))
        if best is None or near < far:
            best, far = code, near
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray

    def losses(self, texts: pa.Array) -> np.ndarray:
        """Mean logistic loss of each language's codeword."""
        out = np.zeros((len(texts), len(self.langs)))
        for i, j in tv.slices(texts, 2 << 20):
            for a in range(i, j, 512):
                b = min(j, a + 512)
                out[a:b] = self.losses_of(features(texts.slice(a, b - a)))
        return out

    def losses_of(self, rows: np.ndarray) -> np.ndarray:
        margin = rows @ self.weights + self.bias
        one = (self.code > 0).astype(margin.dtype)
        return (np.logaddexp(0, -margin) @ one.T + np.logaddexp(0, margin) @ (1 - one).T) / self.code.shape[1]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: und), score, ambiguous."""
        n = len(texts)
        letter = has_letter(texts)
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        loss = self.losses(texts)
        best = loss.argmin(axis=1)
        share = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / share.sum(axis=1)
        ranked = np.sort(loss, axis=1)
        close = ranked[:, 1] - ranked[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(n, bool)
        return np.where(letter, best, -1), np.where(letter, score, 0.0), close | ~letter


def fit_rows(rows: np.ndarray, langs: list[str]) -> Model:
    """Full-batch gradient descent with momentum on all bits' logistic losses at once; languages weigh alike."""
    names = sorted(set(langs))
    code = codewords(len(names)).astype(np.float32)
    y = np.array([names.index(x) for x in langs])
    weight = (1 / np.bincount(y, minlength=len(names)) / len(names))[y].astype(np.float32)[:, None]
    target = code[y]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(EPOCHS):
        g = -target * weight / (1 + np.exp(np.clip(target * (rows @ w + b), -30, 30)))
        vw = 0.9 * vw - 8.0 * (rows.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * g.sum(axis=0)
        w, b = w + vw, b + vb
    return Model(names, code, w, b)


def fit(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = ROWS_PER_LABEL) -> Model:
    own = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("y"), "text")
    sample = sampled(own.filter(F.col("y").isNotNull() & F.col("text").isNotNull() & (fold("_id", modulus) != held_out)), rows)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            for i in range(0, len(texts), 256):
                part = texts.slice(i, 256)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, 256).cast(pa.string()), b.column("y").slice(i, 256).cast(pa.string()), pa.array([x.astype(np.float16).tobytes() for x in features(part)], pa.binary())], ["id", "y", "x"])

    got = sorted(sample.mapInArrow(run, "id string, y string, x binary").collect(), key=lambda r: (r.id, r.y))
    if not got:
        return Model([], np.zeros((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
    return fit_rows(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), [r.y for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (0 to 1), ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*held.value.langs, "und"], object)
        for b in batches:
            lang, score, close = held.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[lang], pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "ambiguous")
