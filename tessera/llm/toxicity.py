"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first 4 and first 6 bytes (A-Z lower-cased;
words as in ``quality``). Filters of widths 1, 2 and 3 slide over the whole text; each filter's largest value feeds a
logistic unit. Training starts from the embeddings' log odds in the sample in one dimension and follows gradients from
there (Adagrad), on at most about ``ROWS_PER_LABEL`` texts a label. A quarter of the sample sets thresholds: one for
all languages, and one for each language with enough toxic texts, drawn to the common one by its count. A text's
language is predicted from the text alone (``lang_id``, fitted on the same sample). The language's threshold shifts
the score, so that 0.5 is the line everywhere.

Defined cases: null, empty and wordless texts score as a text of no words; without usable labels all scores are 0;
rows that repeat are scored alike; an empty table gives an empty result; all input columns stay and a clashing name is
replaced by the operator's own column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lang_id
from tessera.llm import textvec as tv
from tessera.llm.labelled import texts_for_fit, usable_labels
from tessera.llm.quality import _WORD, held_out_column, with_scores

ROWS_PER_LABEL = 2000
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PREFIXES = (4, 6)
#: Bits of the embedding rows of words and of each prefix; every kind has rows of its own.
BITS = (17, 16, 16)
ROWS = sum(1 << b for b in BITS)
STEPS, BATCH, RATE = 700, 48, 0.05
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Toxic texts of a language that weigh as much as the common threshold.
PRIOR = 50


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 3) and each text's first word; one more at the end."""
    return rows_of(*tv.buffer(texts))


def rows_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tv.bounds(raw, at, ~_WORD)
    rows = [tv.spans(raw, starts, ends, lower=True)]
    for k, n in enumerate(PREFIXES):
        rows.append(tv.mix(tv.spans(raw, starts, np.minimum(ends, starts + n), lower=True) + np.uint64(k + 1)))
    base = np.cumsum([0, *(1 << b for b in BITS[:-1])])
    return np.stack([(x >> np.uint64(64 - b)).astype(np.int32) + np.int32(o) for x, b, o in zip(rows, BITS, base)], axis=1), first


def _padded(rows: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors with two zero rows after each text, each text's first row, and which rows are words. Windows begin
    at words, so none spans two texts."""
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    x = np.zeros((int(at[-1]) + 2, DIM), np.float32)
    place = np.arange(len(rows)) + 2 * np.repeat(np.arange(len(n)), n)
    x[place] = table[rows].sum(axis=1)
    return x, at, place


def _slid(x: np.ndarray, f: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A filter bank's values at every word, 0 at the rows between texts."""
    k = len(f) // DIM
    y = sum(x[j : len(x) - 2 + j] @ f[j * DIM : (j + 1) * DIM] for j in range(k))
    out = np.zeros_like(y)
    out[place] = y[place]
    return out


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]  # one a width: width*DIM x FILTERS
    out: np.ndarray
    bias: float

    def pooled(self, x: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each text, at least 0."""
        got = []
        for f in self.filters:
            y = _slid(x, f, place)
            got.append(np.maximum.reduceat(y, at[:-1], axis=0))
        return np.maximum(np.concatenate(got, axis=1), 0)

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in tv.slices(texts, 1 << 20):
            if j == i + 1:
                raw, _ = tv.buffer(texts.slice(i, 1))
                if len(raw) > 2 * tv.PIECE:
                    out[i] = self._of_long(raw)
                    continue
            rows, first = word_rows(texts.slice(i, j - i))
            out[i:j] = self.of_rows(rows, first)
        return out

    def _of_long(self, raw: np.ndarray) -> float:
        """One long text, piece by piece: the largest values carry over, and so do a piece's last words, at which the
        windows that reach into the next begin."""
        best, behind, wide = np.zeros(FILTERS * len(WIDTHS)), np.empty((0, len(BITS)), np.int32), max(WIDTHS) - 1
        for a, b in tv.pieces(raw, _WORD):
            rows = np.concatenate([behind, rows_of(raw[a:b], np.array([0, b - a]))[0]])
            if len(rows) > wide:
                # windows at the last words are cut by the piece's end: they come again, whole, with the next
                x, at, place = _padded(rows, np.array([0, len(rows)]), self.table)
                best = np.maximum(best, self.pooled(x, at, place[:-wide])[0])
                rows = rows[-wide:]
            behind = rows
        if len(behind):
            best = np.maximum(best, self.pooled(*_padded(behind, np.array([0, len(behind)]), self.table))[0])
        return float(best @ self.out + self.bias)

    def of_rows(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(*_padded(rows, first, self.table)) @ self.out + self.bias


@dataclass
class Model:
    net: Net | None
    langs: lang_id.Model
    cut: np.ndarray  # the logit at each language's line; the last one for und

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        # rounded, so that equal texts score alike wherever in a batch they stand
        return 1 / (1 + np.exp(-np.clip(np.round(self.net.logits(texts), 3) - self.cut[self.langs.predict(texts)[0]], -30, 30)))


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Net:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
    odds = [np.zeros(ROWS) for _ in (0, 1)]
    for d, label in zip(docs, y):
        odds[int(label)][np.unique(d)] += 1
    n = [max(1, (y == k).sum()) for k in (0, 1)]
    table[:, 0] += np.clip(np.log((odds[1] + 0.5) / (n[1] + 1)) - np.log((odds[0] + 0.5) / (n[0] + 1)), -2, 4) * (1 - np.exp(-(odds[0] + odds[1]) / 8)) / 2
    filters = [rng.normal(0, 0.15, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[0, : FILTERS // 2] += 1
    net = Net(table, filters, np.full(FILTERS * len(WIDTHS), 0.1), -1.0)
    sums = [np.full(p.shape, 1e-3) for p in (table, *filters, net.out)] + [1e-3]
    by_label = [np.flatnonzero(y == k) for k in (0, 1)]
    for _ in range(STEPS):
        pick = np.concatenate([rng.choice(b, BATCH // 2) for b in by_label])
        rows, first = np.concatenate([docs[i] for i in pick]), np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        x, at, words = _padded(rows, first, net.table)
        place = np.full(len(x), -1)
        place[words] = np.arange(len(rows))
        tops, values = [], []
        for f in net.filters:
            v = _slid(x, f, words)
            top = np.stack([v[a:b].argmax(axis=0) + a for a, b in zip(at[:-1], at[1:])])
            tops.append(top)
            values.append(np.take_along_axis(v, top, axis=0))
        h = np.maximum(np.concatenate(values, axis=1), 0)
        g = (1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -30, 30))) - y[pick]) / len(pick)
        gh = g[:, None] * net.out[None] * (h > 0)
        grads, gx_at, gx = [], [], []
        for w, (k, f) in enumerate(zip(WIDTHS, net.filters)):
            part, gf = gh[:, w * FILTERS : (w + 1) * FILTERS], np.zeros_like(f)
            for j in range(k):
                span = x[tops[w] + j]  # texts x filters x DIM
                gf[j * DIM : (j + 1) * DIM] = np.einsum("nf,nfd->df", part, span)
                gx_at.append((tops[w] + j).ravel())
                gx.append((part[:, :, None] * f[j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
            grads.append(gf)
        where, gx = place[np.concatenate(gx_at)], np.concatenate(gx)
        gx, where = gx[where >= 0], where[where >= 0]
        keys, back = np.unique(rows[where].ravel(), return_inverse=True)
        gt = np.zeros((len(keys), DIM))
        np.add.at(gt, back.ravel(), np.repeat(gx, rows.shape[1], axis=0))
        sums[0][keys] += gt * gt
        net.table[keys] -= (RATE * gt / np.sqrt(sums[0][keys])).astype(np.float32)
        for i, gf in enumerate(grads):
            sums[i + 1] += gf * gf
            net.filters[i] -= (RATE * gf / np.sqrt(sums[i + 1])).astype(np.float32)
        go = h.T @ g + 1e-4 * net.out
        sums[-2] += go * go
        net.out -= RATE * go / np.sqrt(sums[-2])
        sums[-1] += g.sum() ** 2
        net.bias -= RATE * g.sum() / np.sqrt(sums[-1])
    return net


def _best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap in the logits where the F1 of "toxic above" is greatest."""
    order = np.argsort(-logit)
    hit, said = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (said + (y * weight).sum())
    k = int(np.argmax(f1))
    low = logit[order][k + 1] if k + 1 < len(order) else logit[order][k] - 1
    return float((logit[order][k] + low) / 2)


def fit_sample(docs: list[np.ndarray], y: np.ndarray, features: np.ndarray, langs: list[str | None], share: np.ndarray) -> Model:
    """``docs``: word rows of each text; ``features``: its ``lang_id`` row; ``share``: how many rows of the corpus a
    sampled row of each label stands for."""
    known = np.array([i for i, x in enumerate(langs) if x is not None], int)
    guess = lang_id.fit_rows(features[known], [langs[i] for i in known]) if len(known) else lang_id.Model([], np.zeros((0, 1)), np.zeros((lang_id.DIM, 1), np.float32), np.zeros(1, np.float32))
    if len(set(y.tolist())) < 2:
        return Model(None, guess, np.zeros(len(guess.langs) + 1))
    held = np.arange(len(y)) % 4 == 3
    for k in (0, 1):
        if not (held & (y == k)).any() or not (~held & (y == k)).any():
            held[:] = False
    use = np.flatnonzero(~held)
    net = train([docs[i] for i in use], y[use])
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    logit = np.array([net.of_rows(docs[i], np.array([0, len(docs[i])]))[0] for i in check])
    common = _best_cut(logit, y[check], share[check])
    lang = guess.losses_of(features[check]).argmin(axis=1) if guess.langs else np.full(len(check), -1)
    cut = np.full(len(guess.langs) + 1, common)
    for k in range(len(guess.langs)):
        mine = np.flatnonzero(lang == k)
        toxic = int(y[check][mine].sum())
        if 0 < toxic < len(mine):
            cut[k] = (toxic * _best_cut(logit[mine], y[check][mine], share[check][mine]) + PRIOR * common) / (toxic + PRIOR)
    return Model(net, guess, cut)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = ROWS_PER_LABEL) -> Model:
    labels = labels.filter(F.col(column).isin(0, 1))
    sizes = {int(y): n for y, n in usable_labels(labels, column, modulus, held_out).groupBy("y").count().collect()}
    sample = texts_for_fit(docs, labels, column, modulus, held_out, rows, lang=True)

    def run(batches):
        for b in batches:
            for i, j in tv.slices(b.column("text")):
                part = b.slice(i, j - i)
                words, first = word_rows(part.column("text"))
                features = lang_id.features(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("y").cast(pa.int64()), part.column("lang").cast(pa.string()), pa.array([words[a:c].tobytes() for a, c in zip(first[:-1], first[1:])], pa.binary()), pa.array([x.tobytes() for x in features], pa.binary())], ["id", "y", "lang", "words", "x"])

    got = sample.mapInArrow(run, "id string, y bigint, lang string, words binary, x binary").collect()
    got.sort(key=lambda r: r.id)
    y = np.array([r.y for r in got], np.int64)
    share = np.array([sizes[int(k)] / max(1, (y == k).sum()) for k in y])
    rows, langs = [np.frombuffer(r.words, np.int32).reshape(-1, 3) for r in got], [r.lang for r in got]
    features = np.empty((len(got), lang_id.DIM), np.float32)
    for i in range(len(got)):  # each row's bytes go as soon as they are copied
        features[i] = np.frombuffer(got[i].x, np.float16)
        got[i] = None
    return fit_sample(rows, y, features, langs, share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, score (0 to 1, higher: more likely toxic) and predicted (1 if score >= ``threshold``)."""
    return with_scores(docs, fit(docs, labels), threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return with_scores(docs.select("doc_id", "text"), fit(docs, labels), THRESHOLD).select("doc_id", held_out_column(MODULUS, HELD_OUT), "score", "predicted")
