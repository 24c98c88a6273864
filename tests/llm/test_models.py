import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lang_id, quality, token_counts, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    from tessera.llm.common import workers_find_package

    workers_find_package(spark)
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_language_on_held_out(spark, tables):
    docs = tables[0]
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = lang_id.op1_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) > 0.95


def test_language_odd_rows(spark, tables, odd, empty):
    model = lang_id.fit(tables[0])
    got = {r.doc_id: r for r in lang_id.identify(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[6].lang_pred != "und" and got[8].lang_pred != "und"
    assert lang_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd, lang_id.fit(empty)).collect()} == {"und"}
    one = lang_id.identify(odd, lang_id.fit(tables[0].filter("lang = 'fr'"))).filter("doc_id = 4").first()
    assert one.lang_pred == "fr"


def test_codewords_are_far_apart():
    for n in (2, 3, 5, 6, 20, 100):
        code = lang_id.codewords(n)
        near = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert near >= max(1, code.shape[1] // 5)


def test_losses_are_those_of_the_nearest_codeword():
    rng = np.random.default_rng(0)
    m = lang_id.Model(list("abcd"), lang_id.codewords(4), rng.normal(size=(lang_id.DIM, 7)).astype(np.float32), np.zeros(7, np.float32))
    rows = rng.normal(size=(20, lang_id.DIM)).astype(np.float32)
    want = [[np.mean([np.log1p(np.exp(-(x @ m.weights)[b] * c[b])) for b in range(7)]) for c in m.code] for x in rows]
    assert np.allclose(m.losses_of(rows), want, atol=1e-3)


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_quality_on_held_out(spark, tables):
    truth = {r.doc_id: r.quality for r in tables[1].collect()}
    got = [r for r in quality.op3_quality_classifier(spark, SF).collect()]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id, 5, 0) for r in got)
    mine = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in mine], [r.score for r in mine]) > 0.97


def test_toxicity_on_held_out(spark, tables):
    """Trained on a corpus like the registered one, but larger: held-out rows of sf0.1."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op7_toxicity(spark, sf).collect()]
    mine = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 10_000 and auc([truth[r.doc_id] for r in mine], [r.score for r in mine]) > 0.9
    said = [truth[r.doc_id] for r in mine if r.predicted]
    assert np.mean(said) > 0.85 and sum(said) > 0.7 * sum(truth[r.doc_id] for r in mine)


@pytest.mark.parametrize("model", [quality, toxicity])
def test_scores_of_odd_rows(spark, tables, odd, empty, model):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 4, 5, 6, 8)] + [(2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    score = quality.quality_scores if model is quality else toxicity.toxicity_scores
    got = score(odd, labels)
    assert set(got.columns) == set(odd.columns) and dict(got.dtypes)["score"] == "double"
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""] == by[" \n\t"]
    assert score(empty, labels).count() == 0
    assert score(odd, labels.limit(0)).count() == odd.count()


def test_sparse_rows_and_streamed_scores_agree():
    texts = pa.array(["a b c a b ###", None, "", "É É 12 AB cd |", "x " * 500])
    rows = quality._rows(texts)
    m = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    want = [1 / (1 + np.exp(-(m.weights[i] @ x + 0.3))) for i, x in rows]
    assert np.allclose(m.scores(texts), want, atol=1e-4)


def test_network_gradient_free_forward():
    """The pooled filters against a plain loop."""
    rng = np.random.default_rng(1)
    net = toxicity.Net(rng.normal(size=(toxicity.ROWS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(k * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for k in toxicity.WIDTHS], np.ones(24), 0.0)
    texts = pa.array(["one two three four", "", "five"])
    rows, first = toxicity.word_rows(texts)
    got = net.pooled(*toxicity._padded(rows, first, net.table))
    for t in range(3):
        x = np.concatenate([net.table[rows[first[t] : first[t + 1]]].sum(axis=1), np.zeros((4, toxicity.DIM))])
        n = first[t + 1] - first[t] + 2
        want = np.concatenate([np.max([x[i : i + k].ravel() @ f for i in range(n)], axis=0) for k, f in zip(toxicity.WIDTHS, net.filters)])
        assert np.allclose(got[t], np.maximum(want, 0), atol=1e-3)


def brute_tokens(word, scores, byte):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        options = [(best[d - 1][0] + byte, best[d - 1][1] + 1)]
        options += [(best[d - n][0] + scores[word[d - n : d]], best[d - n][1] + 1) for n in range(1, d + 1) if word[d - n : d] in scores]
        top = max(o[0] for o in options)
        best.append(min((o for o in options if o[0] > top - 1e-9), key=lambda o: o[1]))
    return best[-1][1]


def test_token_counts_against_brute_force(make, odd, empty):
    rng = np.random.default_rng(3)
    pieces = [token_counts.MARK, "a", "b", "ab", "ba", "aba", "é", "aé", token_counts.MARK + "ab", "bb" * 20, "漢"]
    scores = [float(-x) for x in rng.uniform(1, 9, len(pieces))]
    held = dict(zip((p.encode() for p in pieces), scores))
    words = ["".join(rng.choice(list("abé漢z"), rng.integers(1, 30))) for _ in range(400)] + ["b" * 300, "ab" * 2000]
    v = token_counts.Vocabulary.of(pieces, scores)
    marked = sorted({(token_counts.MARK + w).encode() for w in words})
    want = {w: brute_tokens(w, held, v.byte) for w in marked}
    assert v.counts(marked).tolist() == [want[w] for w in marked]
    texts = [" ".join(words[i::7]) for i in range(7)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(list(enumerate(texts))), pieces, scores).collect()}
    assert got == {i: sum(want[(token_counts.MARK + w).encode()] for w in t.split()) for i, t in enumerate(texts)}
    rows = token_counts.token_counts(odd, pieces, scores)
    assert set(rows.columns) == set(odd.columns) and {r.doc_id: r.n_tokens for r in rows.collect()}[1] == 0
    assert token_counts.token_counts(empty, pieces, scores).count() == 0 and token_counts.token_counts(odd, [], []).count() == odd.count()


def test_token_counts_match_a_library(spark):
    """The same vocabulary and scores in another implementation of unigram splitting."""
    from tokenizers import Tokenizer, models

    pieces = token_counts.read_pieces(token_counts.VOCABULARY)
    scores = token_counts.zipf_scores(pieces)
    library = Tokenizer(models.Unigram([("<unk>", -1e4), *zip(pieces, scores)], 0))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 600).limit(60).collect()]
    words = sorted({token_counts.MARK + w for t in texts for w in t.split() if all(c in set(pieces) for c in w)})
    ours = token_counts.Vocabulary.of(pieces, scores).counts([w.encode() for w in words])
    same = [len(library.encode(w).ids) == n for w, n in zip(words, ours.tolist())]
    assert np.mean(same) > 0.99  # ties of equal sums may split otherwise


def test_toxicity_weighs_by_labels_outside_the_held_out_fold(spark, make, monkeypatch):
    rows, labels = [(i, f"some words {i}") for i in range(60)], [(i, 1, int(i % 3 == 0)) for i in range(60)]
    monkeypatch.setattr(toxicity, "fit_sample", lambda docs, y, features, langs, share: (y, share))
    y, share = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    seen = [t for i, _, t in labels if zlib.crc32(str(i).encode()) % toxicity.MODULUS != toxicity.HELD_OUT]
    assert len(seen) < 60 and [round(float(share[y == k].sum()), 6) for k in (0, 1)] == [seen.count(0), seen.count(1)]


def long_text(size, seed=4):
    rng = np.random.default_rng(seed)
    words = np.array(["alpha", "Beta", "beta", "beta", "x1", "YES", "été", "漢字", "--", "!", "12", "n't"])
    out = []
    while sum(map(len, out)) < size:
        out.append(" ".join(words[rng.integers(0, len(words), 5000)].tolist()))
    return "\n".join(out)


def test_long_texts_score_in_pieces_as_whole():
    text = long_text(7_000_000)
    arr, rng = pa.array([text]), np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    word, w_first, shape, s_first = quality.ngrams(arr)
    whole = 0.1 + sum(quality.SCALE * model.weights[x].astype(np.float64).mean() for x in (word, shape))
    assert len(pa.array([text]).cast(pa.binary())[0].as_py()) > 3 * quality.tv.PIECE
    assert np.isclose(model.scores(arr)[0], 1 / (1 + np.exp(-whole)), atol=1e-5)
    net = toxicity.Net(rng.normal(size=(toxicity.ROWS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(k * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for k in toxicity.WIDTHS], rng.normal(size=24), 0.2)
    assert np.isclose(net.logits(arr)[0], net.of_rows(*toxicity.word_rows(arr))[0], rtol=1e-5)
    raw = np.frombuffer(text.encode(), np.uint8)
    x = lang_id._FOLD[raw].astype(np.uint32)
    count, grams = np.zeros(lang_id.DIM), x * np.uint32(2654435761)
    for n in (1, 2, 3):
        grams = grams if n == 1 else grams[:-1] * np.uint32(16777619) + x[n - 1 :] * np.uint32(2654435761)
        count += np.bincount(grams >> np.uint32(20), minlength=lang_id.DIM)
    want = np.sqrt(count) / np.linalg.norm(np.sqrt(count))
    assert np.allclose(lang_id.features(arr)[0], want, atol=1e-4) and lang_id.has_letter(arr)[0]
    for odd in ("x" * 5_000_000, "! " * 2_500_000):  # one word, and no word at all
        assert np.isfinite(model.scores(pa.array([odd]))[0]) and np.isfinite(net.logits(pa.array([odd]))[0])
        assert np.isclose(net.logits(pa.array([odd]))[0], net.of_rows(*toxicity.word_rows(pa.array([odd])))[0], rtol=1e-5)


def test_ftrl_against_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(40, 6, replace=False).astype(np.int32), rng.random(6).astype(np.float32)) for _ in range(30)]
    y = rng.integers(0, 2, 30).astype(float)
    got = quality.ftrl(rows, y, epochs=2, alpha=0.3, beta=1.0, l1=0.02, l2=0.5)
    z, n, shuffle = {}, {}, np.random.default_rng(7)

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - np.sign(a) * 0.02) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.5)

    for _ in range(2):
        for k in shuffle.permutation(30):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist())), "bias": 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y[k]) * v
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / 0.3 * w[i]
    assert np.allclose(got.weights[:40], [weight(i) for i in range(40)], atol=1e-5) and np.isclose(got.bias, weight("bias"), atol=1e-5)


def test_one_training_step_follows_the_numeric_gradient(monkeypatch):
    """With one step of unit rate and adagrad's sums held at 1, the change of each parameter is its gradient."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, (int(rng.integers(3, 9)), 3)).astype(np.int32) for _ in range(8)]
    y = np.array([0, 1] * 4)
    picked = []

    class Rng:
        def __init__(self, seed):
            self.inner = np.random.Generator(np.random.PCG64(seed))

        def normal(self, *a):
            return self.inner.normal(*a)

        def choice(self, b, n):
            picked.append(b[np.arange(n) % len(b)])
            return picked[-1]

    monkeypatch.setattr(toxicity.np.random, "default_rng", Rng)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    before = toxicity.train(docs, y)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "BATCH", 8)
    after = toxicity.train(docs, y)
    pick = np.concatenate(picked)

    def loss(net):
        logit = np.array([net.of_rows(docs[i], np.array([0, len(docs[i])]))[0] for i in pick])
        return np.mean(np.logaddexp(0, logit) - y[pick] * logit)

    def numeric(array, at, h=2e-3):
        keep, out = array[at], []
        for s in (h, -h):
            array[at] = keep + s
            out.append(loss(before))
        array[at] = keep
        return (out[0] - out[1]) / (2 * h)

    # Adagrad's first step is -RATE * g / sqrt(1e-3 + g * g), from which g follows
    def told(a, b):
        s = np.clip(np.abs(b.astype(float) - a.astype(float)) / toxicity.RATE, 0, 0.999999)
        return np.sign(a - b) * np.sqrt(1e-3 * s * s / (1 - s * s))

    for k in range(3):
        g = told(before.filters[k], after.filters[k])
        for at in [(0, 0), (5, 1), (17, 3), (3, 6)]:
            if at[0] < len(g):
                assert np.isclose(g[at], numeric(before.filters[k], at), atol=2e-3), (k, at)
    g = told(before.table, after.table)
    for at in [(int(docs[0][0, 0]), 0), (int(docs[1][1, 1]), 0), (int(docs[2][2, 2]), 4)]:
        assert np.isclose(g[at], numeric(before.table, at), atol=2e-3), at


def test_many_languages_are_all_learnt(make):
    """More label values than any list of the most frequent ones would hold, and ids that repeat with a null language."""
    words = ["".join(chr(97 + (7 * k + 3 * j) % 26) for j in range(6)) + str(k) for k in range(300)]
    rows = [(i, " ".join([words[i % 300]] * 20), f"l{i % 300:03}") for i in range(900)]
    model = lang_id.fit(make([*rows, (0, "zz " * 50, None), (None, "yy " * 50, "l000")]))
    assert model.langs == sorted({r[2] for r in rows if not held(r[0], 3, 1)}) and len(model.langs) > 256


def test_a_row_without_language_teaches_nothing(make):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "a" if i % 2 else "x") for i in range(60)]
    model = lang_id.fit(make(rows))
    again = lang_id.fit(make([*rows, *[(i, "xxx yyy zzz", None) for i in range(1, 60, 2)]]))
    assert np.allclose(model.weights, again.weights, atol=1e-6)


def test_quality_labels_other_than_0_and_1_teach_nothing(spark, make):
    docs = make([(i, ("good fine " if i % 2 else "bad poor ") * 5) for i in range(80)])
    labels = [(i, i % 2) for i in range(0, 60)]
    fit = lambda rows: quality.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"))
    assert np.allclose(fit(labels).weights, fit([*labels, *[(i, 7) for i in range(60, 80)], (1, None)]).weights)


def test_samples_keep_to_their_bytes(spark, make, monkeypatch):
    from tessera.llm import labelled

    docs = make([(i, f"{i} " * 100) for i in range(200)] + [(500, "word " * 100_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 500]], "doc_id bigint, quality int")
    assert labelled.texts_for_fit(docs, labels, "quality", 5, 9).count() == 201
    monkeypatch.setattr(labelled, "FIT_BYTES", 20_000)
    got = labelled.texts_for_fit(docs, labels, "quality", 5, 9).collect()
    assert 20 < len(got) < 120 and all(r["_id"] != 500 for r in got)


def test_long_pre_tokens_enter_the_trie(make):
    """Text without spaces: cut where no piece crosses, with the counts of the plain recurrence."""
    pieces = [token_counts.MARK, "漢字", "字漢", "漢", "ab", "abc", "ca", "a"]
    scores = token_counts.zipf_scores(pieces)
    held = token_counts.Vocabulary.of(pieces, scores)
    rng = np.random.default_rng(3)
    alphabet = ["漢", "字", "あ", "a", "b", "c", "z"]
    words = ["".join(rng.choice(alphabet, 400).tolist()) for _ in range(5)] + ["漢字" * 200, "z" * 300, "abc" * 100]
    want = [brute_tokens((token_counts.MARK + w).encode(), dict(zip([p.encode() for p in pieces], scores)), held.byte) for w in words]
    got = token_counts.counts_of(pa.array(words), held)
    assert got.tolist() == want
