import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import textvec as tv
from tessera.llm.exchange import pack_bits, pack_sorted, unpack_bits, unpack_sorted

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab É\t\n漢", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_windows(values):
    column = pa.array(values, pa.string())
    raw, w = tv.words(column)
    want = [[x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if x] for t in values]
    data = raw.tobytes()
    got = [[data[w.starts[k] : w.ends[k]] for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == want
    flat = [x for d in want for x in d]
    seen = {}
    for x, h in zip(flat, w.digest.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (1, 2, 3):
        at = tv.inside(w.first, n)
        assert len(at) == sum(max(0, len(d) - n + 1) for d in want)
        grams = tv.runs(w.digest, n, 7)
        seen = {}
        for k in at.tolist():
            assert seen.setdefault(tuple(flat[k : k + n]), int(grams[k])) == int(grams[k])
        assert len(set(seen.values())) == len(seen)


def test_long_words_and_pieces(monkeypatch):
    monkeypatch.setattr(tv, "PIECE", 64)
    monkeypatch.setattr(tv, "_powers", {})
    small = tv.words(pa.array(["ab " * 50 + "y" * 500 + " ab", "y" * 500]))[1].digest
    monkeypatch.setattr(tv, "PIECE", 1 << 20)
    monkeypatch.setattr(tv, "_powers", {})
    assert (small == tv.words(pa.array(["ab " * 50 + "y" * 500 + " ab", "y" * 500]))[1].digest).all()
    assert small[50] == small[-1]


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 1000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and len(unpack_sorted(pack_sorted(x[:0]))) == 0
    b = x % np.uint64(3) == 0
    assert (unpack_bits(pack_bits(b), len(b)) == b).all()
