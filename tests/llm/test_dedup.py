import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import exchange as ex
from tessera.llm.components import components
from tessera.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, repeated_filter
from tessera.llm.jaccard_join import _across, drop_near_duplicates, jaccard_components, jaccard_links
from tessera.llm.substring_dedup import repeated_passages

WHITE = re.compile(r"[\x20\x09-\x0D]")


def random_texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base).split(" "))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


def test_exact_against_brute_force(make):
    texts = random_texts(1, 150) + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i))
    want = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            want[i] = (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(make(rows)).collect()}
    assert got == want
    assert sorted(r.doc_id for r in drop_exact_duplicates(make(rows)).collect()) == sorted(i for i, w in want.items() if w[2])


def test_exact_odd_rows(odd, empty):
    got = exact_duplicates(odd).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == 5
    assert {r.doc_id for r in got if r.kept} == {3, 5, 6, 7, 8}  # most code points first: " \n\t" and the one with two spaces
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_exact_of_repeated_rows_keeps_one(make):
    d = make([(1, "a b"), (1, "a b"), (None, "a b"), (2, "ab")])
    assert sum(r.kept for r in exact_duplicates(d).collect()) == 1
    assert [r.doc_id for r in drop_exact_duplicates(d).collect()] == [1]


def test_bloom_filter_never_misses(spark, make):
    keys = [hashlib.sha256(str(i % 70).encode()).digest() for i in range(100)]
    held = np.frombuffer(repeated_filter(spark.createDataFrame([(k,) for k in keys], "digest binary").repartition(4), 100), np.uint8)
    from tessera.llm.exact_dedup import _may_repeat

    may = _may_repeat(keys, held)
    assert all(may[i] for i in range(100) if keys.count(keys[i]) > 1)
    assert sum(may) < 70


def brute_passages(rows, window):
    words = {i: WHITE.split(t or "") for i, t in rows}
    words = {i: [w for w in ws if w] for i, ws in words.items()}
    least = {}
    for i, ws in words.items():
        for k in range(len(ws) - window + 1):
            g = tuple(ws[k : k + window])
            least[g] = min(i, least.get(g, i))
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if least[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def test_passages_against_brute_force(make):
    rows = list(enumerate(random_texts(2, 120)))
    for block, segment in ((8 << 20, 2_000_000), (2000, 500)):
        got = repeated_passages(make(rows), 5, block_bytes=block, segment_keys=segment).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_passages(rows, 5)
        for r in got:
            assert sum(s["to"] - s["from"] for s in r.removed) == r.n_removed


def test_messages_grow_as_the_input_does():
    for n in [10**k for k in range(0, 16)]:
        block, segment = ex.text_sizes(n)
        assert block >= ex.BLOCK_BYTES and segment >= ex.SEGMENT_KEYS
        messages = max(1, -(-n // block)) * ex.segments_for(max(1, n // 5), segment)
        assert messages <= 4 + 2 * n / 5 / ex.MESSAGE_KEYS  # segments are a power of two, at most twice as many
    assert ex.text_sizes(10**14)[0] < 160 << 20 and ex.text_sizes(10**9) == (ex.BLOCK_BYTES, ex.SEGMENT_KEYS)
    assert ex.text_sizes(10**14, 1000, 50) == (1000, 50)


def test_passages_and_sets_in_blocks_that_follow_the_input(make, monkeypatch):
    for name in ("BLOCK_BYTES", "BLOCK_KEYS", "SEGMENT_KEYS"):
        monkeypatch.setattr(ex, name, 10)
    rows = list(enumerate(random_texts(5, 120)))
    assert 10 < ex.text_sizes(sum(len(t) for _, t in rows))[0] < 2000
    got = repeated_passages(make(rows), 5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_passages(rows, 5)
    found = {r.doc_id: r.component_id for r in jaccard_components(make(rows), 2, 70).collect()}
    assert found == {i: c for i, (_, c) in brute_components(rows, 2, 70).items()}


def test_passages_odd_rows(odd, empty, make):
    got = repeated_passages(odd).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got)
    long = {r.doc_id: r for r in got}
    assert long[6].n_words == 60_000 and long[1].n_words == 0 and long[7].kept_text == "x" * 300_000
    assert repeated_passages(empty).count() == 0
    same = " ".join(map(str, range(20)))
    got = {(r.doc_id, r.n_removed) for r in repeated_passages(make([(1, same), (1, same), (2, same), (None, same)])).collect()}
    assert got == {(1, 0), (2, 20), (None, 20)}


def brute_components(rows, size, percent):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = [x for x in WHITE.split((t or "").translate(low)) if x]
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(seed, groups, each, words=70):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}x{rng.randrange(500)}" for _ in range(words)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(words)] = f"n{rng.randrange(40)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_jaccard_against_brute_force(make):
    texts = near_texts(3, 6, 20) + random_texts(4, 40) + ["A b", "a B", "a", None, "", "a b c"]
    rows = list(enumerate(texts))
    for percent, size in ((90, 3), (80, 5), (60, 2)):
        want = brute_components(rows, size, percent)
        got = jaccard_components(make(rows), size, percent, block_bytes=4000, segment_keys=1000).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = drop_near_duplicates(make(rows), size=5, percent=80)
    want = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[1] == i)


def test_pairs_across_labels(spark):
    """Each pair of one token's postings with two labels once, whatever label most of them have."""
    rng = random.Random(5)
    rows = [(token, doc, 9, 9, 0, [1], rng.choice([1, 1, 1, 2, 3])) for token in range(6) for doc in rng.sample(range(50), 12)]
    now = spark.createDataFrame(rows, "token long, doc long, n long, m long, pos long, bins array<smallint>, label long")
    want = sorted((t, x[1], y[1]) for t in range(6) for x in rows for y in rows if x[0] == y[0] == t and x[1] < y[1] and x[6] != y[6])
    for major in ("1", "2", "null"):
        got = _across(now.withColumn("major", F.expr(f"cast({major} as bigint)"))).collect()
        assert sorted((r.token, min(r.a, r.b), max(r.a, r.b)) for r in got) == want


def test_jaccard_chain_of_links(make):
    """Each links with the next only; no member links with all."""
    rows = [(i, " ".join(f"t{k}" for k in range(i * 2, i * 2 + 60))) for i in range(30)]
    got = {r.component_id for r in jaccard_components(make(rows), 3, 90).collect()}
    assert got == {w[1] for w in brute_components(rows, 3, 90).values()} == {0}


def test_jaccard_links_are_all_there(make):
    """Every link between different texts, also inside groups of near copies whose component is known."""
    base = [f"t{k}" for k in range(200)]
    copies = [" ".join(base[: 5 * i] + [f"new{i}"] + base[5 * i + 1 :]) for i in range(36)]
    texts = near_texts(3, 3, 20) + copies + random_texts(4, 20) + copies[:2] + ["a b c", "A b c", None]
    rows = list(enumerate(texts))
    for percent, size in ((90, 3), (60, 2)):
        sets = {}
        for i, t in rows:
            w = [x for x in WHITE.split((t or "").lower()) if x]
            if w:
                sets.setdefault(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))), i)
        reps, want = sorted((i, x) for x, i in sets.items()), set()
        for n, (b, y) in enumerate(reps):
            for a, x in reps[:n]:
                if 100 * len(x & y) >= percent * len(x | y):
                    want.add((a, b, len(x & y), len(x), len(y)))
        got = jaccard_links(make(rows), size, percent, block_bytes=4000, segment_keys=1000).collect()
        assert len(got) == len(want) > 36 * 35 / 2 and set(map(tuple, got)) == want
    assert jaccard_links(make(rows).limit(0)).count() == 0


def test_jaccard_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 1, 6), (7, 1, 7)} <= got
    assert any(r[0] is None and r[2] is None for r in got)
    assert drop_near_duplicates(odd).columns == odd.columns and drop_near_duplicates(odd).count() == 9
    assert jaccard_components(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_count_min_never_underestimates():
    rng = np.random.default_rng(0)
    sketch = ex.CountMin(500, segment_keys=100)
    blocks = [rng.integers(0, 400, 100).astype(np.uint64) for _ in range(5)]
    from tessera.llm.textvec import mix

    digests = [[mix(b), mix(b + np.uint64(10**9))] for b in blocks]
    asked = [sketch.ask(i, d) for i, d in enumerate(digests)]
    import pyarrow as pa

    answers = defaultdict(dict)
    for s in {x for a in asked for x in a["segment"]}:
        rows = [(a["block"][k], a["keys"][k], a["extra"][k]) for a in asked for k in range(len(a["segment"])) if a["segment"][k] == s]
        t = pa.table({"block": [r[0] for r in rows], "segment": [s] * len(rows), "keys": pa.array([r[1] for r in rows], pa.binary()), "extra": pa.array([r[2] for r in rows], pa.binary())})
        for r in ex.CountMin.answer(t).to_pylist():
            answers[r["block"]][s] = r["answer"]
    total = np.bincount(np.concatenate(blocks).astype(int), minlength=400)
    for i, b in enumerate(blocks):
        said = sketch.repeated(digests[i], answers[i])
        assert said[total[b.astype(int)] > 1].all()
        assert said[total[b.astype(int)] == 1].mean() < 0.5
