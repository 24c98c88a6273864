import random
from collections import Counter
from itertools import islice

import pytest

import corpus_pipeline
from tessera.llm import mixing


def test_period_keeps_every_source_within_a_block():
    rng = random.Random(1)
    for _ in range(200):
        shares = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        order, total, done = mixing.period(shares), sum(shares), [0] * len(shares)
        assert Counter(order) == Counter({i: s for i, s in enumerate(shares)})
        for t, i in enumerate(order, 1):
            done[i] += 1
            assert all(abs(n - t * s / total) < 1 for n, s in zip(done, shares))


def test_phases_place_every_block_once():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randint(1, 6)
        blocks, shares = [rng.randint(0, 50) for _ in range(k)], [rng.choice([0, 1, 3, 7]) for _ in range(k)]
        slots = sorted((p["start"] + j // p["share"] * p["total"] + p["places"][j % p["share"]], p["source_no"], p["first"] + j) for p in mixing.phases(blocks, shares) for j in range(p["count"]))
        assert [s[0] for s in slots] == list(range(sum(blocks)))
        for i, n in enumerate(blocks):
            assert [b for _, a, b in slots if a == i] == list(range(n))


def test_mix_follows_the_weights(spark, make):
    rows = [(i, "t", None, "a" if i < 600 else "b" if i < 900 else None) for i in range(1000)]
    got = mixing.mix(make(rows), {"a": 1, "b": 2, None: 1}, block_rows=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000)) and len({r.position for r in got}) == 1000
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r.slot, (r.source, r.phase)) == (r.source, r.phase)
    done = Counter()
    for t, slot in enumerate(sorted(s for s, (_, p) in by_slot.items() if p == 0), 1):
        done[by_slot[slot][0]] += 1
        assert all(abs(done[s] - t * w) < 1 for s, w in (("a", 0.25), ("b", 0.5), (None, 0.25)))
    assert Counter(r.block for r in got if r.source == "a") == Counter({k: 10 for k in range(60)})


def test_uneven_weights_stay_within_a_block_of_the_target():
    """Thousands of blocks, weights that no small number of shares can say, and one source beside 1,499 equal ones."""
    from fractions import Fraction

    uneven = [(85_470 if k == 0 else 8_997) ** 0.7 for k in range(20)]
    for weights, n in ((uneven, 30_000), ([2**0.5, 3**0.5, 1e-3, 7.0], 30_000), ([0.5] + [0.5 / 1499] * 1499, 4_000)):
        target, done = [Fraction(w) / sum(map(Fraction, weights)) for w in weights], Counter()
        total = sum(shares := mixing.exact_shares(weights))
        assert [Fraction(s, total) for s in shares] == target
        for t, (i, block, phase) in enumerate(islice(mixing.slots([n] * len(weights), shares), n), 1):
            assert phase == 0 and block == done[i]
            done[i] += 1
            assert abs(done[i] * total - t * shares[i]) < total
            if t % 97 == 0 or t == n:
                assert all(abs(done[k] * total - t * s) < total for k, s in enumerate(shares))


def test_every_number_of_sources_gets_a_mixture(spark, make, monkeypatch):
    """More sources than a task schedules, down to groups of groups; half of some sources' kind without a weight."""
    rows = [(i, None, None, None if i % 60 == 0 else f"s{i % 60}") for i in range(1800)]
    weights = {None if k == 0 else f"s{k}": 1.0 + k % 7 for k in range(50)}
    for most in (24, 6):
        monkeypatch.setattr(mixing, "MAX_SOURCES", most)
        got = mixing.mix(make(rows), weights, block_rows=1).collect()
        assert sorted(r.doc_id for r in got) == list(range(1800)) and sorted(r.slot for r in got) == list(range(1800))
        last = max(r.slot for r in got if r.source in weights)
        assert last == 1499  # sources without a weight follow at the end
        of, total, done = sorted(got, key=lambda r: r.slot), sum(weights.values()), Counter()
        for t, r in enumerate(of, 1):
            if r.phase:
                break
            assert r.block == done[r.source]
            done[r.source] += 1
            assert all(abs(done[s] - t * w / total) < (2 if most == 24 else 5) for s, w in weights.items())
        assert t > 200
        again = mixing.mix(make(rows).repartition(7), weights, block_rows=1).collect()
        assert {r.doc_id: r.slot for r in again} == {r.doc_id: r.slot for r in got}


def test_more_than_two_thousand_sources(make):
    got = mixing.mix(make([(i, None, None, f"s{i % 2001}") for i in range(2500)])).collect()
    assert len(got) == 2500 and len({r.position for r in got}) == 2500 and len({r.slot for r in got}) == 2001


def test_mix_is_the_same_at_every_layout(make):
    rows = [(i, None, None, f"s{i % 3}") for i in range(500)]
    a, b = ({r.doc_id: r.position for r in mixing.mix(make(rows).repartition(n)).collect()} for n in (1, 7))
    assert a == b


def test_mix_odd_rows(spark, odd, empty):
    got = mixing.mix(odd)
    assert set(got.columns) >= set(odd.columns) and got.count() == odd.count() and dict(got.dtypes)["slot"] == "bigint"
    assert mixing.mix(odd, {"s": 0}).count() == odd.count() and mixing.mix(empty).count() == 0


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    from tessera.llm.common import workers_find_package

    workers_find_package(spark)
    return "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, sf):
    """Each stage against what its operator says of the same input."""
    from test_dedup import WHITE, brute_components
    from test_filters import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf).checkpoint()
        out[name] = (before, docs.collect())
        if name != "mixing":
            assert docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = out["quality classifier"]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert not bad & set(ids(after)) and len(after) > 0.6 * len(before)
    before, after = out["exact dedup"]
    best = {}
    for r in before:
        best[WHITE.sub("", r.text)] = min(best.get(WHITE.sub("", r.text), (0, 10**9)), (-len(r.text), r.doc_id))
    assert ids(after) == sorted(x[1] for x in best.values())
    before, after = out["n-gram Jaccard join"]
    assert ids(after) == sorted(i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in before], 5, 80).items() if c == i)
    before, after = out["benchmark decontamination"]
    assert ids(after) == sorted(i for i, w in brute([(r.doc_id, r.text) for r in before], [(b.item_id, b.text) for b in bench], 13).items() if not w[3])
    before, after = out["mixing"]
    assert ids(after) == ids(before) and len({r.position for r in after}) == len(after)
    assert ids(corpus_pipeline.run(spark, sf).collect()) == ids(after)


def test_stages_on_odd_rows(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() > 0 and stage(spark, empty, sf).count() == 0
        if name != "mixing":
            assert stage(spark, odd, sf).columns == odd.columns


def test_slots_against_a_plain_simulation():
    """Earliest deadline first among released blocks, looked up afresh at every slot with exact fractions."""
    from fractions import Fraction

    from tessera.llm.mixing import exact_shares, slots

    for weights, blocks in (([0.9999, 0.0001], [3000, 2]), ([5.0, 3.0, 1.0, 0.5], [40, 9, 30, 7]), ([1.0] * 7 + [1e6], [3] * 7 + [900])):
        shares = exact_shares(weights)
        left, done, phase, want = list(blocks), [0] * len(blocks), 0, []
        while any(left):
            active = [i for i in range(len(blocks)) if left[i]]
            rate = {i: Fraction(shares[i], sum(shares[k] for k in active)) for i in active}
            took, t = dict.fromkeys(active, 0), 0
            while True:
                free = [i for i in active if (took[i] / rate[i]).__floor__() <= t]
                i = min(free, key=lambda k: (((took[k] + 1) / rate[k]).__ceil__(), k))
                if not left[i]:
                    break
                want.append((i, done[i], phase))
                took[i], done[i], left[i], t = took[i] + 1, done[i] + 1, left[i] - 1, t + 1
                assert all(abs(took[k] - rate[k] * t) < 1 for k in active)
            phase += 1
        assert list(slots(blocks, shares)) == want


def test_rows_without_id_spread(make):
    from tessera.llm.mixing import mix

    docs = make([(None, f"text {i}", "en", "s", 1) for i in range(3000)])
    got = mix(docs).collect()
    assert sorted(r.position for r in got) == list(range(3000))
