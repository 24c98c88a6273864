import random
import re

from tessera.llm import decontaminate as D
from tessera.llm.url_filter import RULES, judge_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, items, window):
    tokens = lambda t: WORD.findall((t or "").translate(LOW))
    windows = set()
    for item, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows.add((item, tuple(w[k : k + window])))
    out = {}
    for i, t in rows:
        w, hit, held = tokens(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    held.add(str(item))
        out[i] = (len(w), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"] if rng.random() < 0.5 else [f"W{rng.randrange(60)}", f"é{rng.randrange(9)}"])
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 25)))) for k in range(12)] + [(50, None), (51, " .!"), (52, "the the the the the the")]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w[len(w) // 2 : len(w) // 2] = (rng.choice(items)[1] or "").upper().split()
        rows.append((i, ", ".join(w)))
    return rows + [(80, None), (81, "the " * 9)], items


def test_decontamination_against_brute_force(spark, make, monkeypatch):
    rows, items = corpus(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items, 6)
    for block, part, broadcast in ((1024, 50_000, 200_000), (7, 40, 0)):  # blocks shorter than texts, phrases in parts, joins that shuffle
        monkeypatch.setattr(D, "BLOCK", block)
        monkeypatch.setattr(D, "PART_PHRASES", part)
        monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
        got = D.contamination(make(rows), bench, 6).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == want
        assert all(set(r["items"]) <= set(r.near_items) for r in got)
    kept = D.drop_contaminated(make(rows), bench, window=6)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if not w[3])


def test_decontamination_judges_each_row_alone(spark, make):
    """Null and repeated ids with different texts."""
    bench = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    docs = make([(None, "one two three four"), (None, "x one two three four"), (None, "nothing here"), (7, "one two three four"), (7, "quite clean"), (7, None)])
    got = sorted((r.n_words, r.n_hit, r.contaminated) for r in D.contamination(docs, bench).collect())
    assert got == [(0, 0, False), (2, 0, False), (2, 0, False), (4, 4, True), (4, 4, True), (5, 4, True)]
    assert sorted(str(r.text) for r in D.drop_contaminated(docs, bench).collect()) == ["None", "nothing here", "quite clean"]


def test_decontamination_odd_rows(spark, odd, empty, make):
    bench = spark.createDataFrame([(1, "one two three four"), (2, None), (1, "one two three four")], "item_id bigint, text string")
    got = D.contamination(odd, bench).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.contaminated} == {4, 5, None}
    assert {r.doc_id: r.n_words for r in got}[6] == 60_000
    assert D.contamination(empty, bench).count() == 0
    none = D.contamination(odd, bench.limit(0)).collect()
    assert len(none) == odd.count() and not any(r.n_hit for r in none)
    kept = D.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 6


def test_proximity_against_brute_force(spark, make, monkeypatch):
    rng = random.Random(5)
    rows, items = corpus(3)
    rows = [(i, t if i % 2 or not t else " ".join(w for w in t.replace(",", "").split() if rng.random() < 0.9)) for i, t in rows]
    bench = spark.createDataFrame([*items, (60, "W1 never W2 the W3")], "item_id bigint, text string")
    for block, slop, percent in ((1024, 2, 60), (6, 1, 60), (6, 0, 100)):
        monkeypatch.setattr(D, "BLOCK", block)
        phrases = D.phrases_of(bench, 5)
        vocabulary = phrases.selectExpr("explode(words) as w").select(D._term(D.F.col("w")).alias("key")).distinct()
        index = D.positional_index(make(rows), 5, slop)
        anchors = D.anchored(phrases, D.index_counts(index, vocabulary, 99, 5 + slop), 99)
        ids = {r.row: r.doc_id for r in index.select("row", "doc_id").collect()}
        words = {r.phrase_id: r.words for r in phrases.collect()}
        got = {(r.phrase_id, ids[r.row], r.start): (r.n_near, r.exact) for r in D.matches(index, anchors, 99, 5, percent, slop).collect()}
        want = {}
        for r in anchors.collect():
            g = words[r.phrase_id]
            for i, t in rows:
                w = WORD.findall((t or "").translate(LOW))
                for p in [k for k in range(len(w)) if w[k] == g[r.offset]]:
                    start = p - r.offset
                    near = 1 + sum(any(0 <= start + o + d < len(w) and w[start + o + d] == g[o] for d in range(-slop, slop + 1)) for o in range(len(g)) if o != r.offset)
                    if near * 100 >= len(g) * percent:
                        want[r.phrase_id, i, start] = (near, start >= 0 and w[start : start + len(g)] == g)
        assert got == want and any(not x for _, x in got.values()) == (slop > 0)


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)(/[^?#]*)?", rest, re.S)
        host, path = m[1].translate(LOW), m[2] or ""
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)[0].translate(LOW), "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), verdict == "block", rule)
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.Example.com", "a.www.example.com", "notexample.com", "net", "x.net", "com", "", "COM", "a..com", "x.org", "example.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/a/b", "/es/", "/fr/x?y=/en/", "/EN/", "//en/", "/en/#z", "?q=1", "#/en/"]
    urls = [f"{rng.choice(['http', 'https', 'ftp'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "http://a://com/", "://com/", "http://example.com/en/\nx", "h://example.com/" + "en/" * 20_000]
    rules = RULES + [("org/", "block"), ("org/", "allow"), ("x.org/en", "allow"), (None, "block"), ("bad", "block")]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id bigint, url string, verdict string").repartition(3)
    got = judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    usable = [r for r in rules if r[0] and "/" in r[0]]
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], usable), urls[r.page_id]


def test_urls_have_the_path_of_their_own_host(spark):
    urls = ["http://example.com?next=http://b.org/en/x", "http://example.com#http://b.org/en/x", "http://example.com?u=://c/en/", "http://example.com/en/?u=http://b.org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = judge_urls(pages, spark.createDataFrame([("example.com/en/", "block")], "rule string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.verdict) for r in got} == {k: ("example.com", "/en/" if k == 3 else "", "block" if k == 3 else "allow") for k in range(4)}


def test_urls_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/")], "page_id bigint, url string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0), "block").first().verdict == "block"
