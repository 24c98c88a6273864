"""Benchmark decontamination by a distributed positional inverted index.

Words: A-Z lower-cased, runs of characters other than ASCII controls, space, punctuation and symbols. Phrases are the
windows of ``window`` consecutive words of each benchmark item (an item of fewer words is one phrase).

1. The index: texts are tokenised once, and every token's posting is stored, term and position packed in one long and
   sorted, so a term's postings are one run. The index is dealt by documents, as search engines deal theirs, and a
   document by blocks of ``BLOCK`` words (with a margin, so that no phrase is cut), so a very long text is many rows
   and no list gathers a hot word's postings in one task.
2. The index is counted: how often each term of the phrases occurs.
3. Offset-adjusted lists, from each phrase's rarest term on: its posting at position p, where the term stands at offset
   o of the phrase, proposes the start p - o; the other terms' lists must hold their places, the rarer ones first. All
   in place gives an exact match; ``percent`` of the terms each at most ``slop`` words from its place gives a
   proximity match (an exact match is one too). The rarest term is that of the terms which the index has.

Phrases are broadcast in parts of a bounded number, and each part reads the stored index, so nothing is shuffled by term
and only matches leave their task. Terms are compared by 51-bit digests. DataFrame functions only.

Defined cases: null texts have no words and match nothing; items without words are left out; items of equal text all
count; every row is judged alone, also rows that repeat a doc_id or have none; empty tables give no matches (and an
empty result where documents are empty); further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, broadcast_if_small, shared

WINDOW = 13
#: Proximity: this share of a phrase's terms, each at most SLOP words from its place.
PERCENT, SLOP = 80, 2
#: Words of a block of the index, and bits of a posting that hold its place in the block.
BLOCK, BITS = 256, 13
#: Phrases that are broadcast at once (some 400 bytes each).
PART_PHRASES = BROADCAST_ROWS // 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs between words; A-Z belong to words, which are lower-cased one by one.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(word: Column) -> Column:
    """A-Z lower-cased. lower() is quick for ASCII words and shows which words need a look at each character."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _raw_words(text: Column) -> Column:
    """Words in their own case; text may start or end with a gap, which gives empty strings to be left out."""
    found = F.split(F.coalesce(text.cast("string"), F.lit("")), GAP)
    first = F.when(F.get(found, F.lit(0)) == "", 2).otherwise(1)
    last = F.size(found) - F.when(F.element_at(found, -1) == "", 1).otherwise(0)
    return F.slice(found, first, F.greatest(last - first + 1, F.lit(0)))


def _term(word: Column) -> Column:
    """The term's digest in the upper bits of a posting."""
    return F.shiftleft(F.xxhash64(word), BITS)


def words_of(text: Column) -> Column:
    return F.transform(_raw_words(text), _lowered)


def phrases_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase_id, item_id, words: the windows of each item."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    start = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = items.select("item_id", F.explode(F.transform(start, lambda i: F.slice("w", i, window))).alias("words"))
    return rows.select(F.xxhash64(F.col("words")).alias("phrase_id"), "item_id", "words").distinct()


def _margin(window: int, slop: int) -> int:
    if BLOCK + 3 * (window + slop) >= 1 << BITS:
        raise ValueError(f"a window of {window} words and a slop of {slop} don't fit a block of the index")
    return window + slop


def positional_index(docs: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """The stored index, a row a block of a row of ``docs``: row (its number), doc_id, text_key (a digest of the text),
    n_words (of the whole text), block, postings (sorted; term digest and place in the block, which begins at the
    margin). Texts without words have one row with no postings."""
    margin = _margin(window, slop)
    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), _raw_words(F.col("text")).alias("raw"))

    def block(b: Column) -> Column:
        begin = b * BLOCK - margin
        low = F.greatest(begin, F.lit(0))
        held = F.slice("raw", low + 1, begin + BLOCK + 2 * margin - low)
        return F.struct(b.alias("block"), F.sort_array(F.transform(held, lambda w, i: _term(_lowered(w)) + i + (low - begin))).alias("postings"))

    last = F.greatest(F.ceil(F.size("raw") / BLOCK).cast("int") - 1, F.lit(0))
    blocks = plain.select("row", "doc_id", "text_key", F.size("raw").cast("bigint").alias("n_words"), F.explode(F.transform(F.sequence(F.lit(0), last), block)).alias("x"))
    return shared(blocks.select("row", "doc_id", "text_key", "n_words", "x.block", "x.postings"))


def _place(posting: Column) -> Column:
    return posting.bitwiseAND(F.lit((1 << BITS) - 1))


def _key(posting: Column) -> Column:
    return posting.bitwiseAND(F.lit(-(1 << BITS)))


def index_counts(index: DataFrame, vocabulary: DataFrame, n_vocabulary: int, margin: int) -> DataFrame:
    """key, n: occurrences in the index of each term of ``vocabulary`` (key); absent terms are left out."""
    keys = index.select(F.explode("postings").alias("p")).filter(_place(F.col("p")).between(margin, margin + BLOCK - 1)).select(_key(F.col("p")).alias("key"))
    if n_vocabulary <= BROADCAST_ROWS:
        keys = keys.join(F.broadcast(vocabulary), "key")
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "key")


def anchored(phrases: DataFrame, counts: DataFrame, n_vocabulary: int) -> DataFrame:
    """A row a phrase with a term that the index has: phrase_id, length, key and offset of its rarest such term, and
    others (key, offset), the rarest first."""
    terms = phrases.select("phrase_id", "words").distinct().select("phrase_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    known = terms.select("phrase_id", "length", "offset", _term(F.col("word")).alias("key")).join(broadcast_if_small(counts, n_vocabulary), "key", "left")
    ranked = known.groupBy("phrase_id", "length").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))).alias("a"))
    first = F.element_at(F.filter("a", lambda x: x["n"] > 0), 1)
    chosen = ranked.filter(F.exists("a", lambda x: x["n"] > 0)).withColumn("first", first)
    others = F.transform(F.filter("a", lambda x: x["offset"] != F.col("first.offset")), lambda x: F.struct(x["key"].alias("key"), x["offset"].alias("offset")))
    return chosen.select("phrase_id", "length", "first.key", "first.offset", others.alias("others"))


def matches(index: DataFrame, anchors: DataFrame, n_anchors: int, window: int = WINDOW, percent: int = PERCENT, slop: int = SLOP) -> DataFrame:
    """phrase_id, row, start, length, n_near (terms at most ``slop`` words from their places), exact: a row a proximity
    match (which all exact matches are). A start below 0 is that of a phrase whose first words lie before the text."""
    margin, parts = _margin(window, slop), max(1, -(-n_anchors // PART_PHRASES))
    near_by = sorted(range(-slop, slop + 1), key=abs)
    may_miss = lambda length: length - F.ceil(length * percent / 100.0).cast("int")
    columns = window - -(-window * percent // 100) + 1  # of the rarest so many others one must be near
    a = anchors.select("phrase_id", "length", F.col("key").alias("key"), "offset", "others", (F.size("others") <= may_miss(F.col("length"))).alias("free"), *[F.when(F.lit(j) <= may_miss(F.col("length")), F.get("others", F.lit(j))).alias(f"o{j}") for j in range(columns)])
    a = a.select("phrase_id", "length", "key", "offset", "others", "free", *[F.col(f"o{j}.{c}").alias(f"{c}{j}") for j in range(columns) for c in ("key", "offset")])
    held = index.select("row", "block", "postings", F.explode("postings").alias("p"))
    held = held.select("row", "block", "postings", _key(F.col("p")).alias("key"), _place(F.col("p")).cast("int").alias("place"))

    def near(key: Column, offset: Column) -> Column:
        return reduce(lambda x, y: x | y, [F.array_contains("postings", key + (F.col("begin") + offset + d)) for d in near_by])

    def part(i: int) -> DataFrame:
        mine = a if parts == 1 else a.filter(F.pmod(F.xxhash64("phrase_id"), F.lit(parts)) == i)
        met = held.join(F.broadcast(mine), "key").withColumn("begin", F.col("place") - F.col("offset"))
        own = F.col("begin").between(margin, margin + BLOCK - 1) | ((F.col("block") == 0) & (F.col("begin") < margin))
        some = reduce(lambda x, y: x | y, [near(F.col(f"key{j}"), F.col(f"offset{j}")) for j in range(columns)])
        met = met.filter(own).filter(F.col("free") | some)
        # the rarest others first, so that few candidates are counted whole
        for first in (columns + 2, window):
            close = F.size(F.filter(F.slice("others", 1, first), lambda o: near(o["key"], o["offset"])))
            met = met.withColumn("close", close).filter(F.col("close") >= F.least(F.lit(first), F.size("others")) - may_miss(F.col("length")))
        in_place = F.size(F.filter("others", lambda o: F.array_contains("postings", o["key"] + (F.col("begin") + o["offset"]))))
        return met.select("phrase_id", "row", (F.col("block").cast("bigint") * BLOCK + F.col("begin") - margin).alias("start"), "length", (F.col("close") + 1).alias("n_near"), (in_place == F.size("others")).alias("exact"))

    return reduce(DataFrame.unionByName, [part(i) for i in range(parts)])


def _items(found: DataFrame, phrases: DataFrame, n_phrases: int, name: str) -> DataFrame:
    """row, ``name``: the sorted ids (as strings) of the items whose phrases were found in the row."""
    pairs = found.select("row", "phrase_id").distinct().join(broadcast_if_small(phrases.select("phrase_id", "item_id"), n_phrases), "phrase_id")
    return pairs.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, percent: int = PERCENT, slop: int = SLOP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit (words in exact matches), items (ids of the items with
    exact matches, sorted strings), near_items (the same of proximity matches), contaminated (some word hit, and
    ``share`` * n_hit >= n_words), text_key (a digest of the text)."""
    from pyspark.sql import Window

    phrases = shared(phrases_of(benchmark, window))
    n_phrases = phrases.count()
    vocabulary = phrases.select(F.explode("words").alias("w")).select(_term(F.col("w")).alias("key")).distinct()
    n_vocabulary = vocabulary.count()
    index = positional_index(docs, window, slop)
    counts = index_counts(index, vocabulary, n_vocabulary, _margin(window, slop))
    anchors = shared(anchored(phrases, counts, n_vocabulary))
    found = shared(matches(index, anchors, anchors.count(), window, percent, slop))
    exact = found.filter("exact")
    ends = exact.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    reached = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = ends.withColumn("reached", F.coalesce(reached, F.lit(0))).groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    out = index.filter("block = 0").select("row", "doc_id", "text_key", "n_words")
    out = out.join(covered.join(_items(exact, phrases, n_phrases, "items"), "row").withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left").drop("_r")
    out = out.join(_items(found, phrases, n_phrases, "near_items").withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left").drop("_r")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.array().cast("array<string>")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the contaminated ones; all columns. Rows that repeat an id go by their own texts."""
    gone = contamination(docs, benchmark, **parameters).filter("contaminated").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_key"]), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM p),
occ AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, n, item_id FROM occ JOIN p USING (win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
