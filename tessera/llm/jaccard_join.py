"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set holds the 64-bit digests of its distinct ``size``-word shingles (words: lower-cased A-Z, runs of bytes
other than space and \\t \\n \\v \\f \\r); a text of fewer words is one shingle. Sets link when
100 * intersection >= percent * union.

1. A count-min sketch over all documents' shingles (``exchange.CountMin``) leaves out documents whose shingles are
   mostly single: a link needs percent / 100 of the larger set in common.
2. Equal sets become one class with its least doc_id; classes go on, copies don't.
3. Shingles get a global order, rarest first (exact counts over the classes), which is cut into fragments; each class
   has a segment in each fragment, without shingles that no other class has.
4. Candidates are pairs that share a shingle in their prefixes (a set's n - ceil(percent * n / 100) + 1 first
   shingles), have sizes that fit, and can have enough in common by the shingle's places in both segments and by
   counts of both sets' shingles in ``BINS`` bins.
5. Partial overlaps of a candidate pair are counted in each fragment separately and summed per pair.
6. So that a group of n near copies doesn't cost n * n pairs, every class first meets one centre of its lists (4 and 5
   for these pairs); the links give labels (two rounds of components), and afterwards only pairs across labels are
   candidates. Whatever isn't tested lies in one component already. Where many pairs remain, another centre is met
   before all that remain are tested.
7. Components of the links. ``jaccard_links`` leaves step 6 out and returns every link between classes.

Long lists of a shingle split over tasks by Spark's skew join; no task has more than a list's part or a segment.

Defined cases: a null text or one without words has an empty set and links with nothing; rows that repeat a doc_id
count as copies; a null doc_id gets a null component and takes no part; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange as ex
from tessera.llm import textvec as tv
from tessera.llm.common import shared
from tessera.llm.components import components

SIZE, PERCENT = 3, 90
#: Ranges of digests that each power of two of the count is cut into; a power of two.
PARTS = 4
#: Values of a digest's last bits by which a set's shingles are counted; a power of two. Counts stop at _FULL, where the
#: bound isn't used.
BINS, _FULL = 32, 32_000
#: Rounds in which each class meets one centre; they end as soon as the pairs that remain and may link are at most FEW
#: a posting.
CENTRES, FEW = 3, 2


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests of each text, joined, and each text's first index; one more at the end."""
    _, w = tv.words(texts, lower=True)
    at, whole = tv.inside(w.first, size), tv.runs(w.digest, size, 1)
    count = np.diff(w.first)
    doc, value = np.searchsorted(w.first, at, "right") - 1, whole[at]
    for n in range(1, size):  # short texts: the whole sequence as one
        few = np.flatnonzero(count == n)
        if len(few):
            doc, value = np.concatenate([doc, few]), np.concatenate([value, tv.runs(w.digest, n, 1)[w.first[few]]])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _first_block(t: pa.Table) -> int:
    return t.column("block")[0].as_py()


def _answers(t: pa.Table) -> dict[int, bytes]:
    return dict(zip(t.column("segment").to_pylist(), t.column("answer").to_pylist()))


_SIZES = "doc_id bigint, n_shingles bigint, shingles binary, digest binary"


def sized_sets(docs: DataFrame, size: int, percent: int, block_bytes: int | None, segment_keys: int | None) -> DataFrame:
    """doc_id and n_shingles of every row; shingles and a digest of the set for those that may link."""
    n_bytes, _ = ex.text_size(docs)
    block_bytes, segment_keys = ex.text_sizes(n_bytes, block_bytes, segment_keys)
    sketch = ex.CountMin(max(1, n_bytes // 5), segment_keys=segment_keys)
    blocks = ex.in_blocks(docs, n_bytes, block_bytes)

    def two(values: np.ndarray) -> list[np.ndarray]:
        return [values, tv.mix(values ^ np.uint64(0xD6E8FEB86659FD93))]

    def ask(t: pa.Table) -> pa.Table:
        values, _ = shingle_sets(t.column("text"), size)
        return ex.table_of(sketch.ask(_first_block(t), two(values)), ex.ASK)

    def choose(t: pa.Table, answers: pa.Table) -> pa.Table:
        columns: dict[str, list] = {"doc_id": [], "n_shingles": [], "shingles": [], "digest": []}
        if t.num_rows:
            values, first = shingle_sets(t.column("text"), size)
            total = np.concatenate([[0], np.cumsum(sketch.repeated(two(values), _answers(answers)))])
            n, common = np.diff(first), total[first[1:]] - total[first[:-1]]
            may = (n > 0) & (common >= _needed(n, percent))
            columns["doc_id"], columns["n_shingles"] = t.column("doc_id").to_pylist(), n.tolist()
            for i, held in enumerate(may.tolist()):
                mine = values[first[i] : first[i + 1]]
                columns["shingles"].append(mine.tobytes() if held else None)
                columns["digest"].append(_set_digest(mine) if held else None)
        return ex.table_of(columns, _SIZES)

    answers = blocks.groupBy("block").applyInArrow(ask, ex.ASK).groupBy("segment").applyInArrow(ex.CountMin.answer, ex.ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, _SIZES)


def _set_digest(values: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def cut_sets(classes: DataFrame, percent: int, segment_keys: int | None) -> DataFrame:
    """The classes' sets, without shingles that no other class has, cut into fragments of the global order: one row a
    class and fragment with doc, fragment, part (its digests in order), start (shingles before them), lead (how many of
    them lie in the prefix), n, m (all shingles, those kept), typical (mean count) and bins (kept shingles by BINS
    values of a digest's last bits, which bound overlaps from above). Classes with an empty prefix link with nothing
    and are left out.

    The global order is rarest first by powers of two of the exact count, then by digest; a fragment is one such power
    and one of ``PARTS`` ranges of digests. Counts: blocks ask the shingles' segments, as in ``exchange``.
    """
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    block_keys, segment_keys = ex.sizes(total, ex.BLOCK_KEYS, segment_keys)
    segments = ex.segments_for(total, segment_keys)
    blocks = classes.select(F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-total // block_keys)))).alias("block"), "doc", "n_shingles", "shingles")

    def values_of(t: pa.Table):
        sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])

    def bounds(keys: np.ndarray) -> np.ndarray:
        return ex.by_segment(keys, 64, segments) if segments > 1 else np.array([0, len(keys)])

    def ask(t: pa.Table) -> pa.Table:
        keys, times = np.unique(values_of(t)[0], return_counts=True)
        out: dict[str, list] = {"segment": [], "block": [], "keys": [], "extra": []}
        at = bounds(keys)
        for s in np.flatnonzero(np.diff(at)).tolist():
            out["segment"].append(s)
            out["block"].append(_first_block(t))
            out["keys"].append(ex.pack_sorted(keys[at[s] : at[s + 1]]))
            out["extra"].append(ex.pack(times[at[s] : at[s + 1]].astype(np.uint64)))
        return ex.table_of(out, ex.ASK)

    def answer(t: pa.Table) -> pa.Table:
        keys = [ex.unpack_sorted(x) for x in t.column("keys").to_pylist()]
        times = np.concatenate([ex.unpack(x, "<u8") for x in t.column("extra").to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, weights=times).astype(np.uint64)[where]
        parts = np.split(count, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": t.column("block"), "segment": t.column("segment"), "answer": pa.array([ex.pack(x) for x in parts], pa.binary())})

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _parts(*[np.empty(0, np.int64)] * 7, np.zeros(1, np.int64), np.empty(0), np.empty((0, BINS)))
        values, first = values_of(t)
        keys, where = np.unique(values, return_inverse=True)
        at, told = bounds(keys), _answers(answers)
        count = np.concatenate([ex.unpack(told[s], "<u8") for s in np.flatnonzero(np.diff(at)).tolist()])[where].astype(np.int64)
        rows, n = t.num_rows, np.diff(first)
        owner = np.repeat(np.arange(rows), n)
        typical = np.bincount(owner, weights=count, minlength=rows) / n
        prefix = np.maximum(np.bincount(owner, weights=count > 1, minlength=rows).astype(np.int64) - _needed(n, percent) + 1, 0)
        held = (count > 1) & (prefix[owner] > 0)
        values, owner, band = values[held], owner[held], np.log2(count[held]).astype(np.int64)
        m = np.bincount(owner, minlength=rows)
        fragment = band * PARTS + (values >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
        order = np.lexsort((values, fragment, owner))
        values, owner, fragment = values[order], owner[order], fragment[order]
        new = np.ones(len(values), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
        begin = np.flatnonzero(new)
        doc = owner[begin]
        start = begin - np.concatenate([[0], np.cumsum(m)])[doc]
        lead = np.clip(prefix[doc] - start, 0, np.diff(np.append(begin, len(values))))
        bins = np.bincount(owner * BINS + (values & np.uint64(BINS - 1)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
        ids = t.column("doc").to_numpy()
        return _parts(ids[doc], fragment[begin], start, lead, n[doc], m[doc], values, np.append(begin, len(values)), typical[doc], np.minimum(bins, _FULL)[doc])

    answers = blocks.groupBy("block").applyInArrow(ask, ex.ASK).groupBy("segment").applyInArrow(answer, ex.ANSWER)
    return shared(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, _PARTS))


_PARTS = "doc bigint, fragment bigint, start bigint, lead bigint, n bigint, m bigint, typical double, bins array<smallint>, part array<bigint>"


def _parts(doc, fragment, start, lead, n, m, values, at, typical, bins) -> pa.Table:
    first = lead > 0  # only postings need the bins
    held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first * BINS)]), pa.int32()), pa.array(bins[first].ravel().astype(np.int16)))
    part = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
    columns = [pa.array(x.astype(np.int64)) for x in (doc, fragment, start, lead, n, m)]
    return pa.Table.from_arrays([*columns, pa.array(typical.astype(float)), held, part], ["doc", "fragment", "start", "lead", "n", "m", "typical", "bins", "part"])


def prefix_postings(cut: DataFrame) -> DataFrame:
    """Of each fragment the prefix postings: token, doc, n, m, pos (the token's place among the class's m), typical,
    bins. Of tokens with the very same list of classes one stays: the others propose the same pairs."""
    lead = cut.filter("lead > 0").select("doc", "n", "m", "typical", "bins", "start", F.posexplode(F.slice("part", F.lit(1), F.col("lead").cast("int"))).alias("i", "token"))
    postings = lead.select("token", "doc", "n", "m", (F.col("start") + F.col("i")).alias("pos"), "typical", "bins")
    sign = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "doc"))  # noqa: E731  with the size and twice 64 bits, a list's signature
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), sign(1).alias("s1"), sign(2).alias("s2"))
    kept = lists.filter("size > 1").groupBy("size", "s1", "s2").agg(F.min("token").alias("token")).select("token")
    return shared(postings.join(kept, "token", "left_semi"))


def linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps counted in each fragment, summed per pair."""
    left = cut.select(F.col("doc").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = cut.select(F.col("doc").alias("b"), "fragment", F.col("part").alias("part_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    both = F.col("overlap")
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap")).filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b", "overlap", "na", "nb")


def _can_link(percent: int):
    """Of postings a, b of one token: sizes near enough, and enough shingles that may be common to link: by the
    token's places in both sets, and by the bins of both."""
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100.0 + percent) - 1e-9)
    most = F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb")) + F.least("pa", "pb")
    bins = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + F.when(x < _FULL, x).otherwise(F.lit(1 << 24)))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (most >= least) & (bins >= least)


def _side(postings: DataFrame, x: str, *more: str) -> DataFrame:
    names = {"doc": x, "n": f"n{x}", "m": f"m{x}", "pos": f"p{x}", "bins": f"b{x}", "label": f"l{x}"}
    return postings.select("token", *[F.col(c).alias(names[c]) for c in names if c in postings.columns], *more)


def _across(now: DataFrame) -> DataFrame:
    """Pairs of postings of one token with two labels, each once. One of a pair has another label than most of its list,
    so a list of n postings of which k have such a label compares k * n pairs, and not n * n."""
    most = F.col("label").eqNullSafe(F.col("major"))
    return _side(now.filter(~most), "a").join(_side(now, "b", most.alias("most")), "token").filter("la != lb and (most or a < b)")


def _in_order(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()


def class_links(classes: DataFrame, percent: int, segment_keys: int | None) -> DataFrame:
    """Links (a, b) between classes that have the components of all links."""
    cut = cut_sets(classes, percent, segment_keys)
    postings = prefix_postings(cut)
    n_postings = postings.count()
    labels = links = tested = None
    for step in range(CENTRES + 1):
        now = postings.withColumn("label", F.col("doc")) if labels is None else postings.join(labels, postings.doc == labels.node, "left").withColumn("label", F.coalesce("label", "doc")).drop("node")
        if labels is None:
            now = now.withColumn("major", F.lit(None).cast("bigint"))
        else:  # lists of one label propose nothing more; of the others, "major" is the label that most of a list have
            held = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
            open_lists = held.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("major"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("token", "major")
            now = now.join(open_lists, "token")
        rest = _across(now).filter(_can_link(percent)).select("a", "b", "na", "nb")
        last = step == CENTRES
        if step and not last:
            last = rest.count() <= FEW * n_postings
        if last:
            met = rest
        else:  # a list's centre is its most typical member, in later rounds one by a hash that changes each round
            order = F.struct(F.xxhash64(F.col("doc"), F.lit(step)) if step else -F.col("typical"), F.col("doc"))
            centre = now.groupBy("token").agg(F.min(order).alias("rank"), F.min_by(F.struct("doc", "n", "m", "pos", "bins", "label"), order).alias("x")).select("token", "rank", "x.*")
            near = _side(now, "b").join(_side(centre, "a", "rank"), "token").filter("a != b and la != lb").filter(_can_link(percent))
            met = near.groupBy("b", "nb").agg(F.min_by(F.struct("a", "na"), "rank").alias("c")).select("b", "nb", "c.a", "c.na")
        pairs = _in_order(met)
        pairs = shared(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = shared(linked(pairs, cut, percent))
        links = found if links is None else links.unionByName(found)
        if last:
            break
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        labels = components(links, rounds=2).withColumnRenamed("component", "label")
    return links


def all_links(classes: DataFrame, percent: int, segment_keys: int | None) -> DataFrame:
    """Every link (a, b, overlap, na, nb; a < b) between classes: all candidate pairs that may link are tested, also
    those that lie in one component already. Pairs grow with the square of a group of near copies, as its links do."""
    cut = cut_sets(classes, percent, segment_keys)
    postings = prefix_postings(cut)
    pairs = shared(_side(postings, "a").join(_side(postings, "b"), "token").filter("a < b").filter(_can_link(percent)).select("a", "b", "na", "nb").distinct())
    return linked(pairs, cut, percent)


def _classes(sets: DataFrame) -> DataFrame:
    may = sets.filter("digest is not null and doc_id is not null")
    return shared(may.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("rows"), F.first("shingles").alias("shingles")))


def _may_link(classes: DataFrame, percent: int) -> DataFrame:
    # two sets of under percent / (100 - percent) shingles link only if they are equal
    return classes.filter(F.col("n_shingles") * (100 - percent) >= percent - (100 - percent)).drop("rows", "digest")


def jaccard_links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, block_bytes: int | None = None, segment_keys: int | None = None) -> DataFrame:
    """One row for each linked pair of classes: class_a < class_b (the class_id of ``jaccard_components``), overlap
    (shingles in common), n_a, n_b (shingles). Documents of one class_id link too and have no rows of their own."""
    classes = _classes(shared(sized_sets(docs, size, percent, block_bytes, segment_keys)))
    return all_links(_may_link(classes, percent), percent, segment_keys).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "overlap", F.col("na").alias("n_a"), F.col("nb").alias("n_b"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, block_bytes: int | None = None, segment_keys: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, class_id (least doc_id with an equal set), component_id."""
    sets = shared(sized_sets(docs, size, percent, block_bytes, segment_keys))
    classes = _classes(sets)
    links = class_links(_may_link(classes, percent), percent, segment_keys)
    joined = components(links)
    named = classes.select("digest", "doc", "rows").join(joined, classes.doc == joined.node, "left").select("digest", "rows", F.col("doc").alias("class_id"), F.coalesce("component", "doc").alias("component_id"))
    known = shared(named.filter(F.col("rows") > 1).unionByName(named.filter((F.col("rows") == 1) & (F.col("component_id") != F.col("class_id")))))
    limit = max(1000, (known.agg(F.sum("rows")).first()[0] or 0) // 1000)  # so at most 1000 classes are broadcast
    hot, rest = known.filter(F.col("rows") > limit).drop("rows"), known.filter(F.col("rows") <= limit).drop("rows")
    asked, plain = sets.filter("digest is not null").drop("shingles"), sets.filter("digest is null").drop("shingles")
    told = asked.join(F.broadcast(hot), "digest").unionByName(asked.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left"))
    out = told.unionByName(plain.withColumns({"class_id": F.lit(None).cast("bigint"), "component_id": F.lit(None).cast("bigint")}))
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", "n_shingles", own("class_id"), own("component_id"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id; all columns."""
    gone = jaccard_components(docs, **parameters).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 2)) AS g FROM w, unnest(range(1, greatest(len(words) - 1, least(len(words) + 1, 2)))) AS r(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
may AS MATERIALIZED (SELECT doc_id FROM s JOIN df USING (g) JOIN n USING (doc_id) GROUP BY doc_id, n.n HAVING 100 * count(*) >= 90 * n.n),
m AS MATERIALIZED (SELECT s.* FROM s JOIN may USING (doc_id) JOIN df USING (g)),
pair AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM m x JOIN m y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id
"""
