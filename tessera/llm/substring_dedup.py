"""Removal of word passages that an earlier document has, found by a count-min prefilter.

A window is ``window`` consecutive words (runs of bytes other than space and \\t \\n \\v \\f \\r) of one document. Pass
one counts every window of every document in count-min sketches, one a block of documents, which are merged (see
``exchange.CountMin``). Estimates never fall below true counts, so windows estimated single are single: none is lost.
Pass two groups only the windows estimated repeated, exactly, by 128-bit digests of their words, and takes the least
doc_id of each. A word goes if a window covers it whose words also start in a document with a smaller doc_id.

Texts shuffle once, by block; the three passes over them read the same shuffle files. A window in very many documents
is one entry of each block's message. The sketch's width follows the number of windows, its cells are never gathered in
one place, and each message costs about a byte a window and row of the sketch.

Defined cases: a null text has no words; a text of fewer words than a window keeps all of them; a null doc_id counts
as larger than any other; rows that repeat a doc_id are judged alike and don't remove each other's words; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange as ex
from tessera.llm import textvec as tv

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max


class _Block:
    """The windows of a block's documents, and the distinct ones among those estimated repeated."""

    def __init__(self, docs: pa.Table, window: int):
        self.ids = docs.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.raw, self.words = tv.words(docs.column("text"))
        self.at = tv.inside(self.words.first, window)
        self.digests = [tv.runs(self.words.digest, window, seed)[self.at] for seed in (1, 2)]

    def candidates(self, sketch: ex.CountMin, answers: dict[int, bytes]):
        """Distinct repeated windows in order of digest: two digest arrays, least doc_id; and each occurrence's number."""
        held = np.flatnonzero(sketch.repeated(self.digests, answers))
        h1, h2 = (x[held] for x in self.digests)
        doc = self.ids[np.searchsorted(self.words.first, self.at[held], "right") - 1]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, held = h1[order], h2[order], doc[order], held[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return h1[new], h2[new], doc[new], self.at[held], doc, np.cumsum(new) - 1


def _first_block(t: pa.Table) -> int:
    return t.column("block")[0].as_py()


def _answers(t: pa.Table) -> dict[int, bytes]:
    return dict(zip(t.column("segment").to_pylist(), t.column("answer").to_pylist()))


def repeated_passages(docs: DataFrame, window: int = WINDOW, block_bytes: int | None = None, segment_keys: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_text (the kept words, one space between) and
    removed (array of word ranges from, to). Blocks and segments follow the input's size where they aren't given."""
    size, _ = ex.text_size(docs)
    block_bytes, segment_keys = ex.text_sizes(size, block_bytes, segment_keys)
    windows = max(1, size // 5)  # about a word in five bytes; sets the sketch's width, not its correctness
    sketch = ex.CountMin(windows, segment_keys=segment_keys)
    shift = np.uint64(64 - int(np.log2(sketch.segments))) if sketch.segments > 1 else None
    blocks = ex.in_blocks(docs, size, block_bytes)

    def ask(t: pa.Table) -> pa.Table:
        return ex.table_of(sketch.ask(_first_block(t), _Block(t, window).digests), ex.ASK)

    def group(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"segment": [], "block": [], "keys": [], "extra": []}
        if t.num_rows:
            h1, h2, least, *_ = _Block(t, window).candidates(sketch, _answers(answers))
            at = ex.by_segment(h1, 64, sketch.segments) if shift is not None else np.array([0, len(h1)])
            for s in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[s], at[s + 1])
                out["segment"].append(-1 - s)
                out["block"].append(_first_block(t))
                out["keys"].append(ex.pack_sorted(h1[part]))
                out["extra"].append(ex.pack(np.concatenate([h2[part], least[part].astype(np.uint64)])))
        return ex.table_of(out, ex.ASK)

    def resolve(t: pa.Table) -> pa.Table:
        """For each asked window, whether a block has it with a smaller doc_id than the asker's least."""
        keys = [ex.unpack_sorted(x) for x in t.column("keys").to_pylist()]
        more = [ex.unpack(x, "<u8").reshape(2, -1) for x in t.column("extra").to_pylist()]
        h1, h2 = np.concatenate(keys), np.concatenate([x[0] for x in more])
        least = np.concatenate([x[1] for x in more]).astype(np.int64)
        order = np.lexsort((least, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        best = least[order][new][np.cumsum(new) - 1]
        earlier = np.empty(len(order), bool)
        earlier[order] = best < least[order]
        bits = np.split(earlier, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": t.column("block"), "segment": t.column("segment"), "answer": pa.array([ex.pack_bits(x) for x in bits], pa.binary())})

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _out([], [], [], [], [])
        block, told = _Block(t, window), _answers(answers)
        h1, _, least, at, doc, number = block.candidates(sketch, told)
        bounds = ex.by_segment(h1, 64, sketch.segments) if shift is not None else np.array([0, len(h1)])
        earlier = np.zeros(len(h1), bool)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            earlier[bounds[s] : bounds[s + 1]] = ex.unpack_bits(told[-1 - s], int(bounds[s + 1] - bounds[s]))
        hit = at[earlier[number] | (doc > least[number])]
        first, n = block.words.first, len(block.words.starts)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        raw, starts, ends = block.raw.tobytes(), block.words.starts.tolist(), block.words.ends.tolist()
        texts, removed = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            mine = gone[a:b]
            if not mine.any():
                texts.append(b" ".join(raw[starts[a] : ends[b - 1]].split()).decode() if b > a else "")
                removed.append([])
                continue
            texts.append(b" ".join([raw[starts[i] : ends[i]] for i in (np.flatnonzero(~mine) + a).tolist()]).decode())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            removed.append([{"from": x, "to": y} for x, y in edge.reshape(-1, 2).tolist()])
        total = np.concatenate([[0], np.cumsum(gone)])
        return _out(t.column("doc_id"), np.diff(first), total[first[1:]] - total[first[:-1]], texts, removed)

    asked = blocks.groupBy("block").applyInArrow(ask, ex.ASK)
    answers = asked.groupBy("segment").applyInArrow(ex.CountMin.answer, ex.ANSWER)
    grouped = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(group, ex.ASK)
    both = answers.unionByName(grouped.groupBy("segment").applyInArrow(resolve, ex.ANSWER))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<from: bigint, to: bigint>>")


def _out(ids, n_words, n_removed, texts, removed) -> pa.Table:
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    ids = ids.cast(pa.int64()) if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64())
    return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string()), "removed": pa.array(removed, span)})


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
occ AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS win FROM w, unnest(range(1, len(words) - 11)) AS r(i) WHERE len(words) >= 13),
least AS (SELECT win, min(doc_id) AS m FROM occ GROUP BY win),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM occ JOIN least USING (win) WHERE m < doc_id), unnest(range(i, i + 13)) AS r(p)),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) p
  LEFT JOIN hit h ON h.doc_id = p.doc_id AND h.p = p.i WHERE h.p IS NULL GROUP BY p.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
