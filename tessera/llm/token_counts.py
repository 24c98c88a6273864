"""Token counts of a unigram tokenizer, by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its runs of bytes other than space and \\t \\n \\v \\f \\r, each with the word mark before it.
A pre-token's tokens are the pieces of its best split: the greatest sum of piece scores, and of equal sums the fewest
pieces. A byte that is in no piece of a split is a token of its own, at a cost below every piece's.

In each batch the distinct pre-tokens form a trie. It is walked depth by depth in numpy: all nodes of one depth (bytes
of the prefix) get their forward score and count at once, from the nodes up to the longest piece above them, so a
prefix that many pre-tokens share is scored once. The count stored where a pre-token ends is its number of tokens, and
a text's count is the sum over its pre-tokens. Pre-tokens of over ``LONG`` bytes (text without spaces) are first cut
wherever no piece that occurs in them crosses, which no split can tell; the distinct parts enter the trie like
pre-tokens. A part that is still longer is scored alone by the same recurrence. Nothing shuffles; the vocabulary (a few MB at most) is broadcast.

Piece scores: a vocabulary file of the byte-pair kind has ranks and no probabilities; ``zipf_scores`` gives the piece of
rank r the log probability -log(r + 1). Vocabularies are read, never trained.

Defined cases: null, empty and blank texts have 0 tokens; repeated rows count alike; an empty table gives an empty
result; all input columns stay and a clashing name is replaced by the operator's own column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv

MARK = "▁"
LONG = 64
#: Pre-tokens of one trie, which bounds its memory; neighbours in order, so shared prefixes stay together.
TRIE_WORDS = 1 << 17
_LEAD = 22
BYTE_COST = 10.0
#: The file of the registered query; every operator takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model in order of rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def zipf_scores(pieces: list[str]) -> list[float]:
    return [-float(np.log(r + 1.0)) for r in range(1, len(pieces) + 1)]


def _digests(items: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in items])
    return tv.spans(np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


@dataclass
class Vocabulary:
    keys: np.ndarray  # digests of the pieces, sorted
    scores: np.ndarray
    lengths: np.ndarray  # lengths in bytes that occur
    byte: float  # the score of a byte token
    held: np.ndarray  # by a digest's leading bits, whether a piece has them

    @staticmethod
    def of(pieces: list[str], scores: list[float]) -> Vocabulary:
        if not pieces:
            return Vocabulary(np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64), -BYTE_COST, np.zeros(1 << _LEAD, bool))
        raw = [p.encode() for p in pieces]
        keys, order = np.unique(_digests(raw), return_index=True)
        held = np.zeros(1 << _LEAD, bool)
        held[keys >> np.uint64(64 - _LEAD)] = True
        return Vocabulary(keys, np.asarray(scores, float)[order], np.unique([len(x) for x in raw]), min(scores) - BYTE_COST, held)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the digests are pieces, and their scores."""
        may = np.flatnonzero(self.held[digests >> np.uint64(64 - _LEAD)])
        if not len(may):
            return may, np.empty(0)
        at = np.minimum(np.searchsorted(self.keys, digests[may]), len(self.keys) - 1)
        same = self.keys[at] == digests[may]
        return may[same], self.scores[at[same]]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token (distinct, none empty)."""
        size = np.array([len(x) for x in words], np.int64)
        out = np.zeros(len(words), np.int64)
        long = np.flatnonzero(size > LONG)
        if len(long):
            parts, owner = self._cut([words[k] for k in long.tolist()])
            number = {part: i for i, part in enumerate(dict.fromkeys(parts))}
            alike = list(number)
            whole = [i for i, part in enumerate(alike) if len(part) > LONG]
            counts = np.zeros(len(alike), np.int64)
            counts[whole] = [self._alone(alike[i]) for i in whole]
            short = [i for i, part in enumerate(alike) if len(part) <= LONG]
            counts[short] = self.counts([alike[i] for i in short])
            np.add.at(out, long[owner], counts[[number[part] for part in parts]])
        short = np.flatnonzero(size <= LONG)
        if len(short):
            order = sorted(short.tolist(), key=words.__getitem__)
            for k in range(0, len(order), TRIE_WORDS):
                part = order[k : k + TRIE_WORDS]
                out[part] = self._trie([words[i] for i in part])
        return out

    def _cut(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words cut wherever no piece that occurs in them crosses, and each part's word: a best split of the parts
        is a best split of the word."""
        parts, owner = [], []
        for k, word in enumerate(words):
            raw, n = np.frombuffer(word, np.uint8), len(word)
            crossed = np.zeros(n + 1, np.int32)
            for length in self.lengths[self.lengths <= n].tolist():
                if length < 2:
                    continue
                for base in range(length, n + 1, 1 << 18):
                    ends = np.arange(base, min(n + 1, base + (1 << 18)))
                    hit = ends[self.find(tv.spans(raw, ends - length, ends))[0]]
                    crossed[hit - length + 1] += 1
                    crossed[hit] -= 1
            at = [0, *(np.flatnonzero(np.cumsum(crossed)[1:n] == 0) + 1).tolist(), n]
            parts += [word[a:b] for a, b in zip(at[:-1], at[1:])]
            owner += [k] * (len(at) - 1)
        return parts, np.array(owner)

    def _trie(self, words: list[bytes]) -> np.ndarray:
        """Sorted pre-tokens: those that share a prefix are neighbours, so a node is a range of them."""
        n, size = len(words), np.array([len(x) for x in words], np.int64)
        depth = int(size.max())
        grid = np.zeros((n, depth), np.uint8)
        grid[np.arange(depth) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        differ = np.ones((n, depth), bool)  # whether a word's prefix up to this byte is a new node
        differ[1:] = np.logical_or.accumulate((grid[1:] != grid[:-1]) | (np.arange(depth) >= np.minimum(size[1:], size[:-1])[:, None]), axis=1)
        prefix = tv.prefixes(grid)
        # forward score and count of the node at each depth, by word; node_of gives a word's node
        score = [np.zeros(1)]
        count = [np.zeros(1, np.int64)]
        node_of = [np.zeros(n, np.int32)]
        out = np.zeros(n, np.int64)
        for d in range(1, depth + 1):
            alive = size >= d
            new = differ[:, d - 1] & alive
            first = np.flatnonzero(new)
            node = (np.cumsum(new) - 1).astype(np.int32)
            above = node_of[d - 1][first]
            best, fewest = score[d - 1][above] + self.byte, count[d - 1][above] + 1
            for length in self.lengths[self.lengths <= d].tolist():
                hit, found = self.find(tv.span_of(prefix, first, d - length, d))
                if not len(hit):
                    continue
                above = node_of[d - length][first[hit]]
                value, pieces = score[d - length][above] + found, count[d - length][above] + 1
                better = (value > best[hit] + 1e-9) | ((value > best[hit] - 1e-9) & (pieces < fewest[hit]))
                best[hit[better]], fewest[hit[better]] = value[better], pieces[better]
            score.append(best)
            count.append(fewest)
            node_of.append(node)
            ending = np.flatnonzero(size == d)
            out[ending] = fewest[node[ending]]  # the terminal's count
        return out

    def _alone(self, word: bytes) -> int:
        raw, longest = np.frombuffer(word, np.uint8), int(self.lengths.max(initial=1))
        keep = longest + 1
        score, count = [0.0] * keep, [0] * keep  # a ring of the last positions
        step = 4096
        for base in range(0, len(word), step):
            top = min(len(word), base + step)
            found = {}
            for length in self.lengths.tolist():
                ends = np.arange(max(base + 1, length), top + 1)
                if len(ends):
                    got = self.find(tv.spans(raw, ends - length, ends))
                    for k, value in zip(*(x.tolist() for x in got)):
                        found.setdefault(int(ends[k]), []).append((length, value))
            for d in range(base + 1, top + 1):
                best, fewest = score[(d - 1) % keep] + self.byte, count[(d - 1) % keep] + 1
                for length, value in found.get(d, ()):
                    v, p = score[(d - length) % keep] + value, count[(d - length) % keep] + 1
                    if v > best + 1e-9 or (v > best - 1e-9 and p < fewest):
                        best, fewest = v, p
                score[d % keep], count[d % keep] = best, fewest
        return count[len(word) % keep]


def counts_of(texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    mark = MARK.encode()
    for i, j in tv.slices(texts, 8 << 20):
        raw, w = tv.words(texts.slice(i, j - i))
        _, one, where = np.unique(w.digest, return_index=True, return_inverse=True)
        data = raw.tobytes()
        counts = vocabulary.counts([mark + data[a:b] for a, b in zip(w.starts[one].tolist(), w.ends[one].tolist())])
        total = np.concatenate([[0], np.cumsum(counts[where])])
        out[i:j] = total[w.first[1:]] - total[w.first[:-1]]
    return out


def token_counts(docs: DataFrame, pieces: list[str], scores: list[float]) -> DataFrame:
    """All columns of ``docs`` and n_tokens."""
    names = [c for c in docs.columns if c != "n_tokens"]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at, held = names.index("text"), docs.sparkSession.sparkContext.broadcast(Vocabulary.of(pieces, scores))

    def run(batches):
        for b in batches:
            yield b.append_column("n_tokens", pa.array(counts_of(b.column(at), held.value), pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    return inner.mapInArrow(run, f"{fields}, n_tokens bigint").toDF(*names, "n_tokens")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    pieces = read_pieces(VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, pieces, zipf_scores(pieces)).select("doc_id", "n_tokens")
