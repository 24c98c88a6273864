"""Questions from blocks of documents to segments of a key space, and their answers, as packed arrays.

Documents are dealt into blocks by a hash of id and text, so rows that repeat an id or have none spread by their texts
(rows alike in both meet in one block, within ``BLOCK_BYTES`` times their share), keys into segments by their leading bits. A block asks each
segment about its distinct keys in one message; the segment, which has all blocks' messages, answers each with one
value per key, in the same order. A key that is in a third of all documents is one entry of each block's message, so no
task gets more of it than there are blocks, and nothing is broadcast or sent to the driver. Both sides are bounded by a
block's text and a segment's keys. Every block may have a message for every segment; were their sizes fixed, messages
would grow with the square of the input until each held a single key. So blocks and segments grow with its square root
(``sizes``): a message holds ``MESSAGE_KEYS`` keys or more, and the number of messages grows as the input does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least bytes of a block's text, shingles of a block of sets, and keys of a segment.
BLOCK_BYTES = 8 << 20
BLOCK_KEYS = 500_000
SEGMENT_KEYS = 2_000_000
#: Keys that a message of a full block to a segment holds at least, on average.
MESSAGE_KEYS = 32
ASK = "segment bigint, block bigint, keys binary, extra binary"
ANSWER = "block bigint, segment bigint, answer binary"
_pack = zstandard.ZstdCompressor(level=1)


def pack(values: np.ndarray) -> bytes:
    """Bytes of integers, byte plane by byte plane, compressed."""
    return _pack.compress(np.ascontiguousarray(values.ravel().view(np.uint8).reshape(values.size, values.itemsize).T).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


def pack_bits(values: np.ndarray) -> bytes:
    return _pack.compress(np.packbits(values).tobytes())


def unpack_bits(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=count).astype(bool)


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes of text and rows of ``docs``."""
    n, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    return int(n or 0), int(rows)


def sizes(keys: int, block_keys: int, segment_keys: int | None = None) -> tuple[int, int]:
    """Keys of a block (``block_keys`` or more) and of a segment for an input of so many keys. A block's keys spread
    over keys / segment size segments, so a message holds block size * segment size / keys: both at least the square
    root of MESSAGE_KEYS * keys make that MESSAGE_KEYS."""
    root = math.isqrt(MESSAGE_KEYS * max(0, keys))
    return max(block_keys, root), segment_keys or max(SEGMENT_KEYS, root)


def text_sizes(n_bytes: int, block_bytes: int | None = None, segment_keys: int | None = None) -> tuple[int, int]:
    """Bytes of a block and keys of a segment for so many bytes of text, about a word in five; what is given stays."""
    block, segment = sizes(n_bytes // 5, BLOCK_BYTES // 5, segment_keys)
    return block_bytes or max(BLOCK_BYTES, 5 * block), segment


def in_blocks(docs: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """doc_id (as long) and text with ``block``, a number below size / block_bytes. Ids must be integers (or null)."""
    if not isinstance(docs.schema["doc_id"].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be an integer column, not {docs.schema['doc_id'].dataType.simpleString()}")
    n = max(1, math.ceil(size / block_bytes))
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return doc.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), "doc_id", "text")


def segments_for(keys: int, segment_keys: int = SEGMENT_KEYS) -> int:
    """A power of two, so that a key's segment is its leading bits."""
    return 1 << max(0, math.ceil(math.log2(max(1, keys / segment_keys))))


def by_segment(keys: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Bounds of the segments in ascending keys of ``bits`` bits; one more than there are segments."""
    step = (1 << bits) // segments
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, segments, dtype=np.uint64) * np.uint64(step)), [len(keys)]]).astype(np.int64)


def table_of(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


class CountMin:
    """A count-min sketch whose rows are kept sparse and cut into segments of cells.

    Row j of the sketch has 2**bits cells; a key's cell is the leading bits of its j-th digest. A block's sketch is the
    cells it touches and whether it counted two there. Segments add the blocks' sketches and answer, for each touched
    cell, whether the merged count is two or more. A key's estimate is the least over the rows, never under its true
    count, so keys estimated below two are certain to be single. A width of at least ``load`` cells a key keeps the
    share of single keys that pass near (1 - exp(-1 / load)) ** depth.
    """

    def __init__(self, keys: int, depth: int = 2, load: int = 2, segment_keys: int = SEGMENT_KEYS):
        self.depth = depth
        self.segments = segments_for(keys, segment_keys)
        self.bits = min(62, max(16, math.ceil(math.log2(max(1, keys * load))), int(math.log2(self.segments))))

    def cells(self, digests: list[np.ndarray], j: int) -> np.ndarray:
        return digests[j] >> np.uint64(64 - self.bits)

    def ask(self, block: int, digests: list[np.ndarray]) -> dict[str, list]:
        """Messages of a block that has keys with these digests (one array a row of the sketch)."""
        out: dict[str, list] = {"segment": [], "block": [], "keys": [], "extra": []}
        for j in range(self.depth):
            cells, times = np.unique(self.cells(digests, j), return_counts=True)
            at = by_segment(cells, self.bits, self.segments)
            for s in np.flatnonzero(np.diff(at)).tolist():
                a, b = at[s], at[s + 1]
                out["segment"].append(j * self.segments + s)
                out["block"].append(block)
                out["keys"].append(pack_sorted(cells[a:b]))
                out["extra"].append(pack_bits(times[a:b] > 1))
        return out

    @staticmethod
    def answer(t: pa.Table) -> pa.Table:
        """All messages of a segment: the merged counts' verdicts, a bit for each asked cell."""
        keys = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
        extra = [unpack_bits(x, len(k)) for x, k in zip(t.column("extra").to_pylist(), keys)]
        sizes = np.array([len(k) for k in keys])
        cells, where, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        twice = times > 1
        twice[where[np.concatenate(extra)]] = True
        bits = np.split(twice[where], np.cumsum(sizes)[:-1])
        return pa.table({"block": t.column("block"), "segment": t.column("segment"), "answer": pa.array([pack_bits(x) for x in bits], pa.binary())})

    def repeated(self, digests: list[np.ndarray], answers: dict[int, bytes]) -> np.ndarray:
        """For each key of a block, whether its estimate is two or more."""
        out = np.ones(len(digests[0]), bool)
        for j in range(self.depth):
            cells, where = np.unique(self.cells(digests, j), return_inverse=True)
            at = by_segment(cells, self.bits, self.segments)
            twice = np.zeros(len(cells), bool)
            for s in np.flatnonzero(np.diff(at)).tolist():
                twice[at[s] : at[s + 1]] = unpack_bits(answers[j * self.segments + s], int(at[s + 1] - at[s]))
            out &= twice[where]
        return out
