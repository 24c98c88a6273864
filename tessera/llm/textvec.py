"""Whole batches of text as numpy arrays: word bounds, word digests, window digests.

A batch is one byte buffer with document offsets, as Arrow holds it. Words never cross a document's bounds. A word's
digest is a polynomial over its bytes, taken from prefix sums modulo 2**64 and then mixed, so no Python code runs per
word. Buffers are hashed in pieces, which bounds memory for very long texts and very long words alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_MASK = (1 << 64) - 1

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers), in place on a fresh array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def _power(base: int) -> np.ndarray:
    if base not in _powers:
        out = np.empty(PIECE + 1, np.uint64)
        out[0] = 1
        step = np.uint64(base)
        done = 1
        while done < len(out):  # doubling: out[done:2*done] = out[:done] * base**done
            take = min(done, len(out) - done)
            out[done : done + take] = out[:take] * np.uint64(pow(int(step), done, 1 << 64))
            done += take
        _powers[base] = out
    return _powers[base]


@dataclass
class Words:
    starts: np.ndarray  # byte bounds in the buffer
    ends: np.ndarray
    first: np.ndarray  # for each document, the index of its first word; one more at the end
    digest: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 4 << 20):
    """Row ranges of a column whose texts have about ``most`` bytes together (one row at least)."""
    _, at = buffer(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def pieces(raw: np.ndarray, kind: np.ndarray, size: int = PIECE):
    """Byte ranges of about ``size`` of one text, cut only where the kind of byte changes (so no run is cut)."""
    a, n = 0, len(raw)
    while a < n:
        b = a + size
        while b < n:
            part = kind[raw[b - 1 : b + size]]
            change = np.flatnonzero(part[1:] != part[:-1])
            if len(change):
                b += int(change[0])
                break
            b += size
        yield a, min(b, n)
        a = b


def bounds(raw: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and each document's first word, for words of bytes that aren't in ``gap``."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~gap[raw]
    change = inside[1:] & ~inside[:-1]
    cut = at[(at > 0) & (at < len(raw))]
    cut = cut[inside[cut + 1] & inside[cut]]
    starts = np.flatnonzero(change)
    stop = np.flatnonzero(inside[:-1] & ~inside[1:])
    if len(cut):
        cut = np.unique(cut)
        starts, stop = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stop, cut]))
    return starts, stop, np.searchsorted(starts, at, "left")


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Digests of byte spans in ascending order of start; they may overlap inside ``PIECE`` bytes."""
    out = np.empty(len(starts), np.uint64)
    values, power, inverse = _VALUES[lower], _power(_MUL), _power(_INV)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + PIECE // 2, "left"))
        if int(ends[i:j].max()) - base > PIECE:
            j = i + max(1, int(np.argmax(ends[i:j] - base > PIECE)))
        if int(ends[i:j].max()) - base > PIECE:
            out[i] = _long(raw[base : int(ends[i])], values, power)
            i += 1
            continue
        piece = raw[base : int(ends[i:j].max())]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_INV))


def _long(raw: np.ndarray, values: np.ndarray, power: np.ndarray) -> np.uint64:
    total = 0
    for k in range(0, len(raw), PIECE):
        piece = raw[k : k + PIECE]
        total = (total + int((values[piece] * power[: len(piece)]).sum(dtype=np.uint64)) * pow(_MUL, k, 1 << 64)) & _MASK
    return np.uint64(total)


def prefixes(grid: np.ndarray) -> np.ndarray:
    """For rows of bytes, sums from which ``span_of`` has the digests of spans."""
    out = np.zeros((grid.shape[1] + 1, len(grid)), np.uint64)
    for d in range(grid.shape[1]):
        out[d + 1] = out[d] + _VALUES[False][grid[:, d]] * _power(_MUL)[d]
    return out


def span_of(prefix: np.ndarray, rows: np.ndarray, start: int, end: int) -> np.ndarray:
    """Digests, as ``spans`` gives them, of bytes start to end of the given rows."""
    return mix((prefix[end, rows] - prefix[start, rows]) * _power(_INV)[start] + np.uint64((end - start) * _INV & _MASK))


def words(texts: pa.Array, gap: np.ndarray = ASCII_SPACE, lower: bool = False) -> tuple[np.ndarray, Words]:
    raw, at = buffer(texts)
    starts, ends, first = bounds(raw, at, gap)
    return raw, Words(starts, ends, first, spans(raw, starts, ends, lower))


def runs(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Digests of every ``size`` consecutive values (across document bounds too; see ``inside``)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = int(mix(np.array([seed * 2 + 1], np.uint64))[0]) | 1
    out, done, power, level = np.zeros(n, np.uint64), 0, 1, values.astype(np.uint64)
    rest = size
    while rest:
        if rest & 1:
            out += level[done : done + n] * np.uint64(pow(base, done, 1 << 64))
            done += power
        rest >>= 1
        if rest:
            level = level[: len(level) - power] + level[power:] * np.uint64(pow(base, power, 1 << 64))
            power *= 2
    return mix(out + np.uint64(size))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the windows of ``size`` words that lie in one document."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    keep = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(keep, first[:-1], (count > 0).astype(np.int32))
    np.add.at(keep, first[:-1] + count, -(count > 0).astype(np.int32))
    return np.flatnonzero(np.cumsum(keep)[:-1] > 0)
