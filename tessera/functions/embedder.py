"""Texts to query vectors."""

from __future__ import annotations

from typing import Protocol

import numpy as np

_M64 = (1 << 64) - 1
#: Fixed values of the public wyhash (final version 4) algorithm.
_SECRET = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class Embedder(Protocol):
    def __call__(self, text: str, dim: int) -> list[float]: ...


def _mum(a: int, b: int) -> tuple[int, int]:
    p = a * b
    return p & _M64, p >> 64


def _mix(a: int, b: int) -> int:
    low, high = _mum(a, b)
    return low ^ high


def wyhash(data: bytes, seed: int = 0) -> int:
    """wyhash of ``data``."""
    word = lambda i, n: int.from_bytes(data[i : i + n], "little")
    n = len(data)
    seed ^= _mix(seed ^ _SECRET[0], _SECRET[1])
    if n <= 16:
        if n >= 4:
            step = (n >> 3) << 2
            a, b = (word(0, 4) << 32) | word(step, 4), (word(n - 4, 4) << 32) | word(n - 4 - step, 4)
        elif n:
            a, b = (data[0] << 16) | (data[n >> 1] << 8) | data[n - 1], 0
        else:
            a = b = 0
    else:
        i, left = 0, n
        if left > 48:
            one = two = seed
            while left > 48:
                seed = _mix(word(i, 8) ^ _SECRET[1], word(i + 8, 8) ^ seed)
                one = _mix(word(i + 16, 8) ^ _SECRET[2], word(i + 24, 8) ^ one)
                two = _mix(word(i + 32, 8) ^ _SECRET[3], word(i + 40, 8) ^ two)
                i, left = i + 48, left - 48
            seed ^= one ^ two
        while left > 16:
            seed = _mix(word(i, 8) ^ _SECRET[1], word(i + 8, 8) ^ seed)
            i, left = i + 16, left - 16
        a, b = word(n - 16, 8), word(n - 8, 8)
    a, b = _mum(a ^ _SECRET[1], b ^ seed)
    return _mix(a ^ _SECRET[0] ^ n, b ^ _SECRET[1])


def hash_embedder(text: str, dim: int) -> list[float]:
    """The default, a placeholder for a model: element i is ((h + i) mod 256) / 255 of the text's hash h, as float32."""
    h = wyhash(text.encode())
    return [float(np.float32(((h + i) & 0xFF) / np.float32(255.0))) for i in range(dim)]
