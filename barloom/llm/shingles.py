"""Hashed word shingles of whole texts, many texts at once in numpy.

Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased. A word's hash is a
polynomial in its bytes (random odd values, an odd base, 64 bits), taken from prefix sums, then mixed. A
shingle's hash mixes its words' hashes with their places.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from barloom.llm.common import U64, mix64

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C13  # 3 mod 8: base - 1 is divisible by 2 just once


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    size = max(CHUNK + 64, 1 << (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, U64(BASE)), np.full(size, U64(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of byte value times power; a substring's hash is a difference of two, scaled back by its start."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=out[1:])
    return out


def chunks(texts: list[bytes], limit: int = CHUNK):
    """Ranges of texts with about `limit` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums, (_, down) = prefix_sums(data), powers(len(data))
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))
    upto = np.searchsorted(starts, ends_of, side="left")
    return h, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64). Fewer words than width: all of them are one shingle; none: no shingle."""
    raw = [(t or "").encode().lower() for t in texts]
    out: list[np.ndarray] = []
    places = mix64(np.arange(1, width + 1, dtype=U64) * U64(0x8EBC6AF09C88C6E3)) | U64(1)
    for a, b in chunks(raw):
        h, counts = _words(raw[a:b])
        n = max(0, len(h) - width + 1)
        acc = np.zeros(n, dtype=U64)
        for j in range(width):
            acc += h[j : j + n] * places[j]
        acc = mix64(acc)
        at = 0
        for k in counts.tolist():
            if k >= width:
                out.append(np.unique(acc[at : at + k - width + 1]))
            elif k:
                short = (h[at : at + k] * places[:k]).sum(dtype=U64, keepdims=True)
                out.append(mix64(short + np.array([k], dtype=U64) * U64(0xE7037ED1A0B428DB)))
            else:
                out.append(np.empty(0, dtype=U64))
            at += k
    return out
