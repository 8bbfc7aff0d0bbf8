"""Numpy views of a batch of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd multiplier; powers of it and of its inverse modulo 2^64 make substring hashes two look-ups.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are handled at once, one longer text apart.
STEP = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, STEP + (STEP >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (bytes between white space) of a byte array."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], WHITE[raw], [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, starts): runs of texts of about ``STEP`` bytes, each text followed by one line feed."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < STEP):
            size += len(raws[hi]) + 1
            hi += 1
        sizes = np.array([len(r) + 1 for r in raws[lo:hi]])
        yield lo, hi, np.frombuffer(b"\n".join(raws[lo:hi]) + b"\n", np.uint8), np.cumsum(sizes) - sizes
        lo = hi
