"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .token_store import Remembered

#: Words whose hashes a task keeps (twice as many at most, about 0.2 KB each).
_KEPT = 50_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of `width` words, ascending by hash; a text of fewer words is one shingle, one without words none.

    Words are runs of anything but the ASCII white space 0x20 and 0x09 to 0x0D, with A-Z in lower case.
    """

    def __init__(self, width: int):
        self.width = width
        self.known = Remembered(xxhash.xxh3_64_intdigest, _KEPT)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        self.known.trim()
        n = len(h) - self.width + 1
        if n < 1:
            h, n, span = h[:, None], 1, len(h)
            out = np.full(1, span, np.uint64)
            for i in range(span):
                out = _mix(out * _K1 + h[i] + _K2)
            return out
        out = np.full(n, self.width, np.uint64)
        for i in range(self.width):
            out = _mix(out * _K1 + h[i : i + n] + _K2)
        return np.unique(out)
