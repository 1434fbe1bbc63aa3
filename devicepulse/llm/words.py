"""Hashes of the words of many texts at once, on their UTF-8 bytes with numpy.

A word is a longest run of bytes that are no separators; A-Z counts as a-z. Its hash
adds up a random number per byte times a power of an odd base, modulo 2**64, which
running sums give for all words together, and mixes the sum with the length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# Bytes of text that are hashed together; longer texts make a step of their own.
STEP = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * 2 + 1
_BYTES[65:91] = _BYTES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Word hashes per text; ``separators`` are the bytes between words."""

    def __init__(self, separators: bytes = WHITE):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False

    def _hash(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word of ``data``."""
        raw = np.frombuffer(data, np.uint8)
        # Rounded up, so that most steps share their powers.
        room = 1 << max(len(raw), 2 * STEP).bit_length()
        up, down = _powers(_BASE, room), _powers(_INVERSE, room)
        inside = self.inside[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
        return starts, mix(found + (ends - starts).astype(np.uint64))

    def each(self, texts: Iterable[str | bytes | None]) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order; NULL has none."""
        batch, size = [], 0
        for text in texts:
            if not isinstance(text, bytes):
                text = (text or "").encode("utf-8", "surrogatepass")
            batch.append(text)
            size += len(batch[-1]) + 1
            if size >= STEP:
                yield from self._several(batch)
                batch, size = [], 0
        yield from self._several(batch)

    def _several(self, batch: list[bytes]) -> Iterator[np.ndarray]:
        if not batch:
            return
        starts, found = self._hash(b" ".join(batch))
        ends = np.cumsum([len(b) + 1 for b in batch])
        yield from np.split(found, np.searchsorted(starts, ends[:-1]))
