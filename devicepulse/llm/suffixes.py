"""Suffix order of one piece of text by two-stage sorting, in numpy.

A suffix is *small* if it comes before the suffix that starts one byte later. Only small
suffixes are sorted directly, by their first ``depth`` bytes. The others are induced: the
buckets of first bytes are scanned from the least to the greatest, and each suffix found
puts its predecessor, if that one is not small, behind those already in the predecessor's
bucket. In a bucket the induced suffixes come before the small ones. The scan takes a
bucket at a time; a run of equal bytes takes as many rounds as it is long.

The order is right to ``depth`` bytes at least; suffixes that agree so far come in any
order.
"""

from __future__ import annotations

import numpy as np


def small_suffixes(text: np.ndarray) -> np.ndarray:
    """Which suffixes are less than their successors. The last byte must be 0, and counts
    as followed by zeros for ever."""
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)  # ends of runs
    rises = np.append(text[last[:-1] + 1] > text[last[:-1]], True)
    return np.repeat(rises, np.diff(last, prepend=-1))


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places of ``text``, in the order of the suffixes that start there.

    To induce them, each wanted place needs the places after it up to the next small
    suffix, and no more.
    """
    n = len(text)
    small = small_suffixes(text)
    nearest = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    places = np.flatnonzero(wanted)
    edges = np.bincount(places, minlength=n + 1) - np.bincount(nearest[places] + 1, minlength=n + 1)
    needed = np.cumsum(edges)[:n] > 0

    padded = np.append(text, np.zeros(depth, np.uint8))
    prefixes = np.ndarray(n, f"S{depth}", padded, strides=(1,))
    direct = np.flatnonzero(needed & small)
    direct = direct[np.argsort(prefixes[direct], kind="stable")]
    starts = np.searchsorted(text[direct], np.arange(257))

    induced = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = [np.empty(0, np.int64)]
    for byte in range(256):
        bucket = []
        front = np.concatenate([np.empty(0, np.int64), *waiting[byte]])
        while len(front):
            bucket.append(front)
            before = _before(front, induced)
            front = before[text[before] == byte]
        bucket.append(direct[starts[byte] : starts[byte + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = _before(whole, induced)
        before = before[text[before] > byte]
        before = before[np.argsort(text[before], kind="stable")]
        for part in np.split(before, np.flatnonzero(np.diff(text[before])) + 1):
            if len(part):
                waiting[text[part[0]]].append(part)
        waiting[byte] = []
    found = np.concatenate(order)
    return found[wanted[found]]


def _before(order: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """The predecessors of the suffixes in ``order`` that are to be induced."""
    before = order[order > 0] - 1
    return before[induced[before]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``order``, how many bytes its suffix shares with that of the
    place before it, ``depth`` at most; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    padded = np.append(text, np.zeros(depth + 8, np.uint8))
    words = np.ndarray(len(text) + depth, "<u8", padded, strides=(1,))
    open_ = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = words[order[open_ - 1] + at] ^ words[order[open_] + at]
        # Bits below the lowest that differs, by eight.
        shared[open_] += np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3
        open_ = open_[differ == 0]
    return np.minimum(shared, depth)
