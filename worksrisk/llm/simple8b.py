"""Simple-8b: unsigned integers in 64-bit words, vectorised with numpy.

The upper 4 bits of a word select how many numbers share its other 60 bits. Numbers of more
than 20 bits are escapes: their place holds 0, and place and value stand in a list beside the
words, so one large number does not widen its neighbours.
"""

from __future__ import annotations

import numpy as np

# fixed values of the format: numbers per word and bits per number, by selector from 2
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
FIRST = 2
ESCAPE_BITS = 20

_COUNT_OF = np.zeros(16, np.int64)
_COUNT_OF[FIRST:] = COUNTS


def encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape places and escape values of an array of numbers below 2^64."""
    values = np.ascontiguousarray(numbers, np.uint64)
    n = len(values)
    at = np.flatnonzero(values >> np.uint64(ESCAPE_BITS))
    escaped = values[at]
    padded = np.zeros(n + max(COUNTS), np.uint64)
    padded[:n] = values
    padded[at] = 0
    values = padded[:n]
    # for each place, the selector that fits most of the numbers from there on; one of more,
    # narrower numbers fits only where the one before it does
    places = np.arange(n)
    selector = np.full(n, len(COUNTS) - 1, np.int64)
    widest = int(values.max()).bit_length() if n else 0
    for s in range(len(COUNTS) - 2, -1, -1):
        if BITS[s] >= widest:
            selector[:] = s
            continue
        too_large = np.append(np.flatnonzero(values >= np.uint64(1 << BITS[s])), n + max(COUNTS))
        following = too_large[np.searchsorted(too_large, places)] if 16 * len(places) < n else np.repeat(
            too_large, np.diff(too_large, prepend=-1))[places]
        places = places[following - places >= COUNTS[s]]
        if not len(places):
            break
        selector[places] = s
    steps = _COUNT_OF[selector + FIRST].tolist()
    starts, place = [], 0
    while place < n:
        starts.append(place)
        place += steps[place]
    starts = np.array(starts, np.int64)
    chosen = selector[starts] if n else selector
    words = (chosen + FIRST).astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        lanes = np.arange(COUNTS[s])
        taken = padded[starts[own][:, None] + lanes]
        words[own] |= np.bitwise_or.reduce(
            taken << (lanes * BITS[s]).astype(np.uint64), axis=1)
    return words, at.astype(np.uint64), escaped


def decode(words: np.ndarray, n: int, at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` numbers of :func:`encode`'s words and escapes."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT_OF[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + max(COUNTS), np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        lanes, bits = np.arange(COUNTS[s - FIRST]), BITS[s - FIRST]
        out[starts[own][:, None] + lanes] = (
            words[own][:, None] >> (lanes * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[at.astype(np.int64)] = escaped
    return out
