"""Word shingles of a text as sets of 64-bit hashes, a whole text at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WIDTH = 5
_seeded = np.random.default_rng(20240)
_odd = lambda n: _seeded.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
_SYMBOLS, _SHIFTS, _BASE = _odd(256), _odd(WIDTH), _odd(1)[0]
_SYMBOLS[ord("A") : ord("Z") + 1] = _SYMBOLS[ord("a") : ord("z") + 1]
# The same with upper and lower case apart.
CASED = _odd(256)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Text that is hashed at once, in bytes; a longer one is cut at white space.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(raw: np.ndarray):
    start = 0
    while len(raw) - start > BLOCK:
        spaces = np.flatnonzero(_SPACE[raw[start : start + BLOCK]])
        end = start + (spaces[-1] + 1 if len(spaces) else BLOCK)
        while not len(spaces) and end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def word_hashes(text: str, symbols: np.ndarray = _SYMBOLS) -> np.ndarray:
    """A hash of each word of a text, in order; A-Z count as a-z unless ``symbols`` is CASED."""
    out = []
    for raw in _blocks(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)):
        space = _SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        place = np.arange(len(raw)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        place[: starts[0]] = 0
        powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
        powers[0] = 1
        values = symbols[raw] * np.cumprod(powers)[place]
        values[space] = 0
        out.append(mixed(np.add.reduceat(values, starts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words at once if there are fewer."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(n, WIDTH)
    sums = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        sums += words[i : n - width + 1 + i] * _SHIFTS[i]
    return np.unique(mixed(sums))


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of shingles; equal sets, and so equal texts, share it."""
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
