"""Sets of characters as sorted ranges of code points."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

LIMIT = 0x110000
Ranges = tuple[tuple[int, int], ...]
ALL: Ranges = ((0, LIMIT - 1),)

# White space, and what a word holds beside letters, marks, digits and
# connectors: the joiners, and symbols that count as letters.
WHITE_SPACE: Ranges = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WORD_EXTRAS: Ranges = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
WORD_CATEGORIES = "L M Nd Nl Pc"


class UnknownSet(ValueError):
    """No set of characters has the name."""


def normal(ranges: Iterable[tuple[int, int]]) -> Ranges:
    """Sorted, with gaps in between."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return tuple(out)


def negated(ranges: Ranges) -> Ranges:
    out, low = [], 0
    for start, end in ranges:
        if start > low:
            out.append((low, start - 1))
        low = end + 1
    return tuple(out + ([(low, LIMIT - 1)] if low < LIMIT else []))


def both(a: Ranges, b: Ranges) -> Ranges:
    return negated(normal(negated(a) + negated(b)))


def holds(ranges: Ranges, point: int) -> bool:
    at = bisect_right(ranges, (point, LIMIT)) - 1
    return at >= 0 and point <= ranges[at][1]


def size(ranges: Ranges) -> int:
    return sum(high - low + 1 for low, high in ranges)


def members(ranges: Ranges) -> list[int]:
    return [point for low, high in ranges for point in range(low, high + 1)]


def _of_flags(flags: np.ndarray) -> Ranges:
    edges = np.flatnonzero(np.diff(np.pad(flags, 1).astype(np.int8)))
    return tuple((int(low), int(high) - 1) for low, high in zip(edges[::2], edges[1::2]))


@lru_cache(maxsize=1)
def _categories() -> np.ndarray:
    return np.array([unicodedata.category(chr(point)) for point in range(LIMIT)], dtype="U2")


@lru_cache(maxsize=256)
def category(names: str) -> Ranges:
    """Characters of general categories, one or two letters each."""
    all_names, flags = _categories(), np.zeros(LIMIT, bool)
    for name in names.split():
        chosen = all_names == name if len(name) == 2 else np.char.startswith(all_names, name)
        if not chosen.any():
            raise UnknownSet(f"unknown category {name}")
        flags |= chosen
    return _of_flags(flags)


@lru_cache(maxsize=256)
def named(name: str) -> Ranges:
    """Characters of a category, script or property by its name."""
    if len(name) <= 2:
        return category(name[0].upper() + name[1:].lower())
    try:
        import regex
    except ImportError as error:
        raise UnknownSet(f"property {name} needs the module regex") from error
    try:
        found = regex.compile(rf"\p{{{name}}}+")
    except regex.error as error:
        raise UnknownSet(f"unknown property {name}") from error
    # surrogates cannot stand in a text
    points = "".join(map(chr, range(LIMIT)))
    return tuple((m.start(), m.end() - 1) for m in found.finditer(points))


@lru_cache(maxsize=1)
def word() -> Ranges:
    return normal(category(WORD_CATEGORIES) + WORD_EXTRAS)


@lru_cache(maxsize=1)
def digit() -> Ranges:
    return category("Nd")


@lru_cache(maxsize=1)
def _cases() -> dict[int, list[int]]:
    """Characters that differ only by case, under each of them."""
    groups: dict[str, list[int]] = {}
    for point in range(0x1F000):
        char = chr(point)
        if char.isalpha() or char.lower() != char or char.upper() != char:
            key = next((k for k in (char.casefold(), char.lower()) if len(k) == 1), char)
            groups.setdefault(key, []).append(point)
    return {point: group for group in groups.values() if len(group) > 1 for point in group}


def any_case(ranges: Ranges) -> Ranges:
    """The characters and their other cases."""
    more = [(other, other) for point, group in _cases().items() if holds(ranges, point) for other in group]
    return normal((*ranges, *more))
