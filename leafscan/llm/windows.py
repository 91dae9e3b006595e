"""Anchors of windows, and the division of anchors that very many windows share.

Of all windows of a text that hold the same least gram, that gram's place is the anchor.
Equal windows have their anchors at the same distance, so comparing what stands around equal
anchors finds every repeated window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import attach, join_counted, stored

# Places that fit beside the hash they are compared with; longer texts come in stretches.
_PLACE = np.uint64((1 << 23) - 1)
STRETCH = 1 << 22


def winnow(hashes: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """``(place, first, last)`` of each anchor among gram hashes.

    A window is ``reach`` neighbouring grams; those that start from ``first`` to ``last``
    have their least gram at ``place``, the leftmost of equal ones.
    """
    parts = []
    for start in range(0, max(len(hashes) - reach + 1, 0), STRETCH):
        part = hashes[start : start + STRETCH + reach - 1]
        least = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = reach - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        places = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(places, prepend=-1))
        last = np.append(first[1:], len(places)) - 1
        parts.append((places[first] + start, first + start, last + start))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


ROW = ["lead", "left", "right", "node", "other", "place"]


def _part(begin: Column, width: int, length: int, unit: int) -> Column:
    """The row's windows that start ``begin`` to ``begin + width - 1`` symbols before the
    anchor, and what any such windows of other rows have in common with them."""
    n_left, n_right = (F.octet_length(side).cast("int") for side in ("left", "right"))
    end = begin + F.lit(width - 1)
    low = F.greatest(F.lit(length) - (n_right / unit).cast("int"), begin)
    high = F.least((n_left / unit).cast("int"), end)

    def around(before: Column, after: Column) -> tuple[Column, Column]:
        left = F.substr("left", n_left - before * unit + 1, before * unit)
        return left, F.substr("right", F.lit(1), F.greatest(after, F.lit(0)) * unit)

    left, right = around(high, F.lit(length) - low)
    lead = F.concat(*around(begin, F.lit(length) - end))
    part = F.struct(lead.alias("lead"), left.alias("left"), right.alias("right"), begin.alias("start"))
    return F.when(low <= high, part)


def divide(rows: DataFrame, length: int, reach: int, unit: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows with at most ``bucket`` of each lead, and what was found on the way.

    A row ``(lead, left, right, node, other, place)`` stands for the windows of ``length``
    symbols, of ``unit`` bytes each, that start in ``left`` or at the anchor and end in
    ``right``; rows with a common window have the same lead. Where too many rows share one,
    equal rows become one: all their windows repeat, and ``found`` gets
    ``(node, other, begin, end)`` for each of them, in symbols. What is left of them is split
    into the windows that start far before the anchor and those that start near it, each with
    the longer lead that such windows have in common. So a crowd thins out by what its rows
    do not share; a level makes two rows of one at most, and the last leaves single windows.
    """
    width = 1 << (reach - 1).bit_length()
    ready, found, zero = [], [], F.lit(0).cast("long")
    current = rows.select(*ROW, F.lit(0).alias("start"))
    while True:
        crowded = current.groupBy("lead").agg(F.count(F.lit(1)).alias("n_lead")).where(F.col("n_lead") > bucket)
        crowded = stored(crowded)
        if crowded.isEmpty():
            ready.append(current.select(*ROW))
            break
        marked = attach(current, crowded, ["lead"])
        ready.append(marked.where("n_lead is null").select(*ROW))
        name, back = F.md5(F.concat("left", "right")), F.octet_length("left")
        many = marked.where("n_lead is not null").select(*ROW[1:], "start", name.alias("name"), back.alias("back"))
        many, key = stored(many), ["name", "back", "start"]
        one = F.min(F.struct("node", "other", "place", "left", "right")).alias("one")
        names = stored(many.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), one))
        twice = stored(names.where("n > 1").select(*key, "n"))
        begin, end = F.col("place") - F.col("back") / unit, F.col("place") + F.octet_length("right") / unit
        met = join_counted(many, twice, key)
        found.append(met.select("node", "other", begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        if width == 1:
            break
        width //= 2
        parts = F.array(*(_part(F.col("start") + k * width, width, length, unit) for k in (0, 1)))
        halves = names.select("start", "one.*").select("node", "other", "place", F.explode(F.array_compact(parts)).alias("p"))
        current = stored(halves.select("p.lead", "p.left", "p.right", "node", "other", "place", "p.start"))
    nothing = rows.select("node", "other", zero.alias("begin"), zero.alias("end")).where("false")
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, found, nothing)
