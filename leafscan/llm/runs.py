"""Periodic runs of words, found by internal pattern matching.

A run repeats a period of q words MIN_EXPONENT times or more. For the least power of two b
from q on, it holds a block of b words that starts at a multiple of b / 2 and stands again q
words further on, still inside the run; as b is at least q, it stands nowhere in between. So
all dyadic blocks ask where they occur next within the b words that follow. Equal blocks are
an interval of the suffix array, and the next place in that interval is a range successor
query to a wavelet matrix over it. The occurrences in such a window are a progression whose
difference is the only candidate period; comparing words to both sides gives the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import WORD, map_rows, null_free
from leafscan.llm.shingles import CASED, mixed, word_hashes
from leafscan.llm.suffixes import raw_bytes

# A run has so many words, and its period so many times.
MIN_WORDS, MIN_EXPONENT = 6, 4
# The shortest block; it serves all periods up to its length.
LEAST_BLOCK = 4
# Texts are searched together until they have so many words.
GROUP_WORDS = 1 << 17


class WaveletMatrix:
    """Order statistics of intervals of a sequence of numbers, for many intervals at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.ones, self.zeros = [], []
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _levels(self) -> Iterator[tuple[int, np.ndarray, int]]:
        return zip(range(self.bits - 1, -1, -1), self.ones, self.zeros)

    def count_below(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than its bound."""
        below = np.zeros(len(begin), np.int64)
        for shift, ones, zeros in self._levels():
            high = (bound >> shift & 1).astype(bool)
            begin1, end1 = ones[begin], ones[end]
            below += np.where(high, (end - end1) - (begin - begin1), 0)
            begin = np.where(high, zeros + begin1, begin - begin1)
            end = np.where(high, zeros + end1, end - end1)
        return below

    def smallest(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each interval that exactly ``k`` others of it precede in order."""
        value = np.zeros(len(begin), np.int64)
        for shift, ones, zeros in self._levels():
            begin1, end1 = ones[begin], ones[end]
            low = (end - end1) - (begin - begin1)
            high = k >= low
            k = np.where(high, k - low, k)
            value += np.where(high, 1 << shift, 0)
            begin = np.where(high, zeros + begin1, begin - begin1)
            end = np.where(high, zeros + end1, end - end1)
        return value

    def successor(self, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least value of each interval above the one given, or -1."""
        below = self.count_below(begin, end, value + 1)
        found = below < end - begin
        out = np.full(len(begin), -1, np.int64)
        out[found] = self.smallest(begin[found], end[found], below[found])
        return out


def block_intervals(symbols: np.ndarray, most: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The suffix array, and for each dyadic length from LEAST_BLOCK to ``most`` the interval
    of it that shares each suffix's first words.

    Doubling: suffixes that tie on h words are ordered by those after them; what no longer
    ties rests. Suffixes that tie on ``most`` words stay in any order.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank, width, levels = np.full(n + 1, -1, np.int64), 1, {}
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts, sizes)
        if width >= LEAST_BLOCK:
            size = np.empty(n, np.int64)
            size[order] = np.repeat(sizes, sizes)
            levels[width] = rank[:n].copy(), size
        tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if width >= most or not len(tied):
            return order, levels
        rows = order[tied]
        own, after = rank[rows], rank[np.minimum(rows + width, n)]
        by = np.argsort(own * (n + 1) + after + 1, kind="stable")
        order[tied] = rows[by]
        own, after = own[by], after[by]
        differs = np.ones(len(tied), bool)
        differs[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new[tied] = differs
        width *= 2


def candidates(symbols: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """``(block length, place, period)`` of blocks that stand again within their length."""
    order, levels = block_intervals(symbols, most)
    if LEAST_BLOCK not in levels:
        return
    # blocks that stand once in all their text have no successor and are left out of the tree
    shared = levels[LEAST_BLOCK][1][order] > 1
    tree, before = WaveletMatrix(order[shared]), np.concatenate([[0], np.cumsum(shared)])
    for width, (start, size) in levels.items():
        places = np.arange(0, len(symbols), max(width // 2, 1))
        places = places[size[places] > 1]
        begin, end = before[start[places]], before[start[places] + size[places]]
        step = tree.successor(begin, end, places) - places
        fits = (step > (width // 2 if width > LEAST_BLOCK else 0)) & (step <= width)
        yield from zip([width] * int(fits.sum()), places[fits].tolist(), step[fits].tolist())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, done, size = min(len(a), len(b)), 0, 64
    while done < n:
        differ = np.flatnonzero(a[done : min(done + size, n)] != b[done : min(done + size, n)])
        if len(differ):
            return done + int(differ[0])
        done, size = done + size, 2 * size
    return n


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, as hashes of its words, its runs ``(start, length, period)`` in order."""
    found: list[set] = [set() for _ in texts]
    if not texts:
        return []
    ends = np.cumsum([len(text) for text in texts])
    whole = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    # words of different texts never match
    symbols = mixed(whole + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    most = max(LEAST_BLOCK, 1 << max(max(map(len, texts)) // MIN_EXPONENT - 1, 0).bit_length())
    last = (0, 0, 0, 0)
    for width, place, period in candidates(symbols, most):
        if last[0] == width and last[3] == period and last[1] <= place and place + width + period <= last[2]:
            continue  # a block of the run found before
        doc = owner[place]
        begin, end = int(ends[doc]) - len(texts[doc]), int(ends[doc])
        forward = _common(whole[place:end], whole[place + period : end])
        backward = _common(whole[begin:place][::-1], whole[begin + period : place + period][::-1])
        last = width, place - backward, place + forward + period, period
        length = last[2] - last[1]
        if length >= max(MIN_WORDS, MIN_EXPONENT * period):
            found[doc].add((last[1] - begin, length, period))
    return [sorted((start, length, period) for start, length, period in runs) for runs in found]


RUNS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def collapse(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``(doc_id, text)``.

    ``runs`` lists the stretches of words ``(start, length, period)`` with their least period
    that have MIN_WORDS words and MIN_EXPONENT periods and cannot be extended, by start, then
    period. ``collapsed`` holds the words, joined by a space, that no run contains after its
    first period. A null text, or one without words, has no runs and an empty rest; repeated
    rows and null ids are documents of their own; a very long text is searched by itself.
    """

    def search(group: list[tuple]) -> Iterator[tuple]:
        all_runs = find_runs([hashes for _, _, hashes in group])
        for (doc_id, words, _), runs in zip(group, all_runs):
            kept = words
            if runs:
                stays = np.ones(len(words), bool)
                for start, length, period in runs:
                    stays[start + period : start + length] = False
                kept = [words[i] for i in np.flatnonzero(stays)]
            columns = [np.array(column, np.int64) for column in zip(*runs)] or [np.zeros(0, np.int64)] * 3
            yield doc_id, len(words), *columns, b" ".join(kept).decode("utf-8", "replace")

    def run(rows):
        group, n_words = [], 0
        for doc_id, text in rows:
            words = raw_bytes(text).split()
            group.append((doc_id, words, word_hashes(text, CASED)))
            n_words += len(words)
            if n_words >= GROUP_WORDS:
                yield from search(group)
                group, n_words = [], 0
        yield from search(group)

    found = map_rows(docs.select("doc_id", null_free()), run, RUNS)
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return found.select("doc_id", "n_words", zipped.alias("runs"), "collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, where a tenth of the texts repeat some of their words to the end.

    Which ones, from which word and with which period follows from the crc32 of the id's
    decimal text; a text with a null id, or without words, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(null_free(), F.lit(WORD), F.lit(0))

    def planted(row: Column) -> Column:
        words, g = row["words"], row["g"]
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # the period that is repeated, as often as it takes and then cut
        rest = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), rest), F.lit(1), n.cast("int")), " ")

    row = F.array(F.struct(words.alias("words"), g.alias("g")))
    altered = F.transform(F.filter(row, lambda r: F.size(r["words"]) > 0), planted)
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    return docs.select("doc_id", F.when(chosen, F.coalesce(F.get(altered, F.lit(0)), null_free())).otherwise(null_free()).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of all runs and of what
    is left, for rows of ``collapse``.

    Of runs of equal exponents the first counts; without runs its columns are null.
    """
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = collapsed.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
