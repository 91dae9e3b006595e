"""Many plain substrings, looked for in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafscan.operators.bm25 import row_scores
from leafscan.operators.grams import gram_keys, pieces

SCORED = "by_name array<long>, name_scores array<double>, by_content array<long>, content_scores array<double>"
NUMBERS, SCORES = pa.list_(pa.int64()), pa.list_(pa.float64())


def _numbers_in(text: str | None, automaton: ahocorasick.Automaton) -> list[int]:
    if not text:
        return []
    needles = {numbers for _, numbers in automaton.iter(text)}
    return [number for numbers in needles for number in numbers]


def scored_finder(
    spark: SparkSession, needles: dict[str, list[int]], terms: dict[int, list[list[tuple] | None]], average: float
) -> Callable:
    """A function of a name, a content, both folded, and the row's length in grams: the numbers of
    the needles that stand in name and content, and the row's score for each.

    Needles must not be empty. Each task builds the automaton once and reads a text once,
    however many needles there are; its grams are counted once. Texts become strings, and hits
    leave, a piece of an Arrow batch at a time. A null text holds none.
    ``terms`` holds for each number the weighed grams of its patterns, one hit for each; a pattern
    without them scores 0.
    """
    slots, scored = {}, {}
    for number, patterns in terms.items():
        slots[number] = [(number, i) for i in range(len(patterns))]
        scored |= {(number, i): weighed for i, weighed in enumerate(patterns) if weighed is not None}
    grams = sorted({gram for weighed in scored.values() for gram, _ in weighed})
    shared = spark.sparkContext.broadcast((needles, slots, scored, grams))

    @F.arrow_udf(SCORED)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        needles, slots, scored, grams = shared.value
        automaton = ahocorasick.Automaton()
        for needle, numbers in needles.items():
            automaton.add_word(needle, tuple(numbers))
        automaton.make_automaton()
        keys = gram_keys("".join(grams))[::3]  # all grams have three characters
        order = np.argsort(keys)
        keys, names = keys[order], [grams[i] for i in order.tolist()]

        def scores(found: set[tuple], texts: list[str], n_grams: int) -> dict[tuple, float]:
            wanted = {slot: scored[slot] for slot in found if slot in scored}
            if not wanted:
                return {}
            windows = np.concatenate([gram_keys(text) for text in texts])
            at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
            there, counts = np.unique(at[keys[at] == windows], return_counts=True)
            tf = dict(zip([names[i] for i in there.tolist()], counts.tolist()))
            return row_scores(wanted, tf, n_grams, average)

        def hits(piece: pa.RecordBatch) -> pa.Array:
            rows = []
            for name, content, low_name, low_content, n_grams in zip(*(column.to_pylist() for column in piece.columns)):
                sides = [
                    [slot for number in _numbers_in(text, automaton) for slot in slots[number]] for text in (name, content)
                ]
                score = scores({*sides[0], *sides[1]}, [low_name or "", low_content or ""], n_grams)
                rows.append(
                    [part for side in sides for part in ([n for n, _ in side], [score.get(slot, 0.0) for slot in side])]
                )
            columns = map(pa.array, map(list, zip(*rows)), (NUMBERS, SCORES) * 2)
            return pa.StructArray.from_arrays(list(columns), ["by_name", "name_scores", "by_content", "content_scores"])

        for batch in batches:
            for piece in pieces(pa.RecordBatch.from_arrays(list(batch), [str(i) for i in range(len(batch))])):
                yield hits(piece)

    # a plan that moved the test would run it twice
    return found.asNondeterministic()
