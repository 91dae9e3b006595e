"""Ranked search for one pattern: names first, contents second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.functions.glob import glob_match, pattern_grams, wrap_substring
from leafscan.functions.glob import fold as fold_literal
from leafscan.functions.regex import regex_match, regex_needs, tree_of
from leafscan.functions.syntax import required
from leafscan.operators.bm25 import score_in_place
from leafscan.operators.candidates import (
    BROADCAST_ROWS,
    SELECTIVE,
    candidates,
    cheapest_literals,
    literal_rows,
    literal_terms,
    look_up,
)
from leafscan.plans.ranking import passes, two_blocks
from leafscan.schemas import RESULT
from leafscan.sources.tables import Index

LIMIT = 25


def search(
    index: Index, pattern: str, is_re: bool = False, k: int = LIMIT, ordered: bool = True
) -> DataFrame:
    """``(name, description, pass, rank, score)``: pass 0 by name, pass 1 by content.

    Names shown in the first block are taken out of the second after its limit, so the
    second may hold fewer than k rows.

    A pattern with a rare gram is answered through the postings: its few candidates go
    out to the texts, and only their blocks are read. If even its rarest gram is common,
    most texts have to be read anyway; then each hit is scored from the text at hand,
    and nothing is shuffled before the ranking. A regex is answered in the same two ways, by
    the grams of the literals that each of its matches needs.
    """
    name, content = F.col("name"), F.col("content")
    scores, score = None, F.lit(0.0)
    if is_re:
        tree = tree_of(pattern)
        if tree is None:
            return index.spark.createDataFrame([], RESULT)
        rows = index.fts
        few = cheapest_literals(index, required(tree, fold_literal, 3))
        if few and not few.bound:
            return index.spark.createDataFrame([], RESULT)
        if few and few.bound <= BROADCAST_ROWS and few.bound * SELECTIVE <= index.n_rows:
            rows = rows.join(F.broadcast(literal_rows(index, few)), ["row_id", "block"], "left_semi")
        needed = [regex_needs(tree, col) for col in (name, content)]
        if needed[0] is not None:
            rows = rows.where(needed[0] | needed[1])
        tests = [regex_match(index.spark, col, pattern) for col in (name, content)]
        rows = rows.withColumns({"by_name": tests[0], "by_content": tests[1]}).where("by_name OR by_content")
        tests = [F.col("by_name"), F.col("by_content")]
    else:
        glob = wrap_substring(pattern)
        grams = pattern_grams(glob)

        tests = [glob_match(col, glob) for col in (name, content)]
        if grams:
            found = look_up(index, grams)
            if not found.bound:
                return index.spark.createDataFrame([], RESULT)
            if found.bound <= BROADCAST_ROWS and found.bound * SELECTIVE <= index.n_rows:
                scores = F.broadcast(candidates(index, found))
            else:
                score = score_in_place(literal_terms(index, found), name, content, index.average)

        # the tests run in the scan: what is joined and shuffled carries no contents
        rows = index.fts.where(tests[0] | tests[1])
    if scores is not None:
        rows, score = rows.join(scores, ["row_id", "block"]), F.col("score")
    found_in = F.explode_outer(passes(*tests)).alias("pass")
    hits = rows.select("row_id", "id", "name", "description", found_in, score.alias("score"))
    result = two_blocks(hits, k, [])
    return result.orderBy("pass", "rank") if ordered else result


def found_any(index: Index, pattern: str, is_re: bool = False) -> DataFrame:
    """One row: whether a search for the pattern would return anything.

    Nothing is ranked: the scan ends at the first name or content that passes.
    """
    name, content = F.col("name"), F.col("content")
    if not is_re:
        tests = [glob_match(col, wrap_substring(pattern)) for col in (name, content)]
    elif tree_of(pattern) is None:
        tests = [F.lit(False)] * 2
    else:
        tests = [regex_match(index.spark, col, pattern) for col in (name, content)]
    return any_match(index.fts.where(tests[0] | tests[1]).select("row_id"))


def any_match(result: DataFrame) -> DataFrame:
    """One row: whether the search returned anything."""
    return result.limit(1).agg((F.count(F.lit(1)) > 0).alias("any_match"))


def status(result: DataFrame) -> DataFrame:
    """One row: the heading of the second block, which ignores the first."""
    found = F.count_if(F.col("pass") == 1) > 0
    heading = F.when(found, "content matches:").otherwise("no results")
    return result.agg(heading.alias("status"))
