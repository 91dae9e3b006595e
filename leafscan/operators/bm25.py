"""Okapi BM25 over the stored postings, and the candidate rows it scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.functions.text import fold
from leafscan.operators.grams import gram_count

# The usual parameters, and the floor for grams in over half of the rows.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Terms are summed as whole multiples of 1/SCALE. Integer sums come out the same in
# whatever order tasks deliver them, so equal rows tie exactly.
SCALE = 1e12


def idf(n_rows: int, df: int) -> float:
    value = math.log((n_rows - df + 0.5) / (df + 0.5))
    return value if value > 0 else IDF_FLOOR


def idf_column(n_rows: int, df: Column) -> Column:
    value = F.log((F.lit(float(n_rows)) - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(IDF_FLOOR))


def term(weight: Column, tf: Column, n_grams: Column, average: float) -> Column:
    """One gram's share of the score, as a whole number; weight is idf times repeats."""
    length = F.lit(1 - B) + F.lit(B) * n_grams / F.lit(average)
    share = weight * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * length)
    return F.floor(share * F.lit(SCALE) + F.lit(0.5)).cast("long")


def row_scores(terms: dict[tuple, list[tuple]], tf: dict[str, int], n_grams: int, average: float) -> dict[tuple, float]:
    """Scores of one row for several patterns' ``(gram, weight)``: the sums of ``term``, in Python."""
    length = K1 * ((1 - B) + B * n_grams / average)
    found = {}
    for pattern, weighed in terms.items():
        whole = 0
        for gram, weight in weighed:
            n = tf.get(gram, 0)
            whole += math.floor(weight * (n * (K1 + 1)) / (n + length) * SCALE + 0.5)
        found[pattern] = -(whole / SCALE)
    return found


def total(term_column: str) -> Column:
    """Sum of terms as a score; the best row has the lowest."""
    return -(F.sum(term_column) / F.lit(SCALE))


def scored_candidates(found: DataFrame, keys: list[str], n_distinct: Column) -> DataFrame:
    """Relational division: groups that hold all their grams, with their score.

    ``found`` holds one row for each present gram, with its ``term``.
    """
    counted = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"), total("term").alias("score")
    )
    return counted.where(F.col("present") == n_distinct).drop("present")


def score_in_place(terms: Column, name: Column, content: Column, average: float) -> Column:
    """BM25 of one row for one query's terms, counted in the row's own text."""
    # the texts are folded once and bound by the outer lambda, not once for each gram
    folded = F.array(F.struct(fold(name).alias("name"), fold(content).alias("content")))
    length = gram_count(name, content)

    def occurrences(text: Column, gram: Column) -> Column:
        # taking the gram out shortens the text by each place it stands in, unless two
        # places overlap, which needs a gram that ends as it begins
        shorter = F.octet_length(text) - F.octet_length(F.replace(text, gram, F.lit("")))
        apart = (shorter / F.octet_length(gram)).cast("long")
        overlapping = F.regexp_count(text, F.concat(F.lit("(?s)(?=\\Q"), gram, F.lit("\\E)")))
        return F.when(F.left(gram, F.lit(1)) == F.right(gram, F.lit(1)), overlapping).otherwise(apart)

    def add(text: Column, total: Column, entry: Column) -> Column:
        tf = occurrences(text["name"], entry["gram"]) + occurrences(text["content"], entry["gram"])
        return total + term(entry["weight"], tf, length, average)

    def score(text: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(terms, zero, lambda total, entry: add(text, total, entry))

    return -(F.transform(folded, score)[0] / F.lit(SCALE))
