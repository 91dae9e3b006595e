"""Rows that can match a glob, found and scored through the postings."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.operators.bm25 import SCALE, idf, term
from leafscan.operators.grams import bucket, unpacked
from leafscan.sources.tables import Index, block

# Up to this many candidate rows are broadcast to the text table, at ROW_BYTES each.
BROADCAST_ROWS, ROW_BYTES = 500_000, 64
# The postings are used where they leave at most one row in this many to look at;
# otherwise a scan reads little more and shuffles nothing.
SELECTIVE = 64


@dataclass(frozen=True)
class PatternGrams:
    """Grams of one pattern with their repeats and document frequencies."""

    repeats: Counter
    df: dict[str, int]
    buckets: list[int]

    @property
    def bound(self) -> int:
        """No more rows than this hold all the grams."""
        return min((self.df.get(gram, 0) for gram in self.repeats), default=0)


def look_up(index: Index, grams: list[str]) -> PatternGrams:
    """Document frequencies of a pattern's grams; one small row for each of them."""
    repeats = Counter(grams)
    stored = index.gram_df.where(F.col("gram").isin(list(repeats)))
    total = stored.groupBy("gram").agg(F.sum("df").alias("df"))
    rows = total.withColumn("bucket", bucket(F.col("gram"))).collect()
    buckets = sorted({row["bucket"] for row in rows})
    return PatternGrams(repeats, {row["gram"]: row["df"] for row in rows}, buckets)


def weights(index: Index, pattern: PatternGrams) -> list[tuple[str, float]]:
    """Each gram of the pattern with its idf times its repeats."""
    n = index.n_rows
    return [(gram, count * idf(n, pattern.df[gram])) for gram, count in pattern.repeats.items()]


def candidates(index: Index, pattern: PatternGrams) -> DataFrame:
    """``(row_id, block, score)`` of every row that holds all grams of the pattern.

    The grams' lists are unpacked and intersected; what is left takes its length from the
    text table, of which only that column is read.
    """
    if not pattern.bound:
        return index.spark.createDataFrame([], "row_id long, block long, score double")
    weighed = index.spark.createDataFrame(weights(index, pattern), "gram string, weight double")
    # both filters reach the scan: one prunes folders, the other row groups
    wanted = F.col("bucket").isin(pattern.buckets) & F.col("gram").isin(list(pattern.repeats))
    lists = index.postings.where(wanted).join(F.broadcast(weighed), "gram")
    entries = F.collect_list(F.struct("weight", "tf")).alias("entries")
    met = unpacked(lists, "weight").groupBy("row_id").agg(entries)
    whole = met.where(F.size("entries") == len(pattern.repeats)).withColumn("block", block("row_id"))
    if pattern.bound <= BROADCAST_ROWS:
        whole = F.broadcast(whole)
    rows = index.fts.select("row_id", "block", "n_grams").join(whole, ["row_id", "block"])

    def add(total: Column, entry: Column) -> Column:
        return total + term(entry["weight"], entry["tf"], F.col("n_grams"), index.average)

    score = -(F.aggregate("entries", F.lit(0).cast("long"), add) / F.lit(SCALE))
    return rows.select("row_id", "block", score.alias("score"))


def literal_terms(index: Index, pattern: PatternGrams) -> Column:
    """Grams and weights as a constant, for scoring rows from their own text."""
    entries = [
        F.struct(F.lit(gram).alias("gram"), F.lit(weight).alias("weight"))
        for gram, weight in weights(index, pattern)
    ]
    return F.array(*entries)


@dataclass(frozen=True)
class Literals:
    """Literals of which every match holds one, and no more rows than ``bound`` do."""

    bound: int
    texts: tuple[str, ...]


def cheapest_literals(index: Index, needed) -> Literals | None:
    """The literals to look for under a regex's condition; None if it names none.

    Of conditions that all hold the one with the fewest rows is enough: the rest is left to
    the test of the texts.
    """
    if needed is True:
        return None

    def grams(text: str) -> list[str]:
        return [text[i : i + 3] for i in range(len(text) - 2)]

    def leaves(part) -> list[str]:
        return grams(part[1]) if part[0] == "lit" else [gram for inner in part[1] for gram in leaves(inner)]

    df = look_up(index, leaves(needed)).df

    def best(part) -> Literals:
        if part[0] == "lit":
            return Literals(min(df.get(gram, 0) for gram in grams(part[1])), (part[1],))
        found = [best(inner) for inner in part[1]]
        if part[0] == "and":
            return min(found, key=lambda few: few.bound)
        return Literals(sum(few.bound for few in found), tuple(text for few in found for text in few.texts))

    return best(needed)


def literal_rows(index: Index, few: Literals) -> DataFrame:
    """``(row_id, block)`` of the rows that hold all grams of one of the literals."""
    wanted = [(i, text[at : at + 3]) for i, text in enumerate(few.texts) for at in range(len(text) - 2)]
    names = sorted({gram for _, gram in wanted})
    pairs = index.spark.createDataFrame(sorted(set(wanted)), "literal int, gram string")
    pairs = pairs.withColumn("n_grams_of", F.count(F.lit(1)).over(Window.partitionBy("literal")))
    buckets = index.spark.createDataFrame([(gram,) for gram in names], "gram string").select(bucket(F.col("gram")))
    numbers = sorted({row[0] for row in buckets.collect()})
    posted = index.postings.where(F.col("bucket").isin(numbers) & F.col("gram").isin(names))
    met = unpacked(posted.join(F.broadcast(pairs), "gram"), "literal", "n_grams_of")
    whole = met.groupBy("row_id", "literal", "n_grams_of").agg(F.count(F.lit(1)).alias("present"))
    rows = whole.where(F.col("present") == F.col("n_grams_of")).select("row_id").distinct()
    return rows.select("row_id", block("row_id"))
