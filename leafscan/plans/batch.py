"""Ranked search for a table of patterns ``(query_id, pattern, is_re)``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leafscan.functions.glob import (
    glob_match,
    glob_to_regex,
    pattern_grams,
    plain_needle,
    wrap_substring,
)
from leafscan.functions.needles import scored_finder
from leafscan.functions.regex import regex_match, tree_of
from leafscan.functions.text import fold
from leafscan.operators.bm25 import idf_column, score_in_place
from leafscan.operators.candidates import BROADCAST_ROWS, ROW_BYTES, SELECTIVE
from leafscan.operators.grams import bucket, gram_count, unpacked
from leafscan.plans.ranking import passes, two_blocks
from leafscan.plans.search import LIMIT
from leafscan.session import checkpoint_dir
from leafscan.sources.tables import Index, block

# Patterns are scanned for this many at a time.
SCAN_PATTERNS = 64
# More plain needles than this are looked for by an automaton, in sets of about so many bytes.
MANY_NEEDLES, NEEDLE_BYTES = 64, 4 << 20
# A gram's postings and the queries that start from it meet in this many tasks when the
# queries are too many to broadcast.
SALTS = 32

# Of a query's grams those with up to so many times the rows of its rarest, and no more than
# so many, are intersected before a text is read.
SEED_RATIO, SEEDS = 8, 4

TERMS = "array<struct<gram: string, weight: double>>"
GLOBS = "query_id long, needle string, regex string, grams array<string>"
HITS = "query_id long, row_id long, id long, name string, description string, pass int, score double"


def _compile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        globs = [wrap_substring(pattern) for pattern in frame["pattern"]]
        yield pd.DataFrame(
            {
                "query_id": frame["query_id"],
                "needle": [plain_needle(glob) for glob in globs],
                "regex": [glob_to_regex(glob) for glob in globs],
                "grams": [pattern_grams(glob) for glob in globs],
            }
        )


def compile_globs(queries: DataFrame) -> DataFrame:
    """``(query_id, needle, regex, grams)`` of glob patterns, needle NULL unless plain."""
    columns = queries.select(F.col("query_id").cast("long"), "pattern")
    return columns.mapInPandas(_compile, GLOBS)


def matches(text: Column, needle: Column, regex: Column) -> Column:
    """Test with a pattern of the row itself; a plain needle needs no regex."""
    return F.when(needle.isNotNull(), F.contains(text, needle)).otherwise(F.rlike(text, regex))


def glob_match_column(df: DataFrame, text: str, needle: str = "needle", regex: str = "regex") -> DataFrame:
    """Rows whose text matches the compiled glob beside it."""
    return df.where(matches(F.col(text), F.col(needle), F.col(regex)))


def weigh(index: Index, globs: DataFrame) -> DataFrame:
    """Queries whose grams all occur somewhere, with grams, weights and rarest grams.

    A query's grams are few, so they travel as an array; document frequencies come from
    one join over all queries' distinct grams.
    """
    terms = globs.select("query_id", F.explode("grams").alias("gram"))
    terms = terms.groupBy("query_id", "gram").agg(F.count(F.lit(1)).alias("repeats"))
    wanted = terms.select("gram").distinct()
    df = index.gram_df.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.sum("df").alias("df"))
    weight = F.col("repeats") * idf_column(index.n_rows, F.col("df"))
    per_query = (
        terms.join(df, "gram")
        .select("query_id", "gram", "df", weight.alias("weight"))
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("gram", "weight"))).alias("terms"),
            F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("rising"),
        )
    )
    complete = F.size("terms") == F.size(F.array_distinct("grams"))
    weighed = globs.join(per_query, "query_id").where(complete)
    rising, df = F.col("rising"), F.col("rising")[0]["df"]
    seeds = F.transform(F.filter(rising, lambda g: g["df"] <= SEED_RATIO * df), lambda g: g["gram"])
    return weighed.select("query_id", "needle", "regex", "terms", df.alias("df"), F.slice(seeds, 1, SEEDS).alias("seeds"))


def pair_candidates(index: Index, weighed: DataFrame, n_queries: int) -> DataFrame:
    """``(query_id, row_id, block)`` of rows that hold all rarest grams of a query; the rest is
    left to the test.

    Queries meet packed lists; these are unpacked behind the join and intersected.
    """
    seeds = weighed.select("query_id", F.size("seeds").alias("n_seeds"), F.explode("seeds").alias("gram"))
    seeds = seeds.withColumn("bucket", bucket(F.col("gram")))
    lists = index.postings.drop("batch")
    if n_queries * SEEDS <= BROADCAST_ROWS:
        joined = lists.join(F.broadcast(seeds), ["gram", "bucket"])
    else:
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salt = F.pmod(F.xxhash64("first"), F.lit(SALTS)).cast("int").alias("salt")
        joined = lists.select("*", salt).join(seeds.select("*", copies), ["gram", "bucket", "salt"])
    entries = unpacked(joined, "query_id", "n_seeds")
    met = entries.groupBy("query_id", "row_id", "n_seeds").agg(F.count(F.lit(1)).alias("present"))
    return met.where("present = n_seeds").select("query_id", "row_id", block("row_id"))


def parts_of(pairs: DataFrame, most: int) -> list[DataFrame]:
    """The pairs in parts of at most about ``most`` rows, each of neighbouring blocks or of one.

    Only the number of pairs of each block reaches the driver.
    """
    counts = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    parts, blocks, held = [], [], 0
    for number, n in counts:
        if held and held + n > most:
            parts.append(pairs.where(F.col("block").isin(blocks)))
            blocks, held = [], 0
        if n > most:
            pieces = -(-n // most)
            own = pairs.where(F.col("block") == number)
            piece = F.pmod(F.xxhash64("query_id", "row_id"), F.lit(pieces))
            parts += [own.where(piece == i) for i in range(pieces)]
            continue
        blocks.append(number)
        held += n
    return parts + ([pairs.where(F.col("block").isin(blocks))] if blocks else [])


def indexed_hits(index: Index, weighed: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hits of queries with a rare gram, found through the postings.

    Candidate pairs go out to the texts by broadcast, ``most`` or so at a time, and of the
    texts only their blocks are read; contents stay where they are however many pairs there are.
    """
    width = F.octet_length("regex") + F.lit(64) * F.size("terms")
    n_queries, n_bytes = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if not n_queries:
        return index.spark.createDataFrame([], HITS)
    pairs = pair_candidates(index, weighed, n_queries).checkpoint()
    details = weighed.select("query_id", "needle", "regex", "terms")
    if n_bytes <= BROADCAST_ROWS * ROW_BYTES:
        details = F.broadcast(details)
    texts = index.fts.select("row_id", "block", "id", "name", "description", "content")
    name, content = F.col("name"), F.col("content")
    found = []
    for part in parts_of(pairs, most):
        # a part carries its queries' tests, so that rows leave the scan tested
        tests = part.join(details, "query_id")
        rows = texts.join(F.broadcast(tests), ["row_id", "block"])
        test = [matches(col, F.col("needle"), F.col("regex")) for col in (name, content)]
        tested = rows.withColumn("passes", passes(*test)).where(F.size("passes") > 0)
        scored = tested.withColumn("score", score_in_place(F.col("terms"), name, content, index.average))
        place = F.explode_outer("passes").alias("pass")
        found.append(scored.select("query_id", "row_id", "id", "name", "description", place, "score"))
    return reduce(DataFrame.unionByName, found) if found else index.spark.createDataFrame([], HITS)


def scan_tests(spark: SparkSession, chunk: list[Row]) -> list[Column]:
    """For each pattern and pass the entry a matching row gets; none for a bad pattern."""
    tests = []
    for row in chunk:
        if row["is_re"] and tree_of(row["pattern"]) is None:
            continue
        for place, column in enumerate(("name", "content")):
            col = F.col(column)
            hit = (
                regex_match(spark, col, row["pattern"])
                if row["is_re"]
                else glob_match(col, wrap_substring(row["pattern"]))
            )
            # one literal struct for each entry, spelled in SQL
            entry = f"named_struct('query_id', {row['query_id']:d}L, 'pass', {place})"
            tests.append(F.when(hit, F.expr(entry)))
    return tests


def _entries(numbers: str, scores: str, place: int) -> Column:
    """An array of query ids and scores as the entries of a pass."""
    return F.transform(
        numbers, lambda q, i: F.struct(q.alias("query_id"), F.lit(place).alias("pass"), F.get(F.col(scores), i).alias("score"))
    )


def needle_scans(index: Index, plain: DataFrame, n_bytes: int) -> list[DataFrame]:
    """Hits of ``(query_id, needle, terms)``, plain substrings of any number.

    One scan looks for a whole set of needles by an automaton that is broadcast with them. A
    set holds NEEDLE_BYTES or so, so the scans follow the size of the queries alone; sets are
    dealt by query, so a needle that many queries share is divided among them. Hits of patterns
    with terms are scored where they are found, from one count of the text's grams.
    """
    n_sets, scans = max(1, -(-n_bytes // NEEDLE_BYTES)), []
    shown = ["row_id", "id", "name", "description"]
    for i in range(n_sets):
        chosen = plain.where(F.pmod(F.xxhash64("query_id"), F.lit(n_sets)) == i)
        needles: dict[str, list[int]] = {}
        terms: dict[int, list[list[tuple] | None]] = {}
        for query_id, needle, weighed in chosen.select("query_id", "needle", "terms").collect():
            needles.setdefault(needle, []).append(query_id)
            terms.setdefault(query_id, []).append(None if weighed is None else [tuple(entry) for entry in weighed])
        if not needles:
            continue
        name, content = F.col("name"), F.col("content")
        found = scored_finder(index.spark, needles, terms, index.average)
        found = found(name, content, fold(name), fold(content), gram_count(name, content))
        rows = index.fts.select(*shown, found.alias("found"))
        entries = F.concat(
            _entries("found.by_name", "found.name_scores", 0), _entries("found.by_content", "found.content_scores", 1)
        )
        hits = rows.select(*shown, F.explode_outer(entries).alias("hit")).where(F.col("hit").isNotNull())
        scans.append(hits.select("hit.query_id", *shown, "hit.pass", "hit.score"))
    return scans


def scanned_hits(index: Index, patterns: DataFrame) -> DataFrame:
    """Hits of ``(query_id, pattern, is_re, needle, terms)`` by scans of the texts.

    These are regexes, globs without a gram and globs with common grams only: most texts
    have to be read for them anyway. Many plain needles go to ``needle_scans``. The driver
    compiles the other patterns a chunk at a time; each scan tests a whole chunk and hands on
    matches alone. Patterns with terms score their hits in the same task, with the chunk's own
    terms sent along; others score 0.
    """
    spark, scans = index.spark, []
    shown = ["row_id", "id", "name", "description"]
    patterns = patterns.checkpoint()
    plain = F.coalesce("needle", F.lit("")) != ""
    width = F.octet_length("needle") + F.lit(64) * (F.lit(1) + F.coalesce(F.size("terms"), F.lit(0)))
    n_plain, n_bytes = patterns.where(plain).agg(F.count(F.lit(1)), F.sum(width)).first()
    if n_plain > MANY_NEEDLES:
        scans = needle_scans(index, patterns.where(plain).select("query_id", "needle", "terms"), n_bytes)
        patterns = patterns.where(~plain)
    for scored in (False, True):
        source = patterns.where(F.col("terms").isNotNull() == scored).toLocalIterator()
        while chunk := list(islice(source, SCAN_PATTERNS)):
            tests = scan_tests(spark, chunk)
            if not tests:
                continue
            # the outer form, because Spark guards the plain one with a filter that would
            # run all the tests a second time
            found = F.explode_outer(F.array_compact(F.array(*tests))).alias("hit")
            hits = index.fts.select(*shown, *(["content"] if scored else []), found)
            hits = hits.where(F.col("hit").isNotNull()).withColumns(
                {"query_id": F.col("hit.query_id"), "pass": F.col("hit.pass")}
            )
            score = F.lit(0.0)
            if scored:
                terms = [(row["query_id"], row["terms"]) for row in chunk]
                few = F.broadcast(spark.createDataFrame(terms, f"query_id long, terms {TERMS}"))
                hits = hits.join(few, "query_id")
                text = (F.col("name"), F.col("content"))
                score = score_in_place(F.col("terms"), *text, index.average)
            scans.append(hits.select("query_id", *shown, "pass", score.alias("score")))
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], HITS)


def search_batch(index: Index, queries: DataFrame, k: int = LIMIT) -> DataFrame:
    """``(query_id, name, description, pass, rank, score)``: each query as in ``search``.

    A query may match any share of the rows: each task keeps its own best k before the
    ranking is shuffled by query.
    """
    checkpoint_dir(index.spark)
    queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
    globs = compile_globs(queries.where(~F.col("is_re")))
    weighed = weigh(index, globs.where(F.size("grams") > 0)).checkpoint()
    rare = F.col("df") * SELECTIVE <= index.n_rows

    plain = queries.select("query_id", "pattern", "is_re")
    gramless = plain.join(globs.where(F.size("grams") == 0).select("query_id", "needle"), "query_id")
    unscored = plain.where("is_re").unionByName(gramless, allowMissingColumns=True)
    common = plain.join(weighed.where(~rare).select("query_id", "needle", "terms"), "query_id")
    patterns = unscored.withColumn("terms", F.lit(None).cast(TERMS)).unionByName(common)
    hits = indexed_hits(index, weighed.where(rare)).unionByName(scanned_hits(index, patterns))
    return two_blocks(hits, k, ["query_id"])
