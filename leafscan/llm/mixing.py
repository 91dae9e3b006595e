"""Mixing sources to target weights along a curriculum that changes over the training run.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import DOCUMENT, WORD, attach, null_free, running_total, stored, word_count
from leafscan.operators.pages import assign_ids

# Mean weights of the sources, repeating in the order of their names.
WEIGHTS = (3, 1, 2)
# How a source's weight moves over the run, by the same cycle: its value at times from 0 to
# 1, straight in between. Only the shape counts; the mean comes from WEIGHTS.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)
SHARE = 1.5
REPEATS = 2

Schedule = tuple[tuple[float, float], ...]


def demand(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """The integral of a schedule, scaled to 1: ``(t0, t1, done before, w0, w1)`` by segment."""
    spans = list(zip(schedule, schedule[1:]))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in spans]
    total, done, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(spans, areas):
        out.append((t0, t1, done / total, w0 / total, w1 / total))
        done += area
    return out


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which the given share of a source's demand is reached: demand, inverted.

    Within a segment the integral is a parabola; its root is taken in the form that holds
    for a constant weight too.
    """
    found = None
    for t0, t1, done, w0, w1 in reversed(demand(schedule)):
        rest = F.greatest(share - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.least(F.lit(t0) + 2 * rest / (F.lit(w0) + root), F.lit(t1))
        time = F.when(rest > 0, time).otherwise(F.lit(t0))
        found = time if found is None else F.when(share >= F.lit(done_next), found).otherwise(time)
        done_next = done
    return found


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``, ``cycle`` and ``target`` to ``(source, source_size)``.

    Each round gives the open sources their share of what the closed ones leave, and closes
    those that would get more than REPEATS times their size. A round is one small sum; the
    rounds end when nothing more closes, after one for each source at most.
    """
    ordered = sources.select("source", "source_size", F.struct(F.col("source").isNull(), "source").alias("_key"))
    numbered = assign_ids(ordered, -1, key="_key", column="_rank").drop("_key")
    cycle = F.pmod("_rank", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), cycle + 1)
    weighted = stored(numbered.select("source", "source_size", cycle.alias("cycle"), weight.alias("weight")))
    limit = REPEATS * F.col("source_size")
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shut = F.lit(False)
    while True:
        rest, units, n_shut, n_open = weighted.agg(
            F.lit(SHARE) * total - F.coalesce(F.sum(F.when(shut, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~shut, F.col("weight"))), F.lit(0)),
            F.count_if(shut),
            F.count_if(~shut),
        ).first()
        if not n_open:
            break
        over = F.col("weight") * F.lit(float(rest)) / F.lit(units) > limit
        if weighted.where(over).count() == n_shut:
            break
        shut = over
    share = F.col("weight") * F.lit(float(rest)) / F.lit(units or 1)
    return weighted.withColumn("target", F.when(shut, limit.cast("double")).otherwise(share))


def decide(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document ``(doc_id, text, source)``.

    Returns, by ``(source, doc_id, digest)``: ``size``, ``source_size``, ``target``,
    ``first`` and ``again`` (words taken in the first and the second pass) and the training
    positions ``position`` and ``again_position`` between 0 and 1, null where nothing is taken.

    A source's documents stand in the order of the md5 of their id, twice in a row; the mix
    takes that sequence up to the target, so the document at the end is taken in part. Where
    a document's middle falls in its source's cumulative demand gives its position.
    Equal rows share what falls to them alike; a null text has size 0, nulls of ``source``
    are one source, and without rows there is nothing.
    """
    sized = docs.select("doc_id", "source", F.md5(null_free()).alias("digest"), word_count().alias("size"))
    keys = ["source", "doc_id", "digest"]
    rows = sized.groupBy(*keys).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows.withColumn("words", F.col("size") * F.col("n")))
    sources = targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = running_total(rows.withColumn("_order", order), ["source"], ["_order", "doc_id", "size", "digest"], "words", "start")
    placed = attach(placed, sources, ["source"])
    limit = F.floor("target")

    def taken(begin: Column) -> Column:
        inside = F.least(begin + F.col("words"), limit) - begin
        return F.floor(F.greatest(inside, F.lit(0)) / F.col("n")).cast("long")

    def position(begin: Column, got: Column) -> Column:
        share = (begin + got * F.col("n") / 2) / F.col("target")
        time = time_of(share, SCHEDULES[0])
        for i, schedule in enumerate(SCHEDULES[1:], 1):
            time = F.when(F.col("cycle") == i, time_of(share, schedule)).otherwise(time)
        return F.when(got > 0, time)

    again = F.col("start") + F.col("source_size")
    return placed.select(
        *keys,
        "size",
        "source_size",
        "target",
        taken(F.col("start")).alias("first"),
        taken(again).alias("again"),
        position(F.col("start"), taken(F.col("start"))).alias("position"),
        position(again, taken(again)).alias("again_position"),
    )


KEYS = ["source", "doc_id", "digest"]


def _with_decisions(docs: DataFrame) -> DataFrame:
    return attach(docs.withColumn("digest", F.md5(null_free())), stored(decide(docs)), KEYS)


def mix_sizes(docs: DataFrame) -> DataFrame:
    """One row for each document: its size, its source's size and target, the words taken and
    the positions; sorted by the first position."""
    decided = _with_decisions(docs.select("doc_id", "text", "source"))
    taken = F.col("first") + F.col("again")
    rows = decided.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "position", "again_position"
    )
    ordered = rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.withColumns({name: F.round(name, 6) for name in ("position", "again_position")})


def mix_documents(docs: DataFrame) -> DataFrame:
    """The training sequence: a row of the columns of ``documents`` for each copy that is
    taken, sorted by training position. Of a copy that is taken in part the text goes on to
    the last word that is taken; ``n_chars`` follows.
    """
    copies = F.array(
        F.struct(F.col("position"), F.col("first").alias("words")),
        F.struct(F.col("again_position").alias("position"), F.col("again").alias("words")),
    )
    decided = stored(decide(docs.select("doc_id", "text", "source")))
    wanted = decided.select(*KEYS, "size", F.filter(copies, lambda copy: copy["words"] > 0).alias("copies"))
    wanted = wanted.where(F.size("copies") > 0).select(*(F.col(k).alias(f"_{k}") for k in KEYS), "size", "copies")
    rows = docs.select(*DOCUMENT, F.md5(null_free()).alias("digest"))
    # texts and decisions meet by shuffle at every size: a switch to broadcast would make a
    # small run say nothing about a large one
    same = [rows[k].eqNullSafe(wanted[f"_{k}"]) for k in KEYS]
    taken = rows.join(wanted.hint("merge"), same).withColumn("_copy", F.explode("copies"))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, 1, F.col("_copy.words").cast("int")), "")
    whole = F.col("_copy.words") == F.col("size")
    cut = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    ordered = cut.orderBy(F.col("_copy.position"), "doc_id")
    return ordered.select(*DOCUMENT)
