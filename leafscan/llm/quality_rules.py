"""Quality rules judged by host: a document's own failures count where its host has many."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import DOCUMENT, WORD, attach, map_rows, null_free, stored

MIN_WORDS = 50
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# A host is flagged for a rule from this shrunken share of failing documents.
HOST_LIMIT = 0.3
# Bounds of the prior's weight, in documents.
PRIOR = (1.0, 10_000.0)
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
NAMES = tuple(field.split()[0] for field in MEASURES.split(", "))

_word = re.compile(WORD)


def measured(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of MEASURES."""
    words = _word.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        often = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        inside = np.zeros(len(words), bool)
        for shift in range(3):
            inside[shift : shift + len(windows)] |= often
        repeated = int(inside.sum())
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), repeated


def rules() -> dict[str, Column]:
    """Failures of a document, by rule; whole numbers on both sides."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words),
    }


def measure(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns of each document, its counts and its failures ``fails_<rule>``."""
    picked = docs.select(*columns, null_free().alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop("_text").schema)

    def run(rows):
        for row in rows:
            yield *row[:-1], *measured(row[-1])

    counted = map_rows(picked, run, f"{kinds}, {MEASURES}")
    failed = counted.withColumns({f"fails_{name}": test for name, test in rules().items()})
    return failed.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """``(host, n_docs, rate_<rule>...)``: shares of failing documents, drawn to the mean.

    The prior of a rule is the beta distribution whose mean is the share over all documents
    and whose weight follows from how far hosts lie apart beyond chance (method of moments).
    A host with few documents so stays near the mean. One row reaches the driver.
    """
    names = list(rules())
    failing = [F.count_if(F.col(f"fails_{name}")).alias(name) for name in names]
    hosts = counted.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *failing)
    sums = hosts.agg(
        F.sum("n_docs").alias("docs"), F.count(F.lit(1)).alias("hosts"), *(F.sum(name).alias(name) for name in names)
    ).first()
    docs = sums["docs"] or 1
    mean = {name: (sums[name] or 0) / docs for name in names}
    apart = [F.sum(F.col("n_docs") * (F.col(n) / F.col("n_docs") - mean[n]) ** 2).alias(n) for n in names]
    spread = hosts.agg(*apart).first()
    rates = []
    for name in names:
        chance = mean[name] * (1 - mean[name])
        beyond = (spread[name] or 0.0) / docs - chance * sums["hosts"] / docs
        weight = chance / beyond - 1 if beyond > 0 else PRIOR[1]
        weight = min(max(weight, PRIOR[0]), PRIOR[1])
        rate = (F.col(name) + mean[name] * weight) / (F.col("n_docs") + weight)
        rates.append(rate.alias(f"rate_{name}"))
    return hosts.select(host, "n_docs", *rates)


def flagged_hosts(rates: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts with a rate at or over the limit, and the rules in question."""
    bad = {f"bad_{name}": F.col(f"rate_{name}") >= limit for name in rules()}
    return rates.select(host, *(test.alias(name) for name, test in bad.items())).where(
        " or ".join(bad)
    )


def judge(counted: DataFrame, flagged: DataFrame, host: str = "source") -> DataFrame:
    """Add ``kept``: false for a base failure, and for a failure of a rule the host is flagged for."""
    joined = attach(counted, flagged, [host])
    bad = [F.coalesce(F.col(f"bad_{name}"), F.lit(False)) & F.col(f"fails_{name}") for name in rules()]
    rejected = bad[0]
    for test in bad[1:]:
        rejected = rejected | test
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected))


def score_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, counts..., base_failed, kept)`` for every row of ``(doc_id, text, source)``.

    Texts are read once; their counts are stored and serve the hosts' rates and the verdicts.
    A null text has no words and fails. A null source is a host like any other. Repeated
    rows are judged, and count for their host, one by one; no rows give no rows.
    """
    counted = stored(measure(docs, ("doc_id", "source")))
    judged = judge(counted, flagged_hosts(host_rates(counted)))
    return judged.select("doc_id", *NAMES, "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``documents``.

    Texts stay where they are read: only the flagged hosts travel to them.
    """
    counted = measure(docs, ("source",)).select("source", *(f"fails_{name}" for name in rules()))
    flagged = stored(flagged_hosts(host_rates(stored(counted))))
    judged = judge(measure(docs, DOCUMENT), flagged)
    return judged.where("kept").select(*DOCUMENT)
