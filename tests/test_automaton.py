"""Patterns as automata: against another matcher, and where texts and tables are cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafscan.functions import automaton as A
from leafscan.functions.glob import fold, glob_to_dialect
from leafscan.functions.regex import regex_match, spelled, tree_of
from leafscan.functions.syntax import (
    PatternError,
    UnsupportedPattern,
    backtracks_little,
    parse,
    required,
    syntax_tree,
)
from leafscan.plans import search as S
from leafscan.plans import sql
from leafscan.plans.build import ingest_texts
from leafscan.sources.tables import ensure_tables

from tests.pages import page
from tests.test_patterns import REFUSED, REGEX_TRUTH, TRUTH


def random_pattern(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["a", "b", "é", ".", "[ab]", "[^a]", r"\b", r"\B", "^", "$", r"\w", r"\s", "(?:)"])
    if kind < 0.55:
        return random_pattern(rng, depth - 1) + random_pattern(rng, depth - 1)
    if kind < 0.7:
        return f"(?:{random_pattern(rng, depth - 1)}|{random_pattern(rng, depth - 1)})"
    return f"(?:{random_pattern(rng, depth - 1)})" + rng.choice(["*", "+", "?", "{2}", "{1,2}", "{2,}", "{0}", "+?"])


def fulfils(condition, text):
    if condition is True:
        return True
    if condition[0] == "lit":
        return condition[1] in text
    return (all if condition[0] == "and" else any)(fulfils(part, text) for part in condition[1])


def random_cases(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        flag, pattern = rng.choice(["", "(?m)", "(?s)", "(?i)"]), random_pattern(rng, 3)
        other = flag + (pattern if flag == "(?m)" else pattern.replace("$", r"\Z"))
        texts = ["".join(rng.choice("abcAéÉ \n") for _ in range(rng.randint(1, 9))) for _ in range(60)]
        yield flag + pattern, texts, [bool(re.search(other, text)) for text in texts]


@pytest.mark.parametrize("seed", range(3))
def test_random_patterns_against_another_matcher(seed, monkeypatch):
    monkeypatch.setattr(A, "FEW", (0, 5, 48)[seed])
    monkeypatch.setattr(A, "CHUNK", (1 << 20, 40, 7)[seed])
    monkeypatch.setattr(A, "KEPT_STATES", (10_000, 3, 3)[seed])
    for pattern, texts, want in random_cases(seed, 400):
        assert A.reader(pattern).matches(texts).tolist() == want, pattern


def test_needed_literals_stand_in_every_match():
    told = 0
    for pattern, texts, want in random_cases(9, 600):
        for needed, put in ((required(parse(pattern), least=1), str), (required(parse(pattern), fold, 1), fold)):
            told += needed is not True
            assert all(fulfils(needed, put(text)) for text, hit in zip(texts, want) if hit), pattern
    assert told > 100
    assert required(parse(r"^x*(?:socket|pipe)s?\w+_t$")) == (
        "and", (("or", (("lit", "pipe"), ("lit", "socket"))), ("lit", "_t")),
    )
    assert required(parse("(?i)sock"), fold, 4)[0] == "or" and required(parse("a|b*")) is True


def test_truth_table_by_automaton_and_by_the_jvm(spark):
    for pattern, text, want in REGEX_TRUTH:
        assert A.reader(pattern).matches([text]).tolist() == [want], pattern
    columns = [F.lit(text).rlike("(?dU)" + spelled(parse(pattern))) for pattern, text, _ in REGEX_TRUTH]
    matched = [regex_match(spark, F.lit(text), pattern) for pattern, text, _ in REGEX_TRUTH]
    row = spark.range(1).select(F.array(*columns), F.array(*matched)).first()
    assert row[0] == row[1] == [case[2] for case in REGEX_TRUTH]
    for pattern in REFUSED[:-1]:
        with pytest.raises(PatternError):
            syntax_tree(pattern)
    for glob, text, want in TRUTH:
        pattern = glob_to_dialect(glob)
        assert (pattern is not None and A.reader(pattern).matches([text])[0]) == want, glob


def test_operators_and_properties():
    for pattern, hits, misses in (
        ("^[a-e--[bd]]$", "ace", "bdf"),
        ("^[a-e~~d-g]$", "abcfg", "deh"),
        (r"^[\w&&[^\d_]]$", "aé", "1_ "),
        (r"^[\p{Greek}--\p{Lu}]$", "αω", "Ωa"),
        ("(?U)^a+?$", "a", "b"),
        ("(?i)^[k-l]$", "kKLlK", "m"),
        (r"^[[:^digit:]&&\S]$", "aé", "1 "),
    ):
        assert A.reader(pattern).matches(list(hits)).all(), pattern
        assert not A.reader(pattern).matches(list(misses)).any(), pattern


def test_too_large_a_pattern_is_refused_aloud(spark):
    assert tree_of("(") is None
    with pytest.raises(UnsupportedPattern):
        regex_match(spark, F.col("v"), "(?:(?:a{1000}b*){1000}c)d")


def test_time_is_linear_where_another_matcher_does_not_end(spark):
    texts = ["ab c " * 40_000 + "zzz", "a" * 200_000 + "b", None, "x", "", "ab c " * 9 + "zzzz"]
    rows = spark.createDataFrame([(text,) for text in texts], "v string")
    for pattern, want in (
        (r"(?:ab|c|\w\s?)*zzzz", [False, False, None, False, False, True]),
        (r"^(?:a+)+$", [False, False, None, False, False, False]),
        (r"^(?:\w+\s?)*$", [True, True, None, True, True, True]),
        (r"^(?:a|a)*b$", [False, True, None, False, False, False]),
    ):
        got = [r[0] for r in rows.select(regex_match(spark, F.col("v"), pattern)).collect()]
        assert [bool(g) for g in got] == [bool(w) for w in want]
    assert backtracks_little(parse("(?:ha){3,}")) and not backtracks_little(parse(r"^a\w*b"))
    assert not backtracks_little(parse("(?:a?){20}a{20}")) and not backtracks_little(parse("x(?:a|b){9}x"))


def test_indexed_regex_equals_a_scan(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    ensure_tables(spark, folder)
    rng = random.Random(5)
    words = ["socket", "Sockets", "pipe", "system_data_types", "quark", "étage", "x"]
    pages = [page(f"{rng.choice(words)}{i}.1", f"{i} - x", " ".join(rng.choices(words, k=4))) for i in range(60)]
    index = ingest_texts(spark, spark.createDataFrame(pages, "path string, raw string"), folder)
    patterns = [r"sockets?\b.*quark", "(?i)SOCKETS", r"system_[^_]*_types|quark$", "no such", r"(?:é|e)tage x*"]
    scanned = [S.search(index, p, True, k=100).collect() for p in patterns]
    monkeypatch.setattr(S, "SELECTIVE", 0)  # any number of candidates goes through the postings
    plans = [S.search(index, p, True, k=100) for p in patterns]
    assert [p.collect() for p in plans] == scanned and sum(map(bool, scanned)) == 4
    assert "gram" in plans[0]._jdf.queryExecution().executedPlan().toString()
    for pattern, rows in zip(patterns, scanned):
        assert S.found_any(index, pattern, True).first()[0] == bool(rows)
    assert not S.found_any(index, "(", True).first()[0] and S.found_any(index, "quark").first()[0]


def test_sql_functions_take_patterns_of_rows(spark):
    sql.register_functions(spark)
    rows = [("(", "a"), ("a(?=b)", "ab"), (r"^\w+$", "café"), (None, "a"), ("a", None), ("a*", "a")]
    spark.createDataFrame(rows, "p string, t string").createOrReplaceTempView("row_patterns")
    got = sql.query(spark, "SELECT regexp_match(p, t), glob_match(p, t), regexp_match(:q, t) FROM row_patterns", q=r"^\w+$")
    assert [tuple(r) for r in got.collect()] == [
        (False, False, True), (False, False, True), (True, False, True), (None, None, True), (None, None, None), (True, True, True),
    ]
