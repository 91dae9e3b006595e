import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafscan.functions import glob
from leafscan.functions.regex import PatternError, regex_match, to_java


def brute_glob(pattern: str, text: str) -> bool:
    """Glob by recursion over the pattern, for short inputs."""
    if not pattern:
        return not text
    head, rest = pattern[0], pattern[1:]
    if head == "*":
        return any(brute_glob(rest, text[i:]) for i in range(len(text) + 1))
    if head == "?":
        return bool(text) and brute_glob(rest, text[1:])
    if head != "[":
        return text[:1] == head and brute_glob(rest, text[1:])
    at = 1
    negated = pattern[at : at + 1] == "^"
    at += negated
    close = pattern.find("]", at + 1)
    if close < 0 or not text:
        return False
    members, seen, previous, i = pattern[at:close], False, None, 0
    while i < len(members):
        c = members[i]
        if c == "]" and i == 0:
            seen |= text[0] == "]"
        elif c == "-" and previous and i + 1 < len(members):
            i += 1
            seen |= previous <= text[0] <= members[i]
            previous = None
        else:
            seen |= text[0] == c
            previous = c
        i += 1
    return seen != negated and brute_glob(pattern[close + 1 :], text[1:])


TRUTH = [
    ("*", "", True),
    ("*", "a\nb\n", True),
    ("?", "", False),
    ("?", "\U0001f600", True),
    ("a.b", "axb", False),
    ("a.b", "a.b", True),
    ("[a-c]x", "bx", True),
    ("[^a]", "\n", True),
    ("[^a]", "a", False),
    ("[]]", "]", True),
    ("[a-", "a", False),
    ("abc", "ABC", False),
    ("abc", "abc\n", False),
    ("*c", "abc\n", False),
    ("a*b*c", "a1b2b3c", True),
    ("a*b*c", "a1c2b3", False),
    ("[c-a]", "c", True),
    ("[c-a]", "b", False),
    ("*[*]*", "a*b", True),
    ("\\d", "\\d", True),
    ("", "", True),
    ("", "a", False),
]


def glob_flags(spark, cases):
    columns = [glob.glob_match(F.lit(text), pattern) for pattern, text in cases]
    regexes = [F.lit(text).rlike(glob.glob_to_regex(pattern)) for pattern, text in cases]
    row = spark.range(1).select(F.array(*columns), F.array(*regexes)).first()
    assert row[0] == row[1]
    return row[0]


def test_glob_truth_table(spark):
    assert glob_flags(spark, [case[:2] for case in TRUTH]) == [case[2] for case in TRUTH]
    assert [brute_glob(p, t) for p, t, _ in TRUTH] == [case[2] for case in TRUTH]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.text(alphabet="ab*?[]^-\n", max_size=7), st.text(alphabet="ab]-^\n", max_size=6)
        ),
        min_size=20,
        max_size=40,
    )
)
def test_glob_against_brute_force(spark, cases):
    assert glob_flags(spark, cases) == [brute_glob(p, t) for p, t in cases]


def test_wrap_substring():
    cases = {"a": "*a*", "*a": "*a*", "a*": "*a*", "": "*", "*": "*", "*a*b*": "*a*b*"}
    assert {p: glob.wrap_substring(p) for p in cases} == cases


def test_pattern_grams():
    assert glob.pattern_grams("*Socket*") == ["soc", "ock", "cke", "ket"]
    assert glob.pattern_grams("*ab?cde[x-z]fgh*") == ["cde", "fgh"]
    assert glob.pattern_grams("*aaaa*") == ["aaa", "aaa"]
    assert glob.pattern_grams("*ab*") == glob.pattern_grams("*abc[") == []


def test_plain_shapes_reach_the_scan(spark, small_index):
    for pattern, kind in (("*sock*", "Contains"), ("sock*", "StartsWith"), ("*.7", "EndsWith")):
        hit = small_index.fts.where(glob.glob_match(F.col("name"), pattern)).select("name")
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert f"String{kind}(name," in plan


REGEX_TRUTH = [
    ("b", "abc", True),
    ("^b", "abc", False),
    ("c$", "abc", True),
    ("c$", "abc\n", False),
    ("(?m)c$", "abc\nd", True),
    ("(?m)^$", "a\n", True),
    ("a.c", "a\nc", False),
    ("a.c", "a\rc", True),
    ("(?s)a.c", "a\nc", True),
    (r"\bé", "é", True),
    (r"^\w+$", "née", True),
    (r"\d", "٣", True),
    ("(?i)É", "é", True),
    ("(?x) a b # c", "ab", True),
    ("[[:alpha:]]", "é", False),
    ("[[:digit:]x]", "x", True),
    ("[]a]", "]", True),
    ("[^]a]", "]", False),
    ("[a&&b]", "a", False),
    ("[a-]", "-", True),
    (r"[\]x]", "]", True),
    (r"\x41\u{42}\x{43}", "ABC", True),
    (r"\pL\p{Greek}", "aα", True),
    (r"\p{^L}", "a", False),
    ("a*+a", "aa", True),
    ("a{2}{2}", "aaaa", True),
    ("(?P<x>a)(?:b)", "ab", True),
    ("a||b", "", True),
    (r"\v", "\x0b", True),
    (r"\v", "\n", False),
    ("", "", True),
    ("a-z", "a-z", True),
]
REFUSED = [
    "(", ")", "*a", "(*a)", "a(?=b)", "(?<!a)b", "(?>a)", r"(a)\1", r"\Q.\E", r"\Z", r"\h", "[a", "a{", "[z",
    "(?P<x>a)(?P<x>b)", "(?R)a", "[a--b]",
]


def test_regex_truth_table(spark):
    columns = [F.lit(text).rlike(to_java(pattern)) for pattern, text, _ in REGEX_TRUTH]
    row = spark.range(1).select(F.array(*columns)).first()[0]
    wrong = [case for case, got in zip(REGEX_TRUTH, row) if case[2] != got]
    assert wrong == []


@pytest.mark.parametrize("pattern", REFUSED)
def test_regex_refused(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_invalid_regex_matches_nothing(spark):
    rows = spark.createDataFrame([("a",)], "v string")
    for pattern in ("(", r"\p{Nonsense}", "b{3,2}"):
        assert rows.where(regex_match(spark, F.col("v"), pattern)).count() == 0


def test_repeated_choice_of_characters_over_long_text(spark):
    """Such a group becomes a class; as a group it would overflow the JVM's stack."""
    assert "|" not in to_java(r"(?:\w|\s|[^a-z]|(?:x|y))*z")
    assert "|" in to_java(r"(?:ab|c)*z") and "|" in to_java(r"(?:\b|c)z")
    text = F.repeat(F.lit("ab "), 10_000)
    row = spark.range(1).select(
        F.concat(text, F.lit("zzzz")).rlike(to_java(r"^(?:\w|\s)*zzzz$")).alias("hit"),
        text.rlike(to_java(r"^(?:\w|\s)*zzzz")).alias("miss"),
        F.lit("a-b]c^").rlike(to_java(r"^(a|-|\]|\^|[b-c])+$")).alias("signs"),
        F.lit("a&&b").rlike(to_java(r"^(?:a|&|&|b)+$")).alias("ands"),
    ).first()
    assert row.asDict() == {"hit": True, "miss": False, "signs": True, "ands": True}
