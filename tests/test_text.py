import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafscan.functions import text


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_description(spark):
    cases = {
        "x\n\nNAME\n       ls - list\n       files\n\nSYNOPSIS\n": "ls - list files",
        "no heading\n\nhere": "",
        "NAME without a blank line\n": "",
        "FILENAME(7)\n\nNAME\n  late\n\n": "(7)",
        "NAME\nfoo\nbar\n\n": "foobar",
        "NAME\n a\tb  c \n\n": "a\tb c",
        "NAME\n\n": "",
        "": "",
        None: "",
    }
    assert evaluate(spark, cases, text.description) == list(cases.values())


def test_trim_takes_every_unicode_space(spark):
    values = [" \n a b\t ", "a \n", "　"]
    assert evaluate(spark, values, text.trim_whitespace) == ["a b", "a", ""]


def test_page_name(spark):
    paths = ["/m/man7/socket.7.gz", "/m/man1/a.1.gz.gz", "/m/man1/foogz", "b.gz\n", "x.gz"]
    assert evaluate(spark, paths, text.page_name) == ["socket.7", "a.1", "foogz", "b.gz\n", "x"]


def test_plain_text(spark):
    cases = {
        "N\bNA\bAM\bME\bE _\bx": "NAME x",
        "<p>a<b>b</b></p>": "\nab\n",
        "x<!-- y -->z<script>if (a<b) {}</script><STYLE>p{}</STYLE>": "xz",
        "#include <stdio.h>": "#include <stdio.h>",
        "&lt;b&gt; &amp;lt; &quot;&#39;&apos;&nbsp;": "<b> &lt; \"''\u00a0",
        "a<br/>b<img src='x'>": "a\nb",
    }
    assert evaluate(spark, cases, text.plain_text) == list(cases.values())


def test_checked_text(spark):
    assert evaluate(spark, ["a\0b", "c"], text.checked_text) == ["a", "c"]
    with pytest.raises(PySparkException):
        evaluate(spark, [None], text.checked_text)


def test_section_and_mtime(spark):
    rows = spark.createDataFrame([("socket.7",), ("perl.1pm",), ("README",)], "name string")
    rows = rows.withColumn("m", F.timestamp_seconds(F.lit(9)))
    fixed = text.section_and_mtime(False, F.col("name"), F.col("m"))
    derived = text.section_and_mtime(True, F.col("name"), F.col("m"))
    assert [tuple(r) for r in rows.select(*fixed).collect()] == [(1, 0)] * 3
    assert [tuple(r) for r in rows.select(*derived).collect()] == [(7, 9), (1, 9), (1, 9)]


def test_fold_keeps_length_and_context(spark):
    values = ["ΣΑΣ", "İX", "ÀÉ", "straße"]
    assert evaluate(spark, values, text.fold) == ["σασ", "ix", "àé", "straße"]
    lengths = evaluate(spark, values, lambda c: F.char_length(text.fold(c)))
    assert lengths == [len(v) for v in values]


def test_plain_text_leaves_steps_out(spark):
    """Any mix of the characters that steps start from, and bytes that are no UTF-8."""
    parts = ("a\b", "<b>x</b>", "<!-- & \b -->", "&lt;i&gt;", "é\n", "<p>", "&amp;lt;")
    sources = [a + b + c for a in ("", *parts) for b in ("", *parts) for c in ("q", *parts)]

    def all_steps(col):
        out = F.replace(F.regexp_replace(col, text.OVERSTRIKE, ""), F.lit("\b"), F.lit(""))
        for pattern, put in ((text.HIDDEN, ""), (text.DOCTYPE, ""), (text.BLOCK, "\n"), (text.INLINE, "")):
            out = F.regexp_replace(out, pattern, put)
        for entity, char in text.ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return out

    rows = spark.createDataFrame([(source,) for source in [*sources, None]], "v string")
    broken = spark.sql("SELECT CAST(x'61ff62' AS STRING) AS v")
    both = rows.unionByName(broken).select("v", text.plain_text(F.col("v")).alias("a"), all_steps(F.col("v")).alias("b"))
    assert [(r.v, r.a) for r in both.collect() if r.a != r.b] == []
    # steps whose character is missing are not run: a regex for each character of a text is dear
    plan = rows.select(text.plain_text(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("regexp_replace") and "Contains(v" in plan
