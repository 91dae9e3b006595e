"""SQL access: the match functions, and queries with bound values."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from leafscan.functions.automaton import row_matcher
from leafscan.functions.glob import glob_to_dialect, glob_to_regex
from leafscan.functions.regex import native_pattern, tree_of
from leafscan.sources.tables import Index


def register_functions(spark: SparkSession) -> None:
    """``regexp_match(pattern, txt)`` and ``glob_match(pattern, txt)``, in the dialects of the
    library, for patterns that are constants, bound values or columns.

    An invalid pattern matches nothing; a null on either side gives null.
    """
    spark.udf.register("regexp_rows", row_matcher())
    spark.udf.register("glob_rows", row_matcher(glob_to_dialect))
    bodies = {
        "regexp_match": "regexp_rows(pattern, txt)",
        "glob_match": "glob_rows(pattern, txt)",
        # for patterns in the JVM's own form
        "regexp_native": "txt RLIKE pattern",
    }
    for name, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(pattern STRING, txt STRING) "
            f"RETURNS BOOLEAN DETERMINISTIC RETURN {body}"
        )


def register_tables(index: Index) -> None:
    """``page`` and ``fts`` as temporary views."""
    index.page.drop("batch", "block").createOrReplaceTempView("page")
    index.fts.drop("batch", "block", "n_grams").createOrReplaceTempView("fts")


# A match function whose pattern is a bound value.
BOUND = re.compile(r"\b(?P<function>regexp|glob)_match(?P<open>\s*\(\s*):(?P<name>\w+)(?=\s*,)", re.I)


def query(spark: SparkSession, sql: str, **args: Any) -> DataFrame:
    """A statement with its named values bound.

    A bound pattern of a match function is translated before, where the JVM can run it.
    """

    def translated(call: re.Match) -> str:
        pattern, java = args.get(call["name"]), None
        if isinstance(pattern, str) and call["function"].lower() == "glob":
            java = glob_to_regex(pattern)
        elif isinstance(pattern, str) and (tree := tree_of(pattern)) is not None:
            java = native_pattern(spark, pattern, tree)
        if java is None:
            return call.group()
        name = f"{call['name']}_{call['function'].lower()}"
        bound[name] = java
        return f"regexp_native{call['open']}:{name}"

    bound = dict(args)
    return spark.sql(BOUND.sub(translated, sql), args=bound)
