"""Column expressions that turn page sources into names, descriptions and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of HTML that start a new line, and those that do not. Only
# these names count as tags, so that ``#include <stdio.h>`` stays in the text.
BLOCK_TAGS = (
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul"
)
INLINE_TAGS = (
    "a abbr acronym area audio b base bdi bdo big button canvas caption cite code col colgroup "
    "data datalist del dfn em embed font i iframe img input ins kbd label link map mark meta meter "
    "noscript object output param picture progress q rp rt ruby s samp select slot small source "
    "span strike strong sub sup svg template textarea time track tt u var video wbr"
)
# The entities that are replaced. ``&amp;`` comes last, so that ``&amp;lt;``
# yields ``&lt;``.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&amp;", "&"),
)

OVERSTRIKE = "(?s).\\x08"
HIDDEN = "(?is)<(?:!--.*?-->|script\\b[^>]*>.*?</script\\s*>|style\\b[^>]*>.*?</style\\s*>)"
DOCTYPE = "(?i)<!doctype[^>]*>"


def _tags(names: str) -> str:
    return f"(?i)</?(?:{'|'.join(names.split())})(?:[\\s/][^>]*)?>"


BLOCK = _tags(BLOCK_TAGS)
INLINE = _tags(INLINE_TAGS)


def plain_text(col: Column) -> Column:
    """Markup to text: overstrikes and hidden parts go, block tags become newlines.

    Each step reads the whole text, so it is left out where the source lacks the character that
    it starts from; no step before it makes one. The first also mends what is not UTF-8.
    """
    text = F.replace(F.regexp_replace(col, OVERSTRIKE, ""), F.lit("\b"), F.lit(""))
    struck = F.contains(col, F.lit("\b")) | ~F.is_valid_utf8(col)
    kept = F.when(struck, text).otherwise(col)
    text = kept
    for pattern, put in ((HIDDEN, ""), (DOCTYPE, ""), (BLOCK, "\n"), (INLINE, "")):
        text = F.regexp_replace(text, pattern, put)
    kept = F.when(F.contains(col, F.lit("<")), text).otherwise(kept)
    text = kept
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.when(F.contains(col, F.lit("&")), text).otherwise(kept)


def trim_whitespace(col: Column) -> Column:
    """Strip every Unicode whitespace character at both ends."""
    return F.regexp_replace(col, "(?U)\\A\\s+|\\s+\\z", "")


def join_lines(col: Column) -> Column:
    """Delete a newline that a non-space follows; nothing is put in its place."""
    return F.regexp_replace(col, "(?U)\\n(\\S)", "$1")


def collapse_whitespace(col: Column) -> Column:
    """Two or more whitespace characters become one space; a single one stays."""
    return F.regexp_replace(col, "(?U)\\s\\s+", " ")


def description(text: Column) -> Column:
    """What stands between the first ``NAME`` and the blank line after it, on one line.

    ``''`` when there is no ``NAME`` or no blank line behind it.
    """
    at = F.instr(text, "NAME")
    rest = F.substr(text, at + F.lit(4))
    section = F.when((at > 0) & F.contains(rest, F.lit("\n\n")), F.substring_index(rest, "\n\n", 1))
    line = collapse_whitespace(join_lines(trim_whitespace(section)))
    return F.coalesce(line, F.lit(""))


def page_name(path: Column) -> Column:
    """Base name of the path without any ``.gz`` at its end."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?:\\.gz)+\\z", "")


def checked_text(col: Column) -> Column:
    """Text as the catalogue reads it: NULL is an error, the value ends at the first NUL."""
    missing = F.raise_error(F.lit("text column is NULL"))
    return F.when(col.isNull(), missing).otherwise(until_nul(col))


def until_nul(col: Column) -> Column:
    return F.substring_index(col, "\0", 1)


def section_and_mtime(derive: bool, name: Column, modified: Column | None) -> tuple[Column, Column]:
    """The constants 1 and 0, or on request the name's section digit and the file time."""
    if not derive:
        return F.lit(1), F.lit(0).cast("long")
    digit = F.regexp_extract(name, "\\.([0-9])[^.]*\\z", 1)
    section = F.when(digit != "", digit.cast("int")).otherwise(F.lit(1))
    mtime = F.lit(0).cast("long") if modified is None else F.unix_timestamp(modified)
    return section, mtime


def shorten(text: Column, width: int = 55) -> Column:
    return F.left(text, F.lit(width))


def fold(col: Column) -> Column:
    """Case folding that maps every character to exactly one, wherever it stands.

    ``lower`` alone breaks that twice: it doubles a dotted capital I, and it picks the
    sigma by its neighbours. Both would make a pattern's grams differ from the text's.
    """
    lowered = F.lower(F.replace(col, F.lit("İ"), F.lit("i")))
    return F.replace(lowered, F.lit("ς"), F.lit("σ"))
