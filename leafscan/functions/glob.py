"""Glob patterns: whole-string, case-sensitive, with ``*``, ``?`` and ``[...]``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = "(?!)"
WILD = "*?["


def wrap_substring(pattern: str) -> str:
    """A bare word searches for a substring; a lone ``*`` serves as both ends."""
    front = pattern if pattern.startswith("*") else "*" + pattern
    return front if front.endswith("*") else front + "*"


def _hex(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def quote(text: str) -> str:
    """The text as a regex literal; letters and digits stay readable."""
    return "".join(c if c.isalnum() and c.isascii() else _hex(c) for c in text)


def _class_end(pattern: str, start: int) -> int:
    """Index of the ``]`` that closes the class opened at start, or -1."""
    first = start + 1
    if pattern[first : first + 1] == "^":
        first += 1
    # a bracket standing first is a member, so the search starts behind it
    return pattern.find("]", first + 1)


def _char_class(body: str) -> str:
    """Regex class of a glob class body; the body is never empty."""
    negated = len(body) > 1 and body[0] == "^"
    members = body[1:] if negated else body
    # a leading bracket is a member of its own and starts no range
    parts = [_hex("]")] if members[0] == "]" else []
    members = members[len(parts) :]
    for span in re.finditer("(?s)(.)-(.)|(.)", members):
        low, high, single = span.groups()
        if single:
            parts.append(_hex(single))
        elif low <= high:
            parts.append(f"{_hex(low)}-{_hex(high)}")
        else:
            # a reversed range holds nothing, but its first end counts as a member
            parts.append(_hex(low))
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """Split into ``(kind, text)``: kind is ``lit``, ``*``, ``?``, ``class`` or ``open``."""
    at = 0
    while at < len(pattern):
        char = pattern[at]
        if char in "*?":
            yield char, char
            at += 1
        elif char == "[":
            end = _class_end(pattern, at)
            if end < 0:
                yield "open", pattern[at:]
                return
            yield "class", pattern[at + 1 : end]
            at = end + 1
        else:
            run = re.match(r"[^*?\[]+", pattern[at:]).group()
            yield "lit", run
            at += len(run)


def glob_to_regex(pattern: str) -> str:
    """Regex that finds a match exactly where the glob matches the whole text.

    What stands between two stars may settle at its first fit, so each such piece is
    an atomic group and matching takes one pass over the text for each piece.
    """
    pieces = [""]
    for kind, text in tokens(pattern):
        if kind == "open":
            return NEVER
        if kind == "*":
            pieces.append("")
        else:
            pieces[-1] += {"lit": quote, "?": lambda _: ".", "class": _char_class}[kind](text)
    if len(pieces) == 1:
        return f"(?s)\\A{pieces[0]}\\z"
    first, *inner, last = pieces
    middle = "".join(f"(?>.*?{piece})" for piece in inner if piece)
    tail = f".*{last}\\z" if last else ""
    return f"(?s)\\A{first}{middle}{tail}"


def glob_to_dialect(pattern: str) -> str | None:
    """The glob in the regex dialect of this library; None if it matches nothing."""
    pieces = []
    for kind, text in tokens(pattern):
        if kind == "open":
            return None
        pieces.append({"lit": quote, "*": lambda _: ".*", "?": lambda _: ".", "class": _char_class}[kind](text))
    return f"(?s)\\A{''.join(pieces)}\\z"


def glob_match(col: Column, pattern: str) -> Column:
    """Glob test; plain shapes become string functions that the Parquet scan can use."""
    parts = list(tokens(pattern))
    if parts and parts[-1][0] == "open":
        return F.lit(False)
    shape = "".join("L" if kind == "lit" else kind[0] for kind, _ in parts)
    shape = re.sub(r"\*+", "*", shape)
    literal = next((text for kind, text in parts if kind == "lit"), "")
    if shape == "*":
        return col.isNotNull()
    if shape == "*L*":
        return F.contains(col, F.lit(literal))
    if shape == "L*":
        return F.startswith(col, F.lit(literal))
    if shape == "*L":
        return F.endswith(col, F.lit(literal))
    if shape in ("L", ""):
        return col == F.lit(literal)
    return col.rlike(glob_to_regex(pattern))


def plain_needle(pattern: str) -> str | None:
    """The literal of a ``*literal*`` pattern, else None."""
    inner = pattern.strip("*")
    bare = pattern.startswith("*") and pattern.endswith("*") and not any(c in inner for c in WILD)
    return inner if bare else None


def fold(text: str) -> str:
    """Same folding as ``functions.text.fold``, for pattern literals."""
    return "".join(c.lower() for c in text.replace("İ", "i")).replace("ς", "σ")


def pattern_grams(pattern: str) -> list[str]:
    """Every 3-character window of the literal runs, folded, repeats kept."""
    grams = []
    for kind, text in tokens(pattern):
        if kind == "open":
            return []
        if kind == "lit":
            run = fold(text)
            grams += [run[i : i + 3] for i in range(len(run) - 2)]
    return grams
