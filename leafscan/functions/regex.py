"""Unanchored regular expressions in the shared, look-around-free dialect.

Patterns are written for an engine without look-around and back-references, with
Unicode classes, ``.`` stopping at a newline only and ``$`` at the very end. The JVM
reads some of that differently, so each piece is put the way the JVM needs it, and
what the dialect lacks is refused.
"""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leafscan.functions import charsets
from leafscan.functions.automaton import automaton, matcher
from leafscan.functions.glob import fold as fold_literal
from leafscan.functions.glob import quote
from leafscan.functions.syntax import (
    ASCII_CLASSES,
    ESCAPE,
    GROUP,
    REPEAT,
    PatternError,
    backtracks_little,
    parse,
    required,
    syntax_tree,
)
from leafscan.functions.text import fold

log = logging.getLogger(__name__)


class One(str):
    """A piece that matches exactly one character and may stand in a bracket class."""


# How the JVM spells control characters.
CONTROL = {"n": "\\n", "t": "\\t", "r": "\\r", "f": "\\f", "a": "\\x07", "v": "\\x0b"}


def _escape(pattern: str, at: int, in_class: bool) -> tuple[str, int]:
    found = ESCAPE.match(pattern, at)
    if not found or (in_class and found["edge"]):
        raise PatternError(f"unsupported escape at {at}: {pattern[at : at + 2]!r}")
    if found["hex"]:
        out = f"\\x{{{found['hex'][1:].strip('{}')}}}"
    elif found["prop"]:
        kind, name = found["prop"][0], found["prop"][1:].strip("{}")
        if name.startswith("^"):
            kind, name = ("P" if kind == "p" else "p"), name[1:]
        out = f"\\{kind}{{{name if len(name) <= 2 or '=' in name else 'Is' + name}}}"
    elif found["ctl"]:
        out = CONTROL[found["ctl"]]
    elif found["lit"]:
        out = quote(found["lit"])
    else:
        out = found.group()
    return out, found.end()


def _bracket(pattern: str, at: int, spaced: bool) -> tuple[str, int]:
    """Bracket class from its ``[``; every literal member leaves as an escape."""
    out, at = "[", at + 1
    if pattern[at : at + 1] == "^":
        out, at = "[^", at + 1
    first = True
    while at < len(pattern):
        char, pair = pattern[at], pattern[at : at + 2]
        named = re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, at)
        if char == "]" and not first:
            return out + "]", at + 1
        if pair in ("--", "~~") and not first:
            raise PatternError(f"class operator {pair} is not supported")
        if named and named[2] in ASCII_CLASSES:
            piece, at = f"[{named[1]}{ASCII_CLASSES[named[2]]}]", named.end()
        elif char == "[":
            piece, at = _bracket(pattern, at, spaced)
        elif pair == "&&":
            piece, at = "&&", at + 2
        elif char == "\\":
            piece, at = _escape(pattern, at, True)
        elif spaced and char.isspace():
            piece, at = "", at + 1
        elif char == "-" and not first and pattern[at + 1 : at + 2] not in ("]", ""):
            piece, at = "-", at + 1
        else:
            piece, at = quote(char), at + 1
        out, first = out + piece, False
    raise PatternError("unclosed character class")


def to_java(pattern: str) -> str:
    """The pattern as the JVM must see it, or PatternError."""
    # flags of the open groups (m: multi-line, x: spaced), innermost last
    flags, out, names = [{"m": False, "x": False}], [], set()
    atoms: list[int | None] = [None]  # where the last repeatable piece starts, per group
    repeated, starts, at = False, [], 0
    while at < len(pattern):
        char = pattern[at]
        if flags[-1]["x"] and (char.isspace() or char == "#"):
            line_end = pattern.find("\n", at)
            at = at + 1 if char != "#" else (len(pattern) if line_end < 0 else line_end + 1)
            continue
        repeat = REPEAT.match(pattern, at)
        if repeat:
            if atoms[-1] is None:
                raise PatternError("nothing to repeat")
            if repeated:
                # a second sign repeats the repetition; the JVM would read it as possessive
                out[atoms[-1] :] = ["(?:", *out[atoms[-1] :], ")"]
            lazy = pattern[repeat.end() : repeat.end() + 1] == "?"
            out.append(repeat.group() + ("?" if lazy else ""))
            repeated, at = True, repeat.end() + lazy
            continue
        repeated, begin = False, len(out)
        if char == "\\":
            edge = ESCAPE.match(pattern, at)
            piece, at = _escape(pattern, at, False)
            piece = piece if edge["edge"] else One(piece)
        elif char == "[":
            piece, at = _bracket(pattern, at, flags[-1]["x"])
            piece = One(piece)
        elif char == "(":
            group = GROUP.match(pattern, at)
            at = group.end()
            if group["name"] in names or pattern[at - 1 : at + 1] == "(?":
                raise PatternError("unsupported or repeated group")
            names |= {group["name"]} - {None}
            on, _, off = (group["flags"] or "").partition("-")
            if set(on) - set("imsux") or set(off) - set("imsx"):
                raise PatternError("unsupported flag")
            now = flags[-1] | {f: True for f in on if f in "mx"} | {f: False for f in off if f in "mx"}
            # the JVM's own flags; spacing and line ends are resolved here
            java = "".join(f for f in on if f in "is")
            java_off = "".join(f for f in off if f in "is")
            sign = java + ("-" + java_off if java_off else "")
            if group["end"] == ")":
                flags[-1] = now
                out.append(f"(?{sign})" if sign else "")
                continue
            out.append(f"(?{sign}:")
            flags.append(now)
            starts.append(begin)
            atoms.append(None)
            continue
        elif char == ")":
            if not starts:
                raise PatternError("unopened group")
            flags.pop()
            atoms.pop()
            atoms[-1] = start = starts.pop()
            inner = out[start + 1 :]
            if out[start] == "(?:" and len(inner) % 2 and all(
                p == "|" if i % 2 else isinstance(p, One) for i, p in enumerate(inner)
            ):
                # a choice of single characters is a class, which the JVM repeats without recursion
                out[start:] = [One(f"[{''.join(inner[::2])}]")]
            else:
                out.append(")")
            at += 1
            continue
        elif char == "|":
            out.append("|")
            atoms[-1] = None
            at += 1
            continue
        elif char in "^$":
            ends = {"^": ("\\A", "(?:\\A|(?<=\\n))"), "$": ("\\z", "(?=\\n|\\z)")}
            piece, at = ends[char][flags[-1]["m"]], at + 1
        elif char == ".":
            piece, at = ".", at + 1
        elif char == "{":
            raise PatternError("unclosed repetition")
        else:
            piece, at = One(quote(char)), at + 1
        out.append(piece)
        atoms[-1] = begin
    if starts:
        raise PatternError("unclosed group")
    return "(?dU)" + "".join(out)


def tree_of(pattern: str) -> tuple | None:
    """Syntax tree of a valid pattern; None, with a reason logged, for an invalid one."""
    try:
        return parse(pattern)
    except PatternError as error:
        log.warning("pattern %r matches nothing: %s", pattern, error)
        return None


def _condition(needs, col: Column) -> Column | None:
    """The literals of ``required`` as plain substring tests, which the Parquet scan can use."""
    if needs is True:
        return None
    if needs[0] == "lit":
        return F.contains(col, F.lit(needs[1]))
    parts = [_condition(part, col) for part in needs[1]]
    return reduce(Column.__and__ if needs[0] == "and" else Column.__or__, parts)


# Sets that the JVM has a sign for, and how it spells edges.
SIGNS = {"w": charsets.word, "d": charsets.digit, "s": lambda: charsets.WHITE_SPACE}
EDGES = {"A": "\\A", "z": "\\z", "^": "(?:\\A|(?<=\\n))", "$": "(?=\\n|\\z)", "b": "\\b", "B": "\\B"}


def spelled(tree: tuple) -> str:
    """A syntax tree as a JVM pattern, to be read with the flags ``(?dU)``."""
    kind, value = tree[:2]
    if kind == "edge":
        return EDGES[value]
    if kind == "set":
        for sign, ranges in SIGNS.items():
            if value in (ranges(), charsets.negated(ranges())):
                return f"\\{sign if value == ranges() else sign.upper()}"
        spans = (f"\\x{{{low:x}}}" + (f"-\\x{{{high:x}}}" if high > low else "") for low, high in value)
        return f"[{''.join(spans)}]" if value else "(?!)"
    if kind == "cat":
        return "".join(map(spelled, value))
    if kind == "alt":
        return f"(?:{'|'.join(map(spelled, value))})"
    _, inner, least, most = tree
    return f"(?:{spelled(inner)}){{{least},{'' if most is None else most}}}"


def native_pattern(spark: SparkSession, pattern: str, tree: tuple) -> str | None:
    """JVM form of a pattern that the JVM's matcher runs in bounded steps from each place."""
    if not backtracks_little(tree):
        return None
    # as it was written if the search needs all of it
    if tree == syntax_tree(pattern):
        try:
            java = to_java(pattern)
            spark._jvm.java.util.regex.Pattern.compile(java)
            return java
        except Exception:  # what only the syntax tree can say: class operators, some properties
            log.debug("pattern %r is spelled out for the JVM", pattern)
    return "(?dU)" + spelled(tree)


def regex_needs(tree: tuple, col: Column) -> Column | None:
    """What a text must hold for a match, as plain substring tests; None if nothing is known."""
    needed = _condition(required(tree), col)
    return needed if needed is not None else _condition(required(tree, fold_literal), fold(col))


def regex_match(spark: SparkSession, col: Column, pattern: str) -> Column:
    """Unanchored match; an invalid pattern matches nothing instead of failing the job.

    Time is linear in the text. A pattern without unbounded repetition is left to the JVM;
    any other runs as an automaton over Arrow batches. Either looks only at texts that hold
    the literals that every match needs.
    """
    tree = tree_of(pattern)
    if tree is None:
        return F.lit(False)
    needed, java = regex_needs(tree, col), native_pattern(spark, pattern, tree)
    if java is not None:
        return col.rlike(java) if needed is None else needed & col.rlike(java)
    found = matcher(automaton(tree))
    if needed is None:
        return F.when(col.isNotNull(), found(col))
    # texts without the literals do not reach Python
    return needed & found(F.when(needed, col))
