"""Syntax trees of the regex dialect, and what is read off them.

A node is one of ``("set", ranges)``, ``("edge", kind)``, ``("cat", nodes)``, ``("alt", nodes)``
and ``("rep", node, least, most)`` with ``most`` None where there is no bound. Edges are
``A`` and ``z`` for the ends of the text, ``^`` and ``$`` for those of a line, ``b`` and ``B``.
"""

from __future__ import annotations

import re
from itertools import product

from leafscan.functions import charsets
from leafscan.functions.charsets import Ranges


class PatternError(ValueError):
    """The pattern is not valid in the dialect."""


class UnsupportedPattern(ValueError):
    """The pattern is valid, but too large to be run."""


# ASCII bracket classes.
ASCII_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": "\\x00-\\x7f",
    "blank": "\\t ",
    "cntrl": "\\x00-\\x1f\\x7f",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": "!-/:-@\\[-`{-~",
    "space": "\\t\\n\\x0b\\f\\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

ESCAPE = re.compile(
    r"""\\(?:
      (?P<hex>x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[xuU]\{[0-9A-Fa-f]+\})
    | (?P<prop>[pP](?:\{\^?[A-Za-z_=:0-9 ]+\}|[A-Za-z]))
    | (?P<set>[dDwWsS])
    | (?P<edge>[bBAz])
    | (?P<ctl>[ntrfav])
    | (?P<lit>[^0-9A-Za-z<>\s])
    )""",
    re.X,
)
GROUP = re.compile(r"\((?:\?P?<(?P<name>[A-Za-z_][A-Za-z0-9_.\[\]]*)>|\?(?P<flags>[a-zA-Z-]*)(?P<end>[:)]))?")
REPEAT = re.compile(r"[*+?]|\{(?P<least>[0-9]+)(?P<comma>,(?P<most>[0-9]*))?\}")
CONTROL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "a": "\x07", "v": "\x0b"}
NAMED_CLASS = re.compile(r"\[:(\^?)([a-z]+):\]")
OPERATORS = ("&&", "--", "~~")
EMPTY = ("cat", ())
# States that a pattern's repetitions may be written out to.
MOST_STATES = 20_000


def literal(char: str) -> tuple:
    return ("set", ((ord(char), ord(char)),))


class _Parser:
    """Recursive descent over one pattern."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at, self.names = pattern, 0, set()

    def parse(self) -> tuple:
        tree = self.choice({"i": False, "m": False, "s": False, "x": False})
        if self.at < len(self.pattern):
            raise PatternError("unopened group")
        return tree

    def choice(self, flags: dict[str, bool]) -> tuple:
        """Alternatives up to the end of a group; flags set inside last as long."""
        options: list[tuple] = []
        parts: list[tuple] = []
        may_repeat = False
        while self.at < len(self.pattern):
            char = self.pattern[self.at]
            if char == ")":
                break
            if flags["x"] and (char.isspace() or char == "#"):
                end = self.pattern.find("\n", self.at)
                self.at = self.at + 1 if char != "#" else (len(self.pattern) if end < 0 else end + 1)
                continue
            repeat = REPEAT.match(self.pattern, self.at)
            if repeat:
                if not may_repeat:
                    raise PatternError("nothing to repeat")
                parts[-1] = self.repeated(parts[-1], repeat)
                continue
            may_repeat = True
            if char == "|":
                self.at += 1
                options.append(("cat", tuple(parts)))
                parts, may_repeat = [], False
            elif char == "(":
                node = self.group(flags)
                may_repeat = node is not None
                parts += [node] if may_repeat else []
            else:
                parts.append(self.atom(char, flags))
        options.append(("cat", tuple(parts)))
        return options[0] if len(options) == 1 else ("alt", tuple(options))

    def repeated(self, node: tuple, repeat: re.Match) -> tuple:
        sign = repeat.group()
        self.at = repeat.end()
        if self.pattern[self.at : self.at + 1] == "?":  # whether greedy or not is no matter
            self.at += 1
        if sign in "*+?":
            return ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        least = int(repeat["least"])
        most = least if not repeat["comma"] else int(repeat["most"]) if repeat["most"] else None
        if most is not None and most < least:
            raise PatternError("reversed repetition")
        return ("rep", node, least, most)

    def group(self, flags: dict[str, bool]) -> tuple | None:
        """A group, or None where only flags are set."""
        group = GROUP.match(self.pattern, self.at)
        self.at = group.end()
        if group["name"] in self.names or self.pattern[self.at - 1 : self.at + 1] == "(?":
            raise PatternError("unsupported or repeated group")
        self.names |= {group["name"]} - {None}
        on, minus, off = (group["flags"] or "").partition("-")
        if set(on) - set("imsuxU") or set(off) - set("imsxU") or (minus and not off):
            raise PatternError("unsupported flag")
        now = flags | {f: True for f in on if f in flags} | {f: False for f in off if f in flags}
        if group["end"] == ")":
            flags.update(now)
            return None
        node = self.choice(now)
        if self.pattern[self.at : self.at + 1] != ")":
            raise PatternError("unclosed group")
        self.at += 1
        return node

    def atom(self, char: str, flags: dict[str, bool]) -> tuple:
        if char == "\\":
            edge = ESCAPE.match(self.pattern, self.at)
            if edge and edge["edge"]:
                self.at = edge.end()
                return ("edge", edge["edge"])
            ranges = self.escape()
        elif char == "[":
            return ("set", self.bracket(flags))
        elif char in "^$":
            self.at += 1
            return ("edge", char if flags["m"] else {"^": "A", "$": "z"}[char])
        elif char == "{":
            raise PatternError("unclosed repetition")
        else:
            self.at += 1
            ranges = ((ord(char), ord(char)),)
            if char == ".":
                ranges = charsets.ALL if flags["s"] else charsets.negated(((10, 10),))
        return ("set", charsets.any_case(ranges) if flags["i"] else ranges)

    def escape(self) -> Ranges:
        found = ESCAPE.match(self.pattern, self.at)
        if not found or found["edge"]:
            raise PatternError(f"unsupported escape at {self.at}: {self.pattern[self.at : self.at + 2]!r}")
        self.at = found.end()
        if found["hex"]:
            point = int(found["hex"][1:].strip("{}"), 16)
            if point >= charsets.LIMIT:
                raise PatternError("no such character")
            return ((point, point),)
        if found["ctl"] or found["lit"]:
            point = ord(CONTROL[found["ctl"]] if found["ctl"] else found["lit"])
            return ((point, point),)
        if found["set"]:
            sets = {"d": charsets.digit, "w": charsets.word, "s": lambda: charsets.WHITE_SPACE}
            ranges, upper = sets[found["set"].lower()](), found["set"].isupper()
        else:
            name = found["prop"][1:].strip("{}")
            upper = (found["prop"][0] == "P") != name.startswith("^")
            try:
                ranges = charsets.named(name.removeprefix("^"))
            except charsets.UnknownSet as error:
                raise PatternError(str(error)) from error
        return charsets.negated(ranges) if upper else ranges

    def bracket(self, flags: dict[str, bool]) -> Ranges:
        """A bracket class: unions of members, joined by operators from left to right."""
        pattern, self.at = self.pattern, self.at + 1
        negate = pattern[self.at : self.at + 1] == "^"
        self.at += negate
        whole: Ranges | None = None
        operator, union, first = "", [], True

        def closed() -> Ranges:
            part = charsets.normal(union)
            part = charsets.any_case(part) if flags["i"] else part
            if operator == "&&":
                return charsets.both(whole, part)
            if operator == "--":
                return charsets.both(whole, charsets.negated(part))
            if operator == "~~":
                either = charsets.normal(whole + part)
                return charsets.both(either, charsets.negated(charsets.both(whole, part)))
            return part

        while self.at < len(pattern):
            char, pair = pattern[self.at], pattern[self.at : self.at + 2]
            if char == "]" and not first:
                self.at += 1
                ranges = closed()
                return charsets.negated(ranges) if negate else ranges
            named = NAMED_CLASS.match(pattern, self.at)
            if pair in OPERATORS and not first:
                whole, operator, union = closed(), pair, []
                self.at += 2
                continue
            if named and named[2] in ASCII_CLASSES:
                self.at = named.end()
                ranges = _Parser(f"[{ASCII_CLASSES[named[2]]}]").bracket({"i": False, "x": False})
                union += charsets.negated(ranges) if named[1] else ranges
            elif char == "[":
                union += self.bracket(flags)
            elif flags["x"] and char.isspace():
                self.at += 1
            else:
                union += self.member(char)
            first = False
        raise PatternError("unclosed character class")

    def member(self, char: str) -> Ranges:
        """One character, escape or range of a bracket class."""
        pattern = self.pattern
        if char == "\\":
            low = self.escape()
        else:
            self.at += 1
            low = ((ord(char), ord(char)),)
        after = pattern[self.at + 1 : self.at + 2]
        if pattern[self.at : self.at + 1] != "-" or after in ("]", "", "-") or (after == "[" and char != "["):
            return low
        self.at += 1
        high = self.escape() if after == "\\" else ((ord(after), ord(after)),)
        self.at += after != "\\"
        if charsets.size(low) != 1 or charsets.size(high) != 1 or low > high:
            raise PatternError("invalid range")
        return ((low[0][0], high[0][0]),)


def syntax_tree(pattern: str) -> tuple:
    """The syntax tree of a pattern as it is written, or PatternError."""
    return _Parser(pattern).parse()


def parse(pattern: str) -> tuple:
    """What a search for the pattern has to find, or PatternError."""
    return searchable(syntax_tree(pattern))


def searchable(node: tuple) -> tuple:
    """The same pattern for a search that only asks whether there is a match: what may repeat
    at either end need not do so more often than it must."""
    if node[0] == "alt":
        return ("alt", tuple(map(searchable, node[1])))
    parts = list(node[1]) if node[0] == "cat" else [node]
    for end in (0, -1):
        while parts and parts[end][0] == "rep" and parts[end][2] != parts[end][3]:
            _, inner, least, _ = parts[end]
            if not least:
                del parts[end]
            else:
                parts[end] = inner if least == 1 else ("rep", inner, least, least)
    if len(parts) == 1 and parts[0] != node:
        return searchable(parts[0])
    return parts[0] if len(parts) == 1 else ("cat", tuple(parts))


def has_edges(node: tuple) -> bool:
    """Whether the pattern asks what stands beside a place, the ends of the text included."""
    if node[0] in ("cat", "alt"):
        return any(map(has_edges, node[1]))
    return node[0] == "edge" or (node[0] == "rep" and has_edges(node[1]))


def width(node: tuple) -> int:
    """Sets and edges that the pattern has when its bounded repetitions are written out."""
    if node[0] in ("cat", "alt"):
        return sum(map(width, node[1])) + len(node[1])
    return width(node[1]) * max(node[3] or node[2], 1) if node[0] == "rep" else 1


def unbounded(node: tuple) -> bool:
    if node[0] in ("cat", "alt"):
        return any(map(unbounded, node[1]))
    return node[0] == "rep" and (node[3] is None or unbounded(node[1]))


def _forks(node: tuple) -> bool:
    """Whether some part can match in several ways that a repetition would multiply."""
    if node[0] in ("cat", "alt"):
        return (node[0] == "alt" and len(node[1]) > 1) or any(map(_forks, node[1]))
    return node[0] == "rep"


def _multiplies(node: tuple) -> bool:
    if node[0] in ("cat", "alt"):
        return any(map(_multiplies, node[1]))
    return node[0] == "rep" and (_forks(node[1]) or _multiplies(node[1]))


def backtracks_little(node: tuple, most: int = 100) -> bool:
    """Whether a matcher that tries one way after the other needs a bounded number of steps
    from each place, and few levels of recursion."""
    optional = sum(1 for part in (node[1] if node[0] == "cat" else [node]) if part[0] == "rep" and part[2] != part[3])
    return not unbounded(node) and not _multiplies(node) and width(node) <= most and optional <= 4


# A condition is True, ("lit", text), ("and", conditions) or ("or", conditions).
MOST_TEXTS, MOST_CASES, LEAST_LITERAL = 16, 4, 2


def _either(texts: frozenset[str], least: int):
    if any(len(text) < least for text in texts):
        return True
    # a text within another says less, and is enough
    kept = sorted(t for t in texts if not any(o != t and o in t for o in texts))
    return ("lit", kept[0]) if len(kept) == 1 else ("or", tuple(("lit", t) for t in kept))


def _all(conditions: list):
    kept = list(dict.fromkeys(c for c in conditions if c is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _needs(node: tuple, fold, least: int):
    """``(texts, condition)``: the few texts that the node matches exactly, or None, and
    what every text with a match holds."""
    if node[0] == "edge":
        return frozenset([""]), True
    if node[0] == "set":
        if charsets.size(node[1]) > 4 * MOST_CASES:
            return None, True
        texts = frozenset(fold(chr(point)) for point in charsets.members(node[1]))
        return (texts, _either(texts, least)) if 0 < len(texts) <= MOST_CASES else (None, True)
    if node[0] == "alt":
        found = [_needs(part, fold, least) for part in node[1]]
        if all(texts is not None for texts, _ in found):
            texts = frozenset().union(*(texts for texts, _ in found))
            if len(texts) <= MOST_TEXTS:
                return texts, _either(texts, least)
        conditions = [condition if texts is None else _either(texts, least) for texts, condition in found]
        return None, True if any(c is True for c in conditions) else ("or", tuple(dict.fromkeys(conditions)))
    if node[0] == "rep":
        texts, condition = _needs(node[1], fold, least)
        if node[2] == 0:
            return (texts | {""}, True) if texts is not None and node[3] == 1 and len(texts) < MOST_TEXTS else (None, True)
        times = min(node[2], 8)
        if texts is None or len(texts) ** times > MOST_TEXTS:
            return None, condition if texts is None else _either(texts, least)
        texts = frozenset("".join(parts) for parts in product(texts, repeat=times))
        return (texts if node[2] == node[3] == times else None), _either(texts, least)
    current, conditions, exact = frozenset([""]), [], True
    for part in node[1]:
        texts, condition = _needs(part, fold, least)
        if texts is not None and len(current) * len(texts) <= MOST_TEXTS:
            current = frozenset(a + b for a in current for b in texts)
            continue
        conditions += [_either(current, least), condition]
        current, exact = texts if texts is not None else frozenset([""]), False
    return (current if exact else None), _all([*conditions, _either(current, least)])


def required(tree: tuple, fold=str, least: int = LEAST_LITERAL):
    """The condition that every text with a match fulfils, on its characters after ``fold``."""
    texts, condition = _needs(tree, fold, least)
    return condition if texts is None else _either(texts, least)
