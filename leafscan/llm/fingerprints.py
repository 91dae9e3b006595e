"""Fingerprints of texts as sums of vectors that are hashed from their paragraphs."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterable
from hashlib import blake2b, sha256

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import map_rows, null_free, stored

# Lanes of 64 bits that whole paragraphs are summed into, modulo 2**64: for equality.
WIDE = 8
# Lanes of 16 bits that the paragraphs' pieces add +1 or -1 to, modulo 2**16: for likeness.
SIGNS = 128
# Longest piece of a paragraph, in characters; pieces also end with a sentence.
PIECE = 32

_piece = re.compile(rf"[^\n.!?]{{1,{PIECE}}}[.!?]*")


def paragraphs(text: str) -> list[str]:
    """Lines without the white space around them; empty ones do not count."""
    return [line for line in map(str.strip, text.split("\n")) if line]


class Fingerprint:
    """A sum of hashed paragraphs. Adding and removing paragraphs commute, in any order."""

    def __init__(self, wide: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.signs = np.zeros(SIGNS, np.uint16) if signs is None else signs

    def plus(self, lines: Iterable[str], times: int = 1) -> Fingerprint:
        """With paragraphs added, or for ``times=-1`` removed."""
        lines = list(lines)
        if not lines:
            return self
        digests = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8 * WIDE).digest() for x in lines)
        wide = np.frombuffer(digests, "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
        pieces = [p.strip() for x in lines for p in _piece.findall(x)]
        size = SIGNS // 8
        digests = b"".join(blake2b(p.encode("utf-8", "surrogatepass"), digest_size=size).digest() for p in pieces)
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, size), axis=1)
        signs = (2 * bits.sum(axis=0, dtype=np.int64) - len(pieces)) * times
        wide = wide if times == 1 else np.uint64(0) - wide
        return Fingerprint(self.wide + wide, self.signs + signs.astype(np.uint16))

    def joined(self, other: Fingerprint) -> Fingerprint:
        """Of both texts' paragraphs together."""
        return Fingerprint(self.wide + other.wide, self.signs + other.signs)

    def edited(self, old: list[str], new: list[str]) -> Fingerprint:
        """After its paragraphs ``old`` became ``new``: only those that differ are hashed."""
        before, after = Counter(old), Counter(new)
        return self.plus((after - before).elements()).plus((before - after).elements(), -1)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal sums, about 0 for texts without a common piece.

        Squared lengths of sums of signs estimate numbers of pieces, so this is about the
        share of common pieces in the mean size of both.
        """
        if np.array_equal(self.wide, other.wide) and np.array_equal(self.signs, other.signs):
            return 1.0
        a, b = (x.signs.astype(np.int16).astype(np.float64) for x in (self, other))
        apart = (self.signs - other.signs).astype(np.int16).astype(np.float64)
        total = float(a @ a + b @ b)
        return min(max(1 - float(apart @ apart) / total, 0.0), 1.0) if total else 0.0

    def __str__(self) -> str:
        raw = self.wide.astype("<u8").tobytes() + self.signs.astype("<u2").tobytes()
        return base64.b64encode(raw).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 8 * WIDE], "<u8").copy(), np.frombuffer(raw[8 * WIDE :], "<u2").copy())


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row of ``(doc_id, text)``; a null text counts as empty.

    Texts with the same paragraphs, in any order, have equal fingerprints.
    """

    def run(rows):
        for doc_id, text in rows:
            yield doc_id, str(Fingerprint().plus(paragraphs(text)))

    return map_rows(docs.select("doc_id", null_free()), run, "doc_id long, fingerprint string")


def merged(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint of all texts of a group together, from those of its members.

    Each task sums what it reads, so a large group leaves it as one row; the sums of the
    tasks are added lane by lane in Spark.
    """
    lanes = 4 * WIDE + SIGNS
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fingerprints.select(*keys).schema]

    def partial(rows):
        sums: dict[tuple, Fingerprint] = {}
        for *key, text in rows:
            key = tuple(key)
            sums[key] = sums.get(key, Fingerprint()).joined(Fingerprint.parse(text))
            if len(sums) >= 10_000:
                yield from ((*k, str(v)) for k, v in sums.items())
                sums = {}
        yield from ((*k, str(v)) for k, v in sums.items())

    def combined(rows):
        current, total = None, Fingerprint()
        for *key, text in rows:
            if current is not None and key != current:
                yield *current, str(total)
                total = Fingerprint()
            current, total = key, total.joined(Fingerprint.parse(text))
        if current is not None:
            yield *current, str(total)

    assert lanes % 4 == 0
    schema = ", ".join([*kinds, "fingerprint string"])
    sums = map_rows(fingerprints.select(*keys, "fingerprint"), partial, schema)
    return map_rows(sums.repartition(*keys).sortWithinPartitions(*keys), combined, schema)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
EDGES = "_part int, _end int, _text string"


def _pair(doc_id: int | None, text: str, own: Fingerprint, next_text: str, following: Fingerprint) -> tuple:
    """The result row of a document and the text after it."""
    third = len(text) // 3
    edited = text[: len(text) - third] + next_text[:third]
    changed = own.edited(paragraphs(text), paragraphs(edited))
    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = own.likeness(changed), own.likeness(following)
    return doc_id, len(text), digest, str(own), str(changed), *near


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document.

    Documents stand in descending order of ``doc_id`` (nulls last, equal ids by a hash of
    the text); the first one follows the last. The last third of a text is replaced by as
    many characters of the next one, and the fingerprint of the result is reached by
    removing the lost paragraphs and adding the new ones. A null text counts as empty.

    Texts are sorted by range, once, and paired within each partition. A partition's first
    and last text are stored; its last document meets the first of the next partition by a
    join on the partition's number.
    """
    keyed = docs.select("doc_id", null_free().alias("text"))
    placed = keyed.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def run(rows):
        part = TaskContext.get().partitionId()
        last = None
        for doc_id, text in rows:
            own = Fingerprint().plus(paragraphs(text))
            if last is None:
                yield *[None] * 7, part, 0, text
            else:
                yield *_pair(*last, text, own), None, None, None
            last = doc_id, text, own
        if last is not None:
            yield last[0], *[None] * 6, part, 1, last[1]

    paired = stored(map_rows(placed, run, f"{RESULT}, {EDGES}"))
    # one row for each partition from here on
    firsts = paired.where("_end = 0").select(F.col("_part").alias("_next"), F.col("_text").alias("_next_text"))
    order = Window.orderBy("_next")
    numbers = firsts.select(
        F.coalesce(F.lag("_next").over(order), F.max("_next").over(order.rowsBetween(*WHOLE))).alias("_part"), "_next"
    )
    edges = paired.where("_end = 1").select("_part", "doc_id", "_text").join(numbers, "_part").join(firsts, "_next")

    def close(rows):
        for doc_id, text, next_text in rows:
            own, following = (Fingerprint().plus(paragraphs(x)) for x in (text, next_text))
            yield _pair(doc_id, text, own, next_text, following)

    closed = map_rows(edges.select("doc_id", "_text", "_next_text"), close, RESULT)
    names = [field.split()[0] for field in RESULT.split(", ")]
    return paired.where("_end is null").select(*names).unionByName(closed)


WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
