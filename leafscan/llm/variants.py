"""Spelling variants of a vocabulary: words that differ by one inserted, deleted or replaced letter.

Every prefix of a word is a node of a trie, every suffix a node of the trie of the reversed
words; nodes get numbers. A word with a letter skipped, and the place between two letters of
a word, are both a pair of numbers: the prefix before and the suffix behind. Words whose
skipped letters leave the same pair differ by that letter; a skipped letter and a place
between letters that leave the same pair tell an inserted one. At most one word of each
letter skips to a pair, so a group has no more members than the alphabet has letters, and one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import attach, join_counted, map_columns, map_rows, null_free, stored
from leafscan.operators.pages import assign_ids

# Words of a vocabulary have so many letters and places.
MIN_LETTERS, MIN_COUNT = 5, 3
# A form has so many times the places of its variant.
DOMINANCE = 2
# One in so many runs of a text loses a letter.
TYPO_SHARE = 97
_RUN = re.compile("[a-zÀ-ÿ]+")
# Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def _lowered(text: str) -> str:
    """A-Z as a-z, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def typed(doc_id: int | None, run: str, share: int) -> str:
    """The run as the document spells it: of one in ``share`` runs a letter is missing."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % share:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, typo_share: int = TYPO_SHARE) -> DataFrame:
    """``(word, n)`` of the words of all texts ``(doc_id, text)`` with their places.

    A null text has no words; a null id counts as the empty text, repeated rows count again.
    """

    def run(rows):
        total: Counter = Counter()
        for doc_id, text in rows:
            for found, n in Counter(_RUN.findall(_lowered(text))).items():
                word = typed(doc_id, found, typo_share)
                if len(word) >= MIN_LETTERS:
                    total[word] += n
            if len(total) >= HELD_WORDS:
                yield from total.items()
                total.clear()
        yield from total.items()

    counted = map_rows(docs.select("doc_id", null_free()), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


NODE = "id long, n long, at int, reverse boolean, first boolean, node long, other long"


def trie_nodes(words: DataFrame) -> DataFrame:
    """For each word ``(id, word, n)`` and place ``at`` the names of the prefix that ends there
    and of the suffix that starts there. ``first``: the letter before is not the one behind.

    A node is named by 128 bits of the letters that lead to it, so that a long word gives
    rows in proportion to its length.
    """

    def names(word: str, side: bytes) -> bytes:
        digest = blake2b(person=side, digest_size=16)
        out = [digest.digest()]
        for letter in word:
            digest.update(letter.encode("utf-32-le", "surrogatepass"))
            out.append(digest.digest())
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for id_, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                size = len(word) + 1
                letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
                first = np.ones(size, bool)
                first[1:-1] = letters[1:] != letters[:-1]
                for side, at in ((False, np.arange(size)), (True, np.arange(size)[::-1])):
                    spelt = word[::-1] if side else word
                    pair = np.frombuffer(names(spelt, b"suffix" if side else b"prefix"), "<i8").reshape(size, 2)
                    yield (
                        np.full(size, id_),
                        np.full(size, n),
                        at.astype(np.int32),
                        np.full(size, side),
                        first[at],
                        pair[:, 0],
                        pair[:, 1],
                    )

    return map_columns(words.select("id", "word", "n"), run, NODE)


def _numbered(nodes: DataFrame) -> DataFrame:
    """The nodes that two words or more share, with a number each instead of a name."""
    counted = nodes.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n_words"))
    shared = counted.where("n_words > 1").withColumn("key", F.struct("node", "other"))
    numbers = stored(assign_ids(shared, 0, key="key", column="number").select("node", "other", "n_words", "number"))
    return join_counted(nodes, numbers, ["node", "other"], "n_words").drop("node", "other", "n_words")


def _pairs(numbered: DataFrame) -> DataFrame:
    """``(a, b, id, n, skips, first)``: each word's pairs of a prefix and a suffix node, with a
    letter skipped in between or not."""
    suffix = F.col("reverse")
    # a suffix stands behind the place it starts at, and behind the letter before it
    places = F.when(~suffix, F.array(F.struct("at", F.lit(0).alias("role")))).otherwise(
        F.array(F.struct("at", F.lit(1).alias("role")), F.struct((F.col("at") - 1).alias("at"), F.lit(2).alias("role")))
    )
    rows = numbered.select("id", "n", "number", "first", F.explode(places).alias("p"))

    def of(role: int, value: str) -> Column:
        return F.max(F.when(F.col("p.role") == role, F.col(value)))

    met = rows.groupBy("id", "n", F.col("p.at").alias("at")).agg(
        of(0, "number").alias("a"), of(0, "first").alias("first"), of(1, "number").alias("slot"), of(2, "number").alias("skip")
    )
    both = F.array(
        F.struct(F.col("slot").alias("b"), F.lit(False).alias("skips")),
        F.struct(F.col("skip").alias("b"), F.lit(True).alias("skips")),
    )
    exploded = met.where("a is not null").select("a", "id", "n", "first", F.explode(both).alias("e"))
    return exploded.where("e.b is not null").select("a", "e.b", "id", "n", "e.skips", "first")


def nearest(words: DataFrame) -> DataFrame:
    """``(id, n_near, best_n, best)`` of the words ``(id, word, n)`` that have near words.

    ``best`` is the near word of most places, of equal ones that of the least id. A letter
    that is doubled can be skipped in several places; only the first counts.
    """
    pairs = _pairs(_numbered(stored(trie_nodes(words))))
    groups = pairs.groupBy("a", "b").agg(F.collect_list(F.struct("n", "id", "skips", "first")).alias("members"))

    def near(x: Column, y: Column) -> Column:
        replaced = x["skips"] & y["skips"] & (x["id"] != y["id"])
        return replaced | (x["skips"] & x["first"] & ~y["skips"]) | (~x["skips"] & y["skips"] & y["first"])

    def summed(x: Column) -> Column:
        others = F.filter("members", lambda y: near(x, y))
        best = F.array_min(F.transform(others, lambda y: F.struct((-y["n"]).alias("n"), y["id"].alias("id"))))
        return F.struct(x["id"].alias("id"), F.size(others).alias("n_near"), best.alias("best"))

    found = groups.where(F.size("members") > 1).select(F.explode(F.transform("members", summed)).alias("f"))
    found = found.where("f.n_near > 0").groupBy("f.id").agg(
        F.sum("f.n_near").cast("long").alias("n_near"), F.min("f.best").alias("best")
    )
    return found.select("id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """``(id, form, root)`` of links ``(id, form)``: where the forms lead in the end.

    A form has DOMINANCE times the places of its word, so a chain is no longer than the
    logarithm of the largest count.
    """
    step = links.select(F.col("id").alias("root"), F.col("form").alias("next"))
    active, done = links.withColumn("root", F.col("form")), []
    while True:
        moved = stored(active.join(step, "root", "left"))
        done.append(moved.where("next is null").drop("next"))
        active = moved.where("next is not null").select("id", "form", F.col("next").alias("root"))
        if active.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def group_variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of a vocabulary ``(word, n)``.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form
    is its near word of most places (of equal ones the first in code-point order) if that has
    DOMINANCE times its own, else null; the root is where forms lead, or the word itself.
    Words are distinct and not null; an empty vocabulary gives no rows. A word of any length
    takes rows in proportion to it.
    """
    # numbers in the order of the words: the least id is the first word
    numbered = stored(assign_ids(words.select("word", "n"), 0, key="word"))
    near = stored(attach(numbered.select("id", "n"), stored(nearest(numbered)), ["id"]))
    links = near.where(F.col("best_n") >= DOMINANCE * F.col("n")).select("id", F.col("best").alias("form"))
    named = stored(_roots(stored(links)))
    spelt = numbered.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    named = attach(named, spelt, ["form"])
    named = attach(named, numbered.select(F.col("id").alias("root"), F.col("word").alias("root_word")), ["root"])
    rows = attach(numbered, near.select("id", "n_near"), ["id"])
    rows = attach(rows, stored(named.select("id", "form_word", "root_word", "form_n")), ["id"])
    return rows.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )
