"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from itertools import repeat

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import map_rows, null_free, stored
from leafscan.llm.labelled import FOLDS, held_out, sample

# Labelled rows that the lexicon, the trees and the calibration are fitted on together.
SAMPLE_ROWS = 20_000
# Entries of the lexicon of words, and of that of beginnings of words.
LEXICON = 2_000
START = 5
# Words around one of the second person that count as near it.
NEAR = 5
# Words of the second person in the languages of the corpus.
SECOND = frozenset("you your yours u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tus usted ti".split())
FEATURES = (
    "words density starts hits strongest near_second second capitals upper_words "
    "exclaims punctuation digits obfuscated stretched"
).split()

_word = re.compile(r"[^\x20\x09-\x0D]+")
_other_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_stretched = re.compile(r"(.)\1\1")
_signs = re.compile(r"[0-9@$*!#+]+")
_edges = ".,;:!?\"'()[]"


def spelt(text: str) -> list[str]:
    """Words in small letters, without punctuation around them."""
    return [word.strip(_edges).lower() for word in _word.findall(text)]


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Words, and beginnings ``word-``, that toxic documents have far more often, with log odds.

    Counts are taken over the labelled rows given; LEXICON of each kind at most.
    """

    def run(batch):
        for label, text in batch:
            words = set(spelt(text)) - {""}
            starts = {f"{word[:START]}-" for word in words if len(word) > START}
            for item in words | starts:
                yield item, label

    items = map_rows(rows.select("label", "text"), run, "item string, label int")
    counts = items.groupBy("item").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    strong = counts.withColumn("odds", odds).where("bad >= 3 and odds >= 1.5")
    found = {}
    for kind in (F.col("item").endswith("-"), ~F.col("item").endswith("-")):
        best = strong.where(kind).orderBy(F.desc(F.col("odds") * F.log1p("bad")), "item").limit(LEXICON)
        found |= {item: value for item, value in best.select("item", "odds").collect()}
    return found


def words_of(text: str) -> list[str]:
    """Words as the pattern finds them; a plain split where no other white space is about."""
    return _word.findall(text) if _other_space.search(text) else text.split()


def obfuscated(text: str) -> int:
    """Places where digits or signs stand between two letters; a letter counts for one of them."""
    n, end = 0, 0
    for run in _signs.finditer(text):
        i, j = run.span()
        if i > end and j < len(text) and _letter(text[i - 1]) and _letter(text[j]):
            n, end = n + 1, j + 1
    return n


def _letter(char: str) -> bool:
    return char.isalnum() and not char.isdecimal()


def features(text: str, entries: dict[str, float], starts: dict[str, float]) -> tuple[float, ...]:
    """Densities and rates of one text, in the order of FEATURES; ``starts`` has beginnings of words."""
    words = list(map(str.strip, words_of(text.lower()), repeat(_edges)))
    n, size = max(len(words), 1), max(len(text), 1)
    strength = list(map(entries.get, words))
    hits = [i for i, value in enumerate(strength) if value]
    begun = [value for value in [starts.get(word[:START]) for word in words if len(word) > START] if value]
    second = [i for i, word in enumerate(words) if word in SECOND]
    spots = set(second)
    near = sum(any(i + d in spots for d in range(-NEAR, NEAR + 1)) for i in hits) if spots else 0
    large = [char for char in set(text) if char.isupper()]
    shouted = [word for word in words_of(text) if len(word) > 1 and word.isupper()] if large else []
    return (
        math.log1p(len(words)),
        len(hits) / n,
        len(begun) / n,
        math.log1p(len(hits)),
        max([*(strength[i] for i in hits), *begun], default=0.0),
        near / n,
        len(second) / n,
        sum(map(text.count, large)) / size,
        len(shouted) / n,
        (text.count("!") + text.count("?")) / size,
        sum(map(text.count, ".,;:'\"-")) / size,
        sum(map(text.count, "0123456789")) / size,
        obfuscated(text) / n,
        len(_stretched.findall(text)) / n,
    )


def featured(rows: DataFrame, columns: tuple[str, ...], entries: dict[str, float]) -> DataFrame:
    """The given columns and the assembled features of each text."""
    picked = rows.select(*columns, null_free().alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in picked.drop("_text").schema]

    def run(batch):
        starts = {item[:-1]: value for item, value in entries.items() if item.endswith("-")}
        for row in batch:
            yield *row[:-1], *features(row[-1], entries, starts)

    table = map_rows(picked, run, ", ".join([*kinds, *(f"{name} double" for name in FEATURES)]))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``(doc_id, text)``.

    Learned from at most ``rows`` labelled rows outside the held-out fold: the lexicon from
    two fifths of them, the trees from another part, and the calibration, which turns the
    trees' probability into the share of toxic documents, from the rest. An empty or null
    text has features of its own and so a score; without labels of both kinds in each part
    every score is 0.
    """
    train = sample(docs, labels, "toxic", rows)
    part = F.col("fold") % FOLDS
    calibrating = F.col("fold") / FOLDS >= 6
    parts = train.groupBy(F.when(part <= 2, 0).when(calibrating, 2).otherwise(1).alias("part")).agg(
        F.count_distinct("label").alias("kinds")
    )
    if parts.where("kinds = 2").count() < 3:
        plain = docs.select("doc_id", held_out().alias("held_out"))
        return plain.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    entries = lexicon(train.where(part <= 2))
    rest = stored(featured(train.where(part > 2), ("fold", "label"), entries))
    weight = F.col("label").cast("double")
    rest = rest.withColumn("y", weight)
    trees = GBTClassifier(labelCol="y", maxIter=15, maxDepth=4, seed=7)
    model = trees.fit(rest.where(~calibrating))
    chance = vector_to_array("probability")[1].alias("chance")
    tuned = model.transform(rest.where(calibrating)).select("y", chance)
    isotonic = IsotonicRegression(featuresCol="chance", labelCol="y", predictionCol="fitted").fit(tuned)
    scored = model.transform(featured(docs, ("doc_id",), entries)).select("doc_id", chance)
    fitted = isotonic.transform(scored)
    # the steps of the calibration stay in order of the trees' own probability within a step
    value = F.least(F.greatest(0.98 * F.col("fitted") + 0.02 * F.col("chance"), F.lit(0.0)), F.lit(1.0))
    rows = fitted.select("doc_id", held_out().alias("held_out"), value.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
