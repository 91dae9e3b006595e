"""Quality by naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import map_rows, null_free
from leafscan.llm.labelled import held_out, sample

# Labelled rows that the model is fitted on; an n-gram counts from so many of them.
SAMPLE_ROWS = 6_000
LEAST_ROWS = 3
EPOCHS, COST = 12, 1.0
THRESHOLD = 0.3

_word = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """Outline of a word: runs of capitals X, small letters x, digits 0; other signs stay, once."""
    letters = "X" if word.isupper() else "x" if word[:1].islower() else "Xx"
    rest = re.sub(r"[\w]+", "", word)
    digits = "0" if any(map(str.isdigit, word)) else ""
    return letters + digits + "".join(sorted(set(rest)))


def ngrams(text: str) -> set:
    """Indicators of one text: single words, pairs of words, and pairs of their outlines."""
    words = _word.findall(text)
    outlines = {word: shape(word) for word in set(words)}
    found = set(outlines)
    found.update(f"{a} {b}" for a, b in set(zip(words, words[1:])))
    pairs = {(outlines[a], outlines[b], a == b) for a, b in set(zip(words, words[1:]))}
    found.update(f"~{a} {b}{' =' if same else ''}" for a, b, same in pairs)
    return found


def log_ratios(train: DataFrame) -> dict[str, float]:
    """Log-count ratio of each n-gram between good and bad documents of the sample."""

    def run(rows):
        for label, text in rows:
            for gram in ngrams(text):
                yield gram, label

    grams = map_rows(train.select("label", "text"), run, "gram string, label int")
    counts = grams.groupBy("gram").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= LEAST_ROWS).collect()
    good = sum(row["good"] + 1 for row in rows)
    bad = sum(row["n"] - row["good"] + 1 for row in rows)
    return {
        row["gram"]: math.log((row["good"] + 1) / good) - math.log((row["n"] - row["good"] + 1) / bad) for row in rows
    }


def _vector(grams: set, index: dict[str, int], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(sorted(i for i in map(index.get, grams) if i is not None), np.int64)
    values = ratios[at]
    norm = math.sqrt(float(values @ values))
    return at, values / norm if norm else values


def descend(vectors: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model, by dual coordinate descent.

    One dual variable at a time is moved to its best value within [0, cost]; the cost of a
    class makes up for its share of rows.
    """
    weights, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(signs))
    share = {sign: max(float((signs == sign).mean()), 1e-9) for sign in (-1.0, 1.0)}
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(signs)):
            at, values = vectors[i]
            gradient = signs[i] * (float(weights[at] @ values) + bias) - 1
            square = float(values @ values) + 1
            new = min(max(alpha[i] - gradient / square, 0.0), COST * 0.5 / share[signs[i]])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[at] += step * values
                bias += step
                alpha[i] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to the chance of label 1."""
    a, b = 1.0, 0.0
    goal = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        slack = np.maximum(chance * (1 - chance), 1e-6)
        gradient = np.array([((chance - goal) * margins).sum() + 1e-3 * (a - 1), (chance - goal).sum()])
        curve = np.array([[(slack * margins**2).sum() + 1e-3, (slack * margins).sum()], [0, slack.sum() + 1e-6]])
        curve[1, 0] = curve[0, 1]
        step = np.linalg.solve(curve, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``(doc_id, text)``.

    Learned from at most ``rows`` labelled rows outside the held-out fold: four fifths for
    the model, the rest for the curve from margins to scores. The n-grams are counted in
    Spark, and what is fitted on them is no larger than the sample. A text without a known
    n-gram, empty or null, gets the score of the bias; without labels of both kinds every
    score is 1.
    """
    train = sample(docs, labels, "quality", rows)
    fitting = F.col("fold") % 8 != 7
    ratios = log_ratios(train.where(fitting))
    index = {gram: i for i, gram in enumerate(sorted(ratios))}
    scale = np.array([ratios[gram] for gram in sorted(ratios)])

    def vectors(batch):
        for part, label, text in batch:
            at, values = _vector(ngrams(text), index, scale)
            yield part, label, at, values

    held = map_rows(
        train.select(fitting.alias("fits"), "label", "text"), vectors, "fits boolean, label int, at array<long>, v array<double>"
    ).collect()
    held.sort(key=lambda row: (row["label"], row["at"]))
    own, tune = ([row for row in held if row["fits"] == fits] for fits in (True, False))
    if len({row["label"] for row in own}) < 2 or len({row["label"] for row in tune}) < 2:
        plain = docs.select("doc_id", held_out().alias("held_out"))
        return plain.select("*", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    pick = lambda part: [(np.array(r["at"], np.int64), np.array(r["v"])) for r in part]
    weights, bias = descend(pick(own), np.array([2.0 * r["label"] - 1 for r in own]), len(scale))
    margins = np.array([float(weights[at] @ v) + bias for at, v in pick(tune)])
    slope, offset = calibrate(margins, np.array([r["label"] for r in tune]))
    model = docs.sparkSession.sparkContext.broadcast((index, scale, weights))

    def run(batch):
        index, scale, weights = model.value
        for doc_id, text in batch:
            at, values = _vector(ngrams(text), index, scale)
            margin = float(weights[at] @ values) + bias
            yield doc_id, 1 / (1 + math.exp(-min(max(slope * margin + offset, -500), 500)))

    scored = map_rows(docs.select("doc_id", null_free()), run, "doc_id long, score double")
    rows = scored.select("doc_id", held_out().alias("held_out"), "score")
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
