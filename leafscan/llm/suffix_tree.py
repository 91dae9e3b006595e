"""Language-model scores by a probabilistic suffix tree over the bytes of the tokens.

Symbols are the bytes of a text's words in small letters, one space between words, and an end,
so the probability of the symbols is that of the tokens. A context of up to DEPTH symbols is a
state of the tree if it is frequent and its next symbols differ enough from those of its
suffix; the longest suffix that is a state predicts the next symbol.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import crc_mod, map_columns, map_rows, null_free, stored

DEPTH = 6
END = 256  # also stands before the first symbol
BITS = 9
# A context needs this share of all symbols, a next symbol after a context this one; so there
# are at most DEPTH / CONTEXT states, however large the corpus is.
CONTEXT, PAIR = 2e-5, 5e-7
# Least divergence of a context's next symbols from those of its suffix, in nats.
DIVERGENCE = 0.002
# A word with this share of all tokens is frequent: there are at most 1 / FREQUENT of them.
FREQUENT = 2e-6
# Share of the tree in a word's probability.
TREE = 0.3
# Symbols that a task counts at once; symbols of a text that are scored in one row.
CHUNK, SEGMENT = 1 << 22, 512
HELD_OUT = (7, 2)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out():
    return crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]


def _count_grams(batches):
    """Counts of all stretches of DEPTH + 1 symbols, merged within the task."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0
    pad = np.full(DEPTH, END, np.int64)

    def merge():
        nonlocal grams, counts
        symbols = np.concatenate([x for text in held for x in (pad, text)])
        codes = np.zeros(len(symbols) - DEPTH, np.int64)
        for i in range(DEPTH + 1):
            codes = codes << BITS | symbols[i : len(codes) + i]
        starts = np.cumsum([len(text) + DEPTH for text in held])[:-1]
        real = np.ones(len(codes), bool)
        for i in range(DEPTH):
            real[starts - DEPTH + i] = False
        new, n = np.unique(codes[real], return_counts=True)
        grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(grams)).astype(np.int64)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            raw = b" ".join(words_of(text))
            held.append(np.append(np.frombuffer(raw, np.uint8).astype(np.int64), END))
            size += len(raw) + 1
            if size >= CHUNK:
                merge()
                held, size = [], 0
                if len(grams) >= CHUNK:
                    yield grams, counts
                    grams, counts = grams[:0], counts[:0]
    if held:
        merge()
    if len(grams):
        yield grams, counts


class Tree:
    """The states with their transitions and the logarithms of the next symbols' probabilities."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], totals: list[dict[int, int]]):
        """``levels[k]``: contexts of k symbols, next symbols and counts; ``totals[k]``: all
        occurrences of a context, with next symbols that are too rare to be listed."""
        _, symbols, counts = levels[0]
        self.classes = np.full(END + 1, len(symbols), np.int64)
        self.classes[symbols] = np.arange(len(symbols))
        self.size = len(symbols) + 1  # the last stands for all rare symbols
        n_rare = END + 1 - len(symbols)
        total = totals[0].get(0, 0)
        root = np.append(counts.astype(float), total - counts.sum()) + np.append(np.ones(len(symbols)), max(n_rare, 1))
        rows = {(0, 0): root / root.sum()}
        self.rare = np.log10(1 / max(n_rare, 1))
        kept = [(0, 0)]
        for k in range(1, len(levels)):
            contexts, symbols, counts = levels[k]
            by = np.lexsort((symbols, contexts))
            contexts, symbols, counts = contexts[by], symbols[by], counts[by]
            edges = np.flatnonzero(np.diff(contexts, prepend=-1))
            for low, high in zip(edges, np.append(edges[1:], len(contexts))):
                context = int(contexts[low])
                parent = self._row(rows, k - 1, context)
                own = np.zeros(self.size)
                np.add.at(own, self.classes[symbols[low:high]], counts[low:high])
                slack = totals[k][context] - own.sum() + (high - low)
                mixed = (own + slack * parent) / (own.sum() + slack)
                if float((mixed * np.log(mixed / parent)).sum()) >= DIVERGENCE:
                    rows[k, context] = mixed
                    kept.append((k, context))
        # with every prefix of a state, the state after a symbol follows from the state before
        states = set(kept)
        for k, context in kept:
            while k:
                k, context = k - 1, context >> BITS
                states.add((k, context))
        order = sorted(states)
        place = {state: i for i, state in enumerate(order)}
        self.logs = np.log10(np.stack([rows.get(s) if s in rows else self._row(rows, *s) for s in order])).astype(np.float32)
        self.steps = np.zeros((len(order), self.size), np.int32)
        listed = np.flatnonzero(self.classes < self.size - 1)
        for (k, context), i in place.items():
            for symbol in listed.tolist():
                code, depth = context << BITS | symbol, min(k + 1, DEPTH)
                while (depth, code & ((1 << BITS * depth) - 1)) not in place:
                    depth -= 1
                self.steps[i, self.classes[symbol]] = place[depth, code & ((1 << BITS * depth) - 1)]

    @staticmethod
    def _row(rows: dict, k: int, context: int) -> np.ndarray:
        while (k, context & ((1 << BITS * k) - 1)) not in rows:
            k -= 1
        return rows[k, context & ((1 << BITS * k) - 1)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Logarithms, to base 10, of the probabilities of the texts' symbols and their ends."""
        values, begins = self.symbol_scores(texts)
        return np.add.reduceat(values, begins) if len(begins) else np.zeros(0)

    def symbol_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for each symbol of all texts, with their ends, and where each text begins.

        Texts are cut in rows that move through the tree side by side; each row first reads
        the DEPTH symbols before it, which is as far as a state looks back.
        """
        symbols = [np.concatenate([np.full(DEPTH, END), np.frombuffer(x, np.uint8), [END]]) for x in texts]
        flat = self.classes[np.concatenate(symbols)]
        sizes = np.array([len(x) for x in symbols])
        begins = np.cumsum(sizes) - sizes
        starts, owner = [], []
        for i, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist())):
            cuts = range(begin, begin + size - DEPTH, SEGMENT)
            starts += cuts
            owner += [i] * len(cuts)
        starts, owner = np.array(starts, np.int64), np.array(owner, np.int64)
        lengths = np.minimum(starts + SEGMENT + DEPTH, (begins + sizes)[owner]) - starts
        by = np.argsort(-lengths, kind="stable")
        starts, owner, lengths = starts[by], owner[by], lengths[by]
        state, values = np.zeros(len(starts), np.int64), np.zeros(int(sizes.sum()))
        logs, steps = self.logs.ravel(), self.steps.ravel()
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, "left"))
            symbol = flat[starts[:n] + t]
            at = state[:n] * self.size + symbol
            if t >= DEPTH:
                values[starts[:n] + t] = logs[at] + np.where(symbol == self.size - 1, self.rare, 0.0)
            state[:n] = steps[at]
        # without the symbols that stand before each text
        real = np.arange(len(values)) >= np.repeat(begins + DEPTH, sizes)
        return values[real], begins - DEPTH * np.arange(len(texts))


def learn(docs: DataFrame) -> Tree:
    """The tree of all texts given, of ``(text)``.

    Stretches of symbols are counted in Spark over all texts; only contexts and pairs over
    their shares, and so a bounded number, reach the driver.
    """
    partial = map_columns(docs.select(null_free()), _count_grams, "gram long, n long")
    grams = stored(partial.groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels, totals = [], []
    for k in range(DEPTH + 1):
        symbol = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
        context = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << BITS * k) - 1))
        pairs = grams.groupBy(context.alias("context"), symbol.alias("symbol")).agg(F.sum("n").alias("n"))
        sums = F.sum("n").alias("total")
        often = pairs.groupBy("context").agg(sums).where(F.col("total") >= CONTEXT * total)
        found = pairs.where(F.col("n") >= PAIR * total).join(often, "context").orderBy("context", "symbol").collect()
        columns = [np.array([row[c] for row in found], np.int64) for c in ("context", "symbol", "n")]
        levels.append(tuple(columns))
        totals.append({row["context"]: row["total"] for row in found})
    return Tree(levels, totals)


def _word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts given."""

    def run(rows):
        counts: Counter = Counter()
        for (text,) in rows:
            counts.update(words_of(text))
            if len(counts) >= 500_000:
                yield from counts.items()
                counts = Counter()
        yield from counts.items()

    partial = map_rows(docs.select(null_free()), run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


PART = (
    "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "words array<binary>, tree array<double>"
)


def word_scores(tree: Tree, tokens: list[list[bytes]]) -> list[np.ndarray]:
    """For each text the logarithms of its words' probabilities, each with what ends it: the
    space behind it, or the end of the text behind the last. An empty text is one end."""
    texts = [b" ".join(words) for words in tokens]
    values, begins = tree.symbol_scores(texts)
    out = []
    for words, begin in zip(tokens, begins.tolist()):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = begin + np.cumsum(sizes) - sizes if len(words) else np.array([begin])
        out.append(starts)
    if not out:
        return []
    sums = np.add.reduceat(values, np.concatenate(out))
    return np.split(sums, np.cumsum([len(starts) for starts in out])[:-1])


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row
    of ``(doc_id, text)``.

    A word's probability is smoothed with its share of all tokens: TREE parts are what the
    tree gives its bytes and what ends it, the rest its share. So the model knows frequent
    words whole, and spells the others by their contexts. The tree and the word counts come
    from all rows that are not held out. Frequent words, of a bounded number, are looked up
    where a text is read; the others go to their counts, and what they add comes back by the
    row. A null text counts as empty and is one end; repeated rows are rows of their own.
    Without training rows all words are unknown and the tree alone counts.
    """
    train = docs.where(~held_out())
    words = stored(_word_counts(train))
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = train.count()
    total, kinds = n_words + ends, distinct + (1 if ends else 0)
    frequent = dict(words.where(F.col("c") >= FREQUENT * total).collect() if total else [])
    frequent = {bytes(word): c for word, c in frequent.items()}
    spread = float(np.log10(total + kinds + 1))
    end = (ends + 1) / (total + kinds + 1)
    part_of_tree = TREE if ends else 1.0
    # what the base adds to the first word, which is no end, and to the last, which an end follows
    first, last = (math.log10(1 - end), math.log10(end / (1 - end))) if ends else (0.0, 0.0)
    model = docs.sparkSession.sparkContext.broadcast((learn(train), frequent))

    def run(rows):
        tree, often = model.value
        part = TaskContext.get().partitionId() << 33
        held, size, key = [], 0, part

        def finish():
            nonlocal key
            tokens = [words_of(text) for *_, text in held]
            for (doc_id, out, _), words, logs in zip(held, tokens, word_scores(tree, tokens)):
                counts = np.fromiter((often.get(word, -1) for word in words), np.int64, len(words))
                seen = counts >= 0
                base = np.log10(np.where(seen, counts, 0) + 1) - spread
                known = int(counts[seen].astype(bool).sum()) + (1 if ends else 0)
                # shares of the first and the last word, which those of rare words get below
                shift = np.zeros(len(words))
                if len(words):
                    shift[0] += first
                    shift[-1] += last
                else:
                    base, shift, logs = np.zeros(1), np.array([math.log10(end)]), logs
                    seen = np.ones(1, bool)
                mixed = part_of_tree * 10 ** (logs[seen] - shift[seen]) + (1 - part_of_tree) * 10 ** base[seen]
                value = float(np.log10(np.maximum(mixed, 1e-300)).sum() + shift.sum())
                whole = float(base[seen].sum() if len(words) else 0.0) + math.log10(end)
                rare = [words[i] for i in np.flatnonzero(~seen)] if len(words) else []
                yield key, doc_id, out, len(words) + 1, known, whole, value, rare, (logs - shift)[~seen]
                key += 1

        for row in rows:
            held.append(row)
            size += len(row[2])
            if size >= 1 << 21:
                yield from finish()
                held, size = [], 0
        if held:
            yield from finish()

    parts = stored(map_rows(docs.select("doc_id", held_out().alias("held_out"), null_free()), run, PART))
    zipped = F.explode(F.arrays_zip("words", "tree")).alias("x")
    rare = parts.select("key", zipped).select("key", F.col("x.words").alias("word"), F.col("x.tree").alias("tree"))
    rare = rare.join(words, "word", "left")
    value = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.lit(spread)
    mixed = F.log10(F.greatest(part_of_tree * F.pow(F.lit(10.0), "tree") + (1 - part_of_tree) * F.pow(F.lit(10.0), value), F.lit(1e-300)))
    added = rare.groupBy("key").agg(
        F.count("c").alias("more"), F.sum(value).alias("value"), F.sum(mixed).alias("mixed")
    )
    whole = parts.drop("words", "tree").join(added, "key", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
