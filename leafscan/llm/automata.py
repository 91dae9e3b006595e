"""Repeated word sequences found by suffix automata, and removed from every text.

The corpus is its own reference. A window of LENGTH words has its anchor where the least
hash of GRAM neighbouring words is, so equal windows meet under one gram. Stretches of words
around anchors, all windows of one anchor each, are compared whole by a digest first: those
that stand in several places repeat throughout. What is open then is cut into shards by gram.
A shard's task builds the suffix automaton of its distinct stretches, counts in how many
places each state's strings end, and streams the stretches through it: where the longest
match that occurs twice reaches LENGTH words, it is a span to remove.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import (
    BITS,
    attach,
    join_counted,
    map_columns,
    map_rows,
    null_free,
    stored,
    wanted_bits,
)
from leafscan.llm.shingles import CASED, mixed, word_hashes
from leafscan.llm.suffixes import raw_bytes, text_key
from leafscan.llm.windows import divide, winnow

LENGTH, GRAM = 35, 8
REACH = LENGTH - GRAM + 1
# Stretches of one automaton, and of one lead.
SHARD, CROWD = 4_000, 2_000
KEYS = ["node", "other"]
_seeded = np.random.default_rng(353)
_FACTORS = _seeded.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
# Odd factors, and what undoes them modulo 2^64.
_POWERS = [(factor, np.uint64(pow(int(factor), -1, 1 << 64))) for factor in _FACTORS[1:]]


class SuffixAutomaton:
    """Suffix automaton of several sequences of hashable symbols.

    ``step[s]`` maps a symbol to the next state, ``link[s]`` is the state of the longest
    suffix that ends in more places, ``length[s]`` the longest string of the state and
    ``twice[s]`` the longest suffix of it that ends in two places or more.
    """

    def __init__(self, sequences: Iterable[Sequence]) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extended(last, symbol)
                self.ends[last] += 1
        self._count()

    def _state(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(0)
        return len(self.step) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """The state of just the strings of ``target`` that extend ``state``."""
        copy = self._state(dict(self.step[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, symbol) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        new = self._state({}, 0, length[last] + 1)
        while last >= 0 and symbol not in step[last]:
            step[last][symbol] = new
            last = link[last]
        if last >= 0:
            target = step[last][symbol]
            link[new] = target if length[target] == length[last] + 1 else self._split(last, symbol, target)
        return new

    def _count(self) -> None:
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            self.ends[self.link[state]] += self.ends[state]
        self.twice = [0] * len(self.length)
        for state in order:
            self.twice[state] = self.length[state] if self.ends[state] > 1 else self.twice[self.link[state]]

    def repeats(self, sequence: Sequence, least: int) -> Iterator[tuple[int, int]]:
        """Matching statistics of a sequence: maximal spans ``(begin, end)`` of ``least``
        symbols or more that end in two places of the automaton's sequences."""
        state = matched = 0
        begin = end = -1
        for place, symbol in enumerate(sequence, 1):
            while state and symbol not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.step[state]:
                state, matched = self.step[state][symbol], matched + 1
            common = matched if self.ends[state] > 1 else self.twice[state]
            if common < least:
                continue
            if place - common != begin:  # the longest match starts further right
                if begin >= 0:
                    yield begin, end
                begin = place - common
            end = place
        if begin >= 0:
            yield begin, end


SURVEY = (
    "doc_id long, node long, other long, n_words long, sha256 string, grams array<long>, names array<long>, "
    "others array<long>, places array<int>, firsts array<int>, lasts array<int>"
)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(gram, place, first, last)`` of each anchor of a text's word hashes."""
    if len(hashes) < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * _FACTORS[0] + hashes[i : len(hashes) - GRAM + 1 + i]
    grams = mixed(grams)
    places, first, last = winnow(grams, REACH)
    return grams[places].view(np.int64), places, first, last


def stretch_names(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that together name the words of each stretch, from ``first`` to the end of
    the window at ``last``: sums of words times powers, all from the running sums of a text."""
    out, end = [], last + LENGTH
    for factor, inverse in _POWERS:
        up, down = (np.full(len(hashes) + 1, base, np.uint64) for base in (factor, inverse))
        up[0] = down[0] = 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.cumprod(up[:-1]))])
        named = (sums[end] - sums[first]) * np.cumprod(down)[first] + (end - first).astype(np.uint64)
        out.append(mixed(named).view(np.int64))
    return out[0], out[1]


def _survey(docs: DataFrame) -> DataFrame:
    """One row for each document: key and digest of its words, and its anchors."""

    def run(rows):
        for doc_id, text in rows:
            words = raw_bytes(text).split()
            joined = b" ".join(words)
            hashes = word_hashes(text, CASED) if len(words) >= LENGTH else np.zeros(0, np.uint64)
            grams, places, first, last = anchors(hashes)
            names = stretch_names(hashes, first, last)
            spans = (x.astype(np.int32) for x in (places, first, last))
            yield doc_id, *text_key(joined), len(words), sha256(joined).hexdigest(), grams, *names, *spans

    return stored(map_rows(docs.select("doc_id", null_free()), run, SURVEY))


ENTRY = "gram long, name long, other_name long, node long, other long, place int, first int, last int"


def _entries(surveyed: DataFrame) -> DataFrame:
    """The anchors whose grams stand elsewhere too, and few others."""
    often = surveyed.select(F.explode("grams").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    bits = surveyed.sparkSession.sparkContext.broadcast(wanted_bits(often.where("n > 1").select("node")))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            node, other, *lists = batch.columns
            sizes = np.diff(lists[0].offsets.to_numpy())
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            place = flat[0] % BITS
            chosen = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            keys = [np.repeat(x.to_numpy(), sizes)[chosen] for x in (node, other)]
            columns = [x[chosen] for x in flat]
            yield (*columns[:3], *keys, *columns[3:])

    lists = ["grams", "names", "others", "places", "firsts", "lasts"]
    return map_columns(surveyed.select(*KEYS, *lists), run, ENTRY)


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(node, other, words)`` of the given texts, their words joined, and few others."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(keys))

    def run(rows):
        seen: set[tuple] = set()
        for (text,) in rows:
            joined = b" ".join(raw_bytes(text).split())
            key = text_key(joined)
            place = key[0] % BITS
            if key in seen or not bits.value[place >> 3] >> (place & 7) & 1:
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(key)
            yield *key, joined

    return stored(map_rows(docs.select(null_free()), run, "node long, other long, words binary"))


STRETCH = "lead binary, left binary, right binary, node long, other long, place long"


def _stretches(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted stretches as word hashes on both sides of their anchors."""
    spans = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("place", "first", "last")).alias("spans"))
    met = texts.join(spans.hint("merge"), KEYS).sortWithinPartitions(*KEYS)

    def run(rows):
        done = None
        for node, other, words, spans in rows:
            if (node, other) == done:
                continue  # a text that several tasks have sent
            done = node, other
            raw = word_hashes(words.decode("utf-8", "surrogatepass"), CASED).tobytes()
            for span in spans:
                place, first, last = span["place"], span["first"], span["last"]
                left, right = raw[8 * first : 8 * place], raw[8 * place : 8 * (last + LENGTH)]
                yield right[: 8 * GRAM], left, right, node, other, place

    return stored(map_rows(met.select(*KEYS, "words", "spans"), run, STRETCH))


SPAN = "node long, other long, begin long, end long"


def _matched(stretches: DataFrame) -> DataFrame:
    """``(node, other, begin, end)``: spans of stretches that repeat, from the shards' automata."""
    n_shards = max(int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stretches.count() // SHARD))
    dealt = stretches.repartition(n_shards, "lead").sortWithinPartitions("lead")

    def spans(shard: list[tuple]) -> Iterator[tuple]:
        sequences = [np.frombuffer(left + right, np.int64).tolist() for _, left, right, *_ in shard]
        automaton = SuffixAutomaton(sequences)
        for (_, left, _, node, other, place), sequence in zip(shard, sequences):
            start = place - len(left) // 8
            for begin, end in automaton.repeats(sequence, LENGTH):
                yield node, other, start + begin, start + end

    def run(rows):
        shard: list[tuple] = []
        for row in rows:
            if len(shard) >= SHARD and row[0] != shard[-1][0]:
                yield from spans(shard)
                shard = []
            shard.append(row)
        yield from spans(shard)

    return map_rows(dealt, run, SPAN)


def _found(surveyed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of repeated words by text, and the texts that hold any."""
    entries, name = stored(_entries(surveyed)), ["gram", "name", "other_name"]
    one = F.min(F.struct(*KEYS, "place", "first", "last")).alias("one")
    stretches = stored(entries.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), one))
    whole = join_counted(entries, stored(stretches.where("n > 1").select(*name, "n")), name)
    whole = whole.select(*KEYS, F.col("first").cast("long").alias("begin"), (F.col("last") + LENGTH).cast("long").alias("end"))
    whole = stored(whole.distinct())
    # a gram of several stretches, one of which stands in one place only, leaves a question
    grams = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("n_gram"), F.min("n").alias("least"))
    grams = stored(grams.where("n_gram > 1 and least = 1").select("gram", "n_gram"))
    wanted = stored(join_counted(stretches.select("gram", "one.*"), grams, ["gram"], "n_gram").select(*KEYS, "place", "first", "last"))
    texts = _texts(docs, wanted.select("node").unionByName(whole.select("node")))
    dealt, found = divide(_stretches(texts, wanted), LENGTH, REACH, 8, CROWD)
    return whole.unionByName(found).unionByName(_matched(stored(dealt))), texts


REMOVED = "node long, other long, n_removed long, kept_sha256 string, kept binary"


def _removed(texts: DataFrame, found: DataFrame, keep: bool) -> DataFrame:
    """What is left of each text with repeated words, once for each text; its words if they are asked for."""
    spans = found.groupBy(*KEYS).agg(F.collect_list(F.array("begin", "end")).alias("spans"))
    met = texts.join(spans.hint("merge"), KEYS).sortWithinPartitions(*KEYS)

    def run(rows):
        done = None
        for node, other, joined, spans in rows:
            if (node, other) == done:
                continue
            done, words = (node, other), joined.split(b" ")
            kept, reached = [], 0
            for begin, end in sorted(spans):
                kept += words[reached : max(begin, reached)]
                reached = max(reached, end)
            kept += words[reached:]
            left = b" ".join(kept)
            yield node, other, len(words) - len(kept), sha256(left).hexdigest(), left if keep else None

    return map_rows(met.select(*KEYS, "words", "spans"), run, REMOVED)


def _resolved(docs: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """All documents, and what is left of the texts that are cut: wholly where others have
    the same words, else by their repeated windows."""
    surveyed = _survey(docs.select("doc_id", "text"))
    copies = surveyed.groupBy(*KEYS, "n_words").agg(F.count(F.lit(1)).alias("n"))
    copies = stored(copies.where((F.col("n") > 1) & (F.col("n_words") >= LENGTH)).select(*KEYS, "n_words"))
    spans, texts = _found(surveyed, docs)
    own = attach(spans, copies.select(*KEYS, F.lit(True).alias("copied")), KEYS).where("copied is null").drop("copied")
    nothing = F.lit(b"")
    gone = copies.withColumn("kept_sha256", F.sha2(nothing, 256)).withColumn("kept", nothing)
    cut = stored(_removed(texts, own, keep).unionByName(gone.withColumnRenamed("n_words", "n_removed")))
    return surveyed.select("doc_id", *KEYS, "n_words", "sha256"), cut


def cut_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``(doc_id, text)``.

    A word is removed if a window of LENGTH words that covers it starts anywhere else too, in
    this or another document; windows are judged on the texts as they come. ``kept`` holds the
    words that are left, joined by a space, of the texts that are cut, as UTF-8; it is null
    for the others, whose words all stay. Texts of equal words are one text in several places,
    so nothing is left of them if they have LENGTH words; repeated rows and null ids count as
    documents of their own. A null text, or one without words, has no words.
    """
    members, cut = _resolved(docs, True)
    joined = members.join(cut.hint("merge"), KEYS, "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``: ``cut_texts`` with a digest of what is left of every text."""
    members, cut = _resolved(docs, False)
    joined = attach(members, cut.drop("kept"), KEYS)
    digest = F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), digest)
