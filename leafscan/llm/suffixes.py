"""Repeated passages found by sorting suffixes, and removed from every text that holds them.

A passage of LENGTH bytes that stands in two places holds the same anchor in both: the start
of the window of GRAM bytes whose hash is least within it. Only suffixes that begin at such
anchors are sorted, so one in seventy of all, and of those only the ones whose first GRAM
bytes stand at another anchor too. Sampled splitters deal the suffixes out by their leading
bytes; a bucket is sorted by multikey quicksort, what follows the anchors from left to right
and what precedes them from right to left, and neighbours' common prefixes tell which of the
LENGTH-byte strings around an anchor occur twice.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import BITS, DOCUMENT, attach, join_counted, map_rows, null_free, stored, wanted_bits
from leafscan.llm.windows import divide

LENGTH, GRAM = 200, 64
# Positions at which a window of LENGTH bytes can hold its anchor.
REACH = LENGTH - GRAM + 1
# Suffixes of a bucket, and of one leading string.
BUCKET = 30_000
# Text that is hashed at once, in bytes; longer ones are taken in overlapping stretches.
STRETCH = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_seeded = np.random.default_rng(1977)
_SYMBOLS = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTORS = _seeded.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
KEYS = ["node", "other"]


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(raw: bytes) -> tuple[int, int]:
    """The name of a text: 128 bits of a digest, as two numbers."""
    digest = blake2b(raw, digest_size=16).digest()
    return tuple(int.from_bytes(half, "little", signed=True) for half in (digest[:8], digest[8:]))


def _stretch_anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    hashes, width = _SYMBOLS[raw], 1
    for factor in _FACTORS[: GRAM.bit_length() - 1]:
        hashes = hashes[:-width] * factor + hashes[width:]
        hashes ^= hashes >> np.uint64(29)
        width *= 2
    hashes *= _FACTORS[7]
    hashes ^= hashes >> np.uint64(32)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    places = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], len(places)) - 1
    return hashes[places[first]].view(np.int64), places[first], first, last


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """``(hash of its GRAM bytes, place, first, last)`` of each anchor of a text.

    Every string of LENGTH bytes belongs to one anchor; those that start from ``first`` to
    ``last`` belong to this one. Strings with equal bytes have theirs at the same distance.
    """
    symbols = np.frombuffer(raw, np.uint8)
    parts = []
    for start in range(0, max(len(symbols) - LENGTH + 1, 0), STRETCH):
        grams, *rest = _stretch_anchors(symbols[start : start + STRETCH + LENGTH - 1])
        parts.append((grams, *(x + start for x in rest)))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _survey(docs: DataFrame) -> DataFrame:
    """One row for each document: key, size, digest, and its anchors."""

    def run(rows):
        for doc_id, text in rows:
            raw = raw_bytes(text)
            grams, places, _, _ = anchors(raw)
            yield doc_id, *text_key(raw), len(raw), sha256(raw).hexdigest(), grams, places.astype(np.int32)

    schema = "doc_id long, node long, other long, n_bytes long, sha256 string, grams array<long>, places array<int>"
    return stored(map_rows(docs.select("doc_id", null_free()), run, schema))


def _candidates(classes: DataFrame) -> DataFrame:
    """``(node, other, places)``: for each distinct text the anchors whose grams stand elsewhere too."""
    zipped = F.explode(F.arrays_zip("grams", "places")).alias("x")
    entries = classes.select(*KEYS, zipped).select(*KEYS, "x.grams", "x.places")
    often = stored(entries.groupBy("grams").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_counted(entries, often, ["grams"]).groupBy(*KEYS).agg(F.collect_list("places").alias("places"))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(node, other, text)`` of the given texts, once or a few times each, and few others."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(keys))

    def run(rows):
        seen: set[tuple] = set()
        for (text,) in rows:
            key = text_key(raw_bytes(text))
            place = key[0] % BITS
            if key in seen or not bits.value[place >> 3] >> (place & 7) & 1:
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(key)
            yield *key, text

    return stored(map_rows(docs.select(null_free()), run, "node long, other long, text string"))


SUFFIX = "lead binary, left binary, right binary, node long, other long, place long"


def _suffixes(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates' suffixes, as far as strings that belong to the anchor reach, and what
    precedes them."""
    met = texts.join(candidates.hint("merge"), KEYS).sortWithinPartitions(*KEYS)

    def run(rows):
        last = None
        for node, other, text, places in rows:
            if (node, other) == last:
                continue  # a text that several tasks have sent
            last = node, other
            raw = raw_bytes(text)
            wanted = set(places)
            _, *spans = anchors(raw)
            for place, start, end in zip(*(x.tolist() for x in spans)):
                if place in wanted:
                    right = raw[place : end + LENGTH]
                    yield right[:GRAM], raw[start:place], right, node, other, place

    return stored(map_rows(met.select(*KEYS, "text", "places"), run, SUFFIX))


def multikey_sort(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with the one before.

    Multikey quicksort eight bytes at a time: all rows are split by one word, then those that
    still tie by the next.
    """
    n, width = strings.shape
    words = strings.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for column in range(words.shape[1]):
        size = np.bincount(group, minlength=n)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        rows, own = order[tied], group[tied]
        values = words[rows, column]
        by = np.lexsort((values, own))
        rows, own, values = rows[by], own[by], values[by]
        order[tied] = rows
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        differs = np.ones(len(tied), bool)
        differs[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
        new[tied] = differs
        group = np.cumsum(new) - 1
    common = np.full(n, 0, np.int64)
    for start in range(1, n, 8192):
        end = min(start + 8192, n)
        differ = strings[order[start:end]] != strings[order[start - 1 : end - 1]]
        found = differ.any(axis=1)
        common[start:end] = np.where(found, differ.argmax(axis=1), width)
    return order, common


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    padded = b"".join(x.ljust(width, b"\0") for x in strings)
    return np.frombuffer(padded, np.uint8).reshape(len(strings), width)


def repeated(lefts: list[bytes], rights: list[bytes]) -> np.ndarray:
    """``[row, o]``: whether the string that starts ``o`` bytes before the row's anchor is also
    around another row's.

    Two strings are equal if their parts from the anchor on are equal for LENGTH - o bytes
    and those before it for o bytes. In a sorted list such rows stand together, with common
    prefixes at least so long in between; a pair of group numbers names the string.
    """
    n = len(lefts)
    out = np.zeros((n, REACH), bool)
    least = LENGTH - np.fromiter(map(len, rights), np.int64, n)
    most = np.fromiter(map(len, lefts), np.int64, n)
    width = -(-REACH // 8) * 8
    right_order, right_common = multikey_sort(_matrix(rights, LENGTH))
    left_order, left_common = multikey_sort(_matrix([x[::-1] for x in lefts], width))
    right_group, left_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH):
        active = np.flatnonzero((least <= o) & (o <= most))
        if len(active) < 2:
            continue
        right_group[right_order] = np.cumsum(right_common < LENGTH - o)
        left_group[left_order] = np.cumsum(left_common < o)
        names = right_group[active] * (n + 1) + left_group[active]
        by = np.argsort(names)
        same = np.diff(names[by]) == 0
        twice = np.zeros(len(active), bool)
        twice[:-1] |= same
        twice[1:] |= same
        out[active[by[twice]], o] = True
    return out


FOUND = "node long, other long, begin long, end long"


def _found(suffixes: DataFrame) -> DataFrame:
    """``(node, other, begin, end)``: stretches of bytes that repeated strings cover.

    A leading string of more than BUCKET suffixes is divided: suffixes that are equal as far
    as they reach repeat throughout and count once, the others go on under longer leading
    strings, until each of these has few enough to be sorted in a task.
    """
    divided, found = divide(suffixes, LENGTH, REACH, 1, BUCKET)
    divided = stored(divided)
    n_buckets = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-divided.count() // BUCKET))
    ranged = divided.repartitionByRange(n_buckets, "lead")

    def run(rows):
        rows = list(rows)
        if not rows:
            return
        flags = repeated([row[1] for row in rows], [row[2] for row in rows])
        edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for row, low, high in zip(*(x.tolist() for x in (*np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1))):
            *_, node, other, place = rows[row]
            yield node, other, place - high, place - low + LENGTH

    return found.unionByName(map_rows(ranged, run, FOUND))


REMOVED = "node long, other long, n_removed long, n_spans long, kept_sha256 string, kept string"


def whole_characters(raw: bytes, spans: list[list[int]]) -> str:
    """The text without the characters that any span has a byte of."""

    def inside(place: int) -> bool:
        return 0 < place < len(raw) and raw[place] & 0xC0 == 0x80

    parts, reached = [], 0
    for begin, end in sorted(spans):
        while inside(begin):
            begin -= 1
        while inside(end):
            end += 1
        parts.append(raw[reached : max(begin, reached)])
        reached = max(reached, end)
    return b"".join([*parts, raw[reached:]]).decode("utf-8", "surrogatepass")


def _removed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """What is left of each text with repeated strings, once for each text."""
    spans = found.groupBy(*KEYS).agg(F.collect_list(F.array("begin", "end")).alias("spans"))
    met = texts.join(spans.hint("merge"), KEYS).sortWithinPartitions(*KEYS)

    def run(rows):
        last = None
        for node, other, text, spans in rows:
            if (node, other) == last:
                continue
            last, raw = (node, other), raw_bytes(text)
            kept, reached, runs, out = [], 0, 0, -1
            for begin, end in sorted(spans):
                if begin > out:
                    kept.append(raw[reached:begin])
                    runs += 1
                out = max(out, end)
                reached = out
            kept = b"".join([*kept, raw[reached:]])
            text = whole_characters(raw, spans)
            yield node, other, len(raw) - len(kept), runs, sha256(kept).hexdigest(), text

    return stored(map_rows(met.select(*KEYS, "text", "spans"), run, REMOVED))


def _resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents with the number of equal texts, and what is left of texts that are cut."""
    surveyed = _survey(docs)
    classes = surveyed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("places").alias("places")
    )
    classes = stored(classes)
    candidates = stored(_candidates(classes))
    texts = _texts(docs, candidates.select("node"))
    removed = _removed(texts, _found(_suffixes(texts, candidates)))
    copies = classes.where("copies > 1").select(*KEYS, "copies")
    members = attach(surveyed.select("doc_id", *KEYS, "n_bytes", "sha256"), copies, KEYS)
    return members, removed


EMPTY = sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``(doc_id, text)``.

    A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too, in
    this or another document; strings are judged on the texts as they come. Of a text that
    stands in several rows, repeated rows too, so nothing is left if it has LENGTH bytes; it
    takes part in the search once. A null text counts as empty; shorter texts stay whole.
    """
    members, removed = _resolved(docs)
    joined = attach(members, removed.drop("kept"), KEYS)
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with the columns of ``documents``.

    A character of which some bytes go goes whole; ``n_chars`` follows. Texts that are not
    cut stay where they are read.
    """
    docs = docs.select(*DOCUMENT)
    members, removed = _resolved(docs.select("doc_id", "text"))
    gone = members.where(F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)).select(*KEYS).distinct()
    cut = removed.join(gone, KEYS, "left_anti").select(*KEYS, "kept")
    cut = stored(cut.unionByName(gone.withColumn("kept", F.lit(""))))
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(cut.select("node")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def keyed(rows):
        for row in rows:
            key = text_key(raw_bytes(row[1]))
            place = key[0] % BITS
            maybe = bool(bits.value[place >> 3] >> (place & 7) & 1)
            yield *row, *(key if maybe else (None, None))

    named = map_rows(docs, keyed, f"{kinds}, node long, other long")
    same = [F.col(f"d.{k}") == F.col(f"c.{k}") for k in KEYS]
    changed = named.where("node is not null").alias("d").join(cut.alias("c"), same, "left")
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.col("kept"))
    chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    changed = changed.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))
    return named.where("node is null").select(*DOCUMENT).unionByName(changed)
