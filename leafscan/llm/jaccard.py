"""Documents joined by the Jaccard likeness of their 5-word shingles, and the groups they form.

Rare-first prefix filtering: if a set's n shingles stand in one order for all documents, rare
ones first, then two sets with a likeness of 0.8 share one of their first n/5 + 1. Sets that
share such a shingle are candidates; length, positional and suffix filters drop those that
cannot reach the threshold, and each remaining pair is verified once, on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.common import (
    BITS,
    DOCUMENT,
    attach,
    drop_stored,
    join_counted,
    map_columns,
    map_rows,
    null_free,
    small_batches,
    stored,
    storing,
    wanted_bits,
)
from leafscan.llm.graph import connected
from leafscan.llm.shingles import mixed, set_id, shingle_set

# Likeness in percent.
PERCENT = 80
# Counters of the sketch of shingle frequencies, and the rows they are merged in.
COUNTERS, SLICES = 1 << 20, 16
# A shingle this much more frequent than the sketch's median is dealt out by a salt, so
# that a task gets about so many of its documents.
HOT = 20_000
# Bytes of the bitmap of a set for the suffix filter: at least half its size, within these.
LEAST_BYTES, MOST_BYTES = 16, 512
# Neighbours of a set, in a random order of those that share a shingle, that it may first be compared with.
NEIGHBOURS = 4
# Rounds in which each set is compared with the likeliest of a sample.
ROUNDS = 1
# Sets of one shingle that a task holds at once, and so few that they are compared one by one.
HELD, FEW = 256, 8
# Pairs with one common partner that are verified in one task.
VERIFIED = 2_000


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each of a set's hashes, in a power of two of bytes that follows the set's size."""
    size = min(max(1 << (len(hashes) // 2).bit_length(), LEAST_BYTES), MOST_BYTES)
    marked = np.zeros(8 * size, bool)
    marked[(hashes & np.uint64(8 * size - 1)).astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").tobytes()


def most_common(x: np.ndarray, n: int, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles a set of n can share at most with each of others, by their bitmaps.

    A bit that only one side has stands for a shingle that only it has. The wider bitmaps are
    folded to the width of the others.
    """
    while len(x) > rows.shape[1]:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while rows.shape[1] > len(x):
        rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
    return np.minimum(n - np.bitwise_count(x & ~rows).sum(1), sizes - np.bitwise_count(rows & ~x).sum(1))


def most_common_of_two(x: bytes, n: int, y: bytes, m: int) -> int:
    """The same for two sets."""
    width = 8 * min(len(x), len(y))
    left, right = folded(x, width), folded(y, width)
    return min(n - (left & ~right).bit_count(), m - (right & ~left).bit_count())


def folded(raw: bytes, width: int) -> int:
    """A bitmap, folded to so many bits."""
    value, bits = int.from_bytes(raw, "little"), 8 * len(raw)
    while bits > width:
        bits //= 2
        value = value & ((1 << bits) - 1) | value >> bits
    return value


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Every row of Arrow batches and the shingles of its last column."""
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            yield row, shingle_set(row[-1])


MEMBER = "doc_id long, digest string, n_shingles long, node long, bits binary"


def _survey(docs: DataFrame) -> DataFrame:
    """One row for each document, and those of each task's sketch of shingle frequencies."""

    def run(rows):
        counts = np.zeros(COUNTERS, np.int64)
        for doc_id, digest, text in rows:
            hashes = shingle_set(text)
            np.add.at(counts, (hashes >> np.uint64(44)).astype(np.int64), 1)
            node = set_id(hashes) if len(hashes) else None
            yield doc_id, digest, len(hashes), node, bitmap(hashes), None, None
        for i, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                yield None, None, None, None, None, i, part.astype("<i8").tobytes()

    source = docs.select("doc_id", F.md5(null_free()).alias("digest"), null_free())
    return stored(map_rows(source, run, f"{MEMBER}, slice int, counts binary"))


def _frequencies(surveyed: DataFrame) -> np.ndarray:
    """The merged sketch: how often shingles of each hash slot occur; a fixed 8 MB."""

    def add(rows):
        sums: dict[int, np.ndarray] = {}
        for i, counts in rows:
            sums[i] = sums.get(i, 0) + np.frombuffer(counts, "<i8")
        yield from ((i, counts.tobytes()) for i, counts in sums.items())

    slices = surveyed.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    total = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for i, counts in map_rows(slices, add, "slice int, counts binary").collect():
        total[i] = np.frombuffer(counts, "<i8")
    return total.ravel()


ENTRY = "gram long, base long, node long, size long, place long"


def _prefixes(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """The first shingles of every set, rare ones first: ``(gram, base, node, size, place)``.

    A frequent one is salted: ``gram`` is then one of several names and ``base`` its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    floor = int(np.median(frequencies))

    def run(batches):
        counts = shared.value
        seen: set[int] = set()
        for _, hashes in _sets(batches):
            n = len(hashes)
            node = set_id(hashes) if n else 0
            if not n or node in seen:
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(node)
            often = counts[(hashes >> np.uint64(44)).astype(np.int64)]
            first = np.lexsort((hashes, often))[: n - -(-n * PERCENT // 100) + 1]
            grams, often = hashes[first], often[first]
            salts = np.maximum((often - floor) // HOT, 0).astype(np.uint64)
            base = np.where(salts > 0, grams, 0)
            salt = np.uint64(node & (2**64 - 1)) % (salts + np.uint64(1))
            named = np.where(salts > 0, mixed(grams + mixed(salt + np.uint64(1))), grams)
            same = np.ones(len(first), np.int64)
            yield named.view(np.int64), base.view(np.int64), same * node, same * n, np.arange(len(first))

    return map_columns(docs.select(null_free()), run, ENTRY)


SHARED = f"{ENTRY}, hub long, near boolean"


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of shingles that stand in several sets, each with its shingle's first set.

    ``near`` tells whether the set passes the length and positional filters against that
    hub. A part of a salted shingle has its hub in any case, to be met under its own name. Rows stream by in the order of the shingles; no shingle's sets are held together.
    """

    def run(batches):
        held = None  # the first row of the current shingle, and whether it has been handed on
        for batch in batches:
            rows = np.stack([np.asarray(column) for column in batch.columns])
            before = 0 if held is None else 1
            if before:
                rows = np.concatenate([held[0][:, None], rows], axis=1)
            gram, node = rows[0], rows[2]
            first = np.ones(len(gram), bool)
            first[1:] = gram[1:] != gram[:-1]
            hub = np.flatnonzero(first)[np.cumsum(first) - 1]
            other = node != node[hub]  # copies of the hub's set
            again = np.zeros(len(gram), bool)
            again[1:] = ~first[1:] & (node[1:] == node[:-1])
            alone = first & (rows[1] == 0)
            alone[hub[other]] = False
            # a first row goes out with the first other set of its shingle
            out = (other & ~again) | (first & ~alone)
            if before and held[1]:
                out[0] = False
            last = hub[-1]
            held = rows[:, last].copy(), bool(not alone[last] or (last == 0 and before and held[1]))
            if not out.any():
                continue
            mine, of = rows[:, out], rows[:, hub[out]]
            need = -(-(mine[3] + of[3]) * PERCENT // (100 + PERCENT))
            most = np.minimum(mine[4], of[4]) + np.minimum(mine[3] - mine[4], of[3] - of[4])
            fits = 100 * np.minimum(mine[3], of[3]) >= PERCENT * np.maximum(mine[3], of[3])
            yield *mine, of[2], fits & (most >= need)

    dealt = entries.repartition("gram").sortWithinPartitions("gram", "node")
    return map_columns(dealt, run, SHARED)


def _texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``(digest, text)`` for the given digests, once or a few times each; others may be among them.

    Texts are told apart by the digest that Spark computes; none is cut into words here.
    """
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(digests.select(F.xxhash64("digest").alias("node"))))

    def run(batches):
        wanted, seen = bits.value, set()
        for batch in batches:
            places = np.asarray(batch.column(2))
            hits = np.flatnonzero(wanted[places >> 3] >> (places & 7) & 1)
            found = []
            for i, digest in zip(hits.tolist(), batch.column(0).take(pa.array(hits)).to_pylist()):
                if digest not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(digest)
                    found.append(i)
            if found:
                yield batch.select([0, 1]).take(pa.array(found))

    small_batches(docs.sparkSession)
    digest = F.md5(null_free())
    source = docs.select(digest.alias("digest"), null_free().alias("text"), F.pmod(F.xxhash64(digest), F.lit(BITS)).alias("place"))
    return source.mapInArrow(run, "digest string, text string")


def verify(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` of sets whose likeness reaches the threshold.

    The text of ``b`` meets those of its partners, VERIFIED or so at a time, one by one.
    """
    crowded = pairs.groupBy("b").count().where(F.col("count") > VERIFIED)
    blocks = F.ceil(F.col("count") / VERIFIED).cast("long").alias("_blocks")
    dealt = attach(pairs, crowded.select("b", blocks), ["b"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("a"), F.coalesce("_blocks", F.lit(1))).cast("long"))
    dealt = stored(dealt.select("a", "b", "block"))
    rows = dealt.select(F.col("a").alias("node"), "b", "block", F.lit(1).alias("member"))
    hubs = dealt.select(F.col("b").alias("node"), "b", "block", F.lit(0).alias("member")).distinct()
    rows = rows.unionByName(hubs)
    known = members.where("node is not null").join(rows.select("node").distinct(), "node", "left_semi")
    known = stored(known.groupBy("node").agg(F.min("digest").alias("digest")))
    met = rows.join(known, "node").join(_texts(docs, known), "digest")

    def run(rows):
        key, hub, last = None, None, None
        for node, b, block, member, text in rows:
            if (b, block) != key:
                key, hub, last = (b, block), shingle_set(text), None
            elif member and node != last:
                last, own = node, shingle_set(text)
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(hub) + len(own) - both):
                    yield node, b

    placed = met.repartition("b", "block").sortWithinPartitions("b", "block", "member", "node")
    return stored(map_rows(placed.select("node", "b", "block", "member", "text"), run, "a long, b long"))


def _first_pairs(shared: DataFrame) -> DataFrame:
    """For each set the hub that it shares most shingles with."""
    counts = shared.where("near and node <> hub").groupBy("node", "hub").count()
    best = counts.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("b"))
    return best.select(F.col("node").alias("a"), "b").distinct()


def _neighbours(shared: DataFrame) -> DataFrame:
    """For each set the neighbour that it shares most shingles with, among those before it and after it.

    The sets of a shingle stand in a random order of the shingle's own, and each meets the
    NEIGHBOURS before it; so the rows made are in proportion to those read.
    """

    def run(batches):
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(column) for column in batch.columns])], axis=1)
            for lag in range(1, NEIGHBOURS + 1):
                # what is held has met what came before it
                start = max(held.shape[1], lag)
                x, y = rows[:, start:], rows[:, start - lag : rows.shape[1] - lag]
                ok = (x[0] == y[0]) & (x[1] != y[1]) & _may_link(x[2], x[3], y[2], y[3])
                yield np.minimum(x[1], y[1])[ok], np.maximum(x[1], y[1])[ok]
            held = rows[:, -NEIGHBOURS:].copy()

    order = F.xxhash64("gram", "node")
    dealt = shared.select("gram", "node", "size", "place").repartition("gram").sortWithinPartitions("gram", order)
    counts = map_columns(dealt, run, "a long, b long").groupBy("a", "b").count()
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    both = counts.select("count", sides.alias("s")).select("s.*", "count")
    best = both.groupBy("node").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _may_link(n, place, m, other):
    """The length and positional filters, for sizes and the places of a common shingle."""
    most = np.minimum(place, other) + np.minimum(n - place, m - other)
    need = -(-(n + m) * PERCENT // (100 + PERCENT))
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (most >= need)


def _first_common(n, place, m, other):
    """The same for the first shingle that two sets share in the order of all shingles: before
    it they have nothing in common. Linked sets pass at that shingle, if not at all they share."""
    need = -(-(n + m) * PERCENT // (100 + PERCENT))
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.minimum(n - place, m - other) >= need)


def _open_pairs(shared: DataFrame, components: DataFrame, members: DataFrame, sampled: bool = False) -> DataFrame:
    """``(a, b, score)``: candidates between sets that share a shingle and are not in one component yet.

    If ``sampled``, a set meets the sets of one block of each shingle only, and of these just
    the likeliest leaves the task: in proportion to the sets, which joins most of what can be.

    A shingle whose sets are one component needs no more pairs. Of the others each set outside
    the shingle's largest component meets the sets of other components, HELD or so of them in a
    task, with all filters; only what passes, at the first shingle it may share, leaves the task. ``score`` compares the most that
    two sets can share with what they need.
    """
    own = F.when(F.col("base") != 0, F.col("base")).otherwise(F.col("gram")).alias("gram")
    entries = shared.select(own, "node", "size", "place").distinct()
    labelled = entries.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = labelled.groupBy("gram", "component").count()
    top = counts.groupBy("gram").agg(
        F.max_by("component", F.struct("count", "component")).alias("top"),
        F.count(F.lit(1)).alias("n"),
        F.ceil(F.sum("count") / HELD).cast("int").alias("blocks"),
    )
    left = stored(labelled.join(top.where("n > 1").drop("n"), "gram"))
    outside = F.col("component") != F.col("top")
    place = [F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("role")]
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.array(F.pmod(F.xxhash64("gram", "node"), "blocks").cast("int")) if sampled else blocks
    every = [F.explode(meets).alias("block"), F.lit(1).alias("role")]
    columns = ["gram", "node", "size", "place", "component", outside.alias("outside")]
    dealt = left.select(*columns, *place).unionByName(left.where(outside).select(*columns, *every))
    sets = members.where("node is not null").join(left.select("node").distinct(), "node", "left_semi")
    met = dealt.join(sets.groupBy("node").agg(F.first("bits").alias("bits")), "node")
    met = met.repartition("gram", "block").sortWithinPartitions("gram", "block", "role")

    def run(rows):
        if not sampled:
            yield from pairs(rows)
            return
        last, best = None, None
        for a, b, score, asks in pairs(rows, True):
            if asks != last:
                if best:
                    yield best
                last, best = asks, None
            best = max(best or (a, b, -1), (a, b, score), key=lambda pair: pair[2])
        if best:
            yield best

    def pairs(rows, named=False):
        key, there, tables = None, [], None
        for gram, block, role, node, size, place, component, outside, bits in rows:
            asks = ((gram, block, node),) if named else ()
            if (gram, block) != key:
                key, there, tables = (gram, block), [], None
            if not role:
                there.append((node, size, place, component, outside, bits))
                continue
            if len(there) <= FEW:
                for other, m, at, of, outer, their in there:
                    if of == component or outer and other >= node or 100 * min(size, m) < PERCENT * max(size, m):
                        continue
                    need = -(-(size + m) * PERCENT // (100 + PERCENT))
                    if min(size - place, m - at) >= need:
                        most = most_common_of_two(bits, size, their, m)
                        if most >= need:
                            yield min(node, other), max(node, other), 1000 * most // need, *asks
                continue
            if tables is None:
                widths = {}
                for row in there:
                    widths.setdefault(len(row[-1]), []).append(row)
                tables = [
                    (*(np.array(x) for x in list(zip(*group))[:5]), np.frombuffer(b"".join(row[-1] for row in group), np.uint8).reshape(len(group), -1))
                    for group in widths.values()
                ]
            x = np.frombuffer(bits, np.uint8)
            for nodes, sizes, places, components, outer, matrix in tables:
                # of two sets outside the largest component, the one with the larger id asks
                ok = (components != component) & (~outer | (nodes < node)) & _first_common(size, place, sizes, places)
                if not ok.any():
                    continue
                most = most_common(x, size, matrix[ok], sizes[ok])
                need = -(-(size + sizes[ok]) * PERCENT // (100 + PERCENT))
                for other, score in zip(nodes[ok][most >= need].tolist(), (1000 * most // need)[most >= need].tolist()):
                    yield min(node, other), max(node, other), score, *asks

    found = map_rows(met.select("gram", "block", "role", "node", "size", "place", "component", "outside", "bits"), run, "a long, b long, score long")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of pairs ``(a, b, score)`` the best one of each set."""
    best = F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")
    return pairs.groupBy("a").agg(best).select("p.*").union(pairs.groupBy("b").agg(best).select("p.*")).distinct()


def _still_open(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    for side in ("a", "b"):
        named = components.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a <> of_b").select("a", "b")


def _settled(spark: SparkSession, rows: Callable[[], DataFrame]) -> DataFrame:
    """The rows as a table, without those that were stored on the way to it."""
    paths: list[str] = []
    with storing(paths):
        found = rows()
    out = stored(found)
    drop_stored(spark, paths)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_shingles, group)`` for every row of ``(doc_id, text)``.

    Rows with the same group are linked, directly or through others. A text without words,
    or null, is linked with nothing and has no group. Copies have equal sets and count as one
    set from the start; repeated rows and equal ids are documents of their own.

    A first round compares each set with a few others only: the hub and the neighbour that it
    shares most of its shingles with, and others with the likeliest of a sample of its open
    candidates; that joins groups of any size without their pairs. Then all candidates that are still in different components are filtered, and those that pass
    are compared: first the likeliest of each set, then all that are in different components
    still. So no link that would join two components is missed. Sets are named by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    surveyed = _survey(docs)
    members = surveyed.where("slice is null").select(*(field.split()[0] for field in MEMBER.split(", ")))
    entries = _prefixes(docs, _frequencies(surveyed))
    shared = stored(_shared(entries))
    # the hubs of a salted shingle's parts meet under its own name
    hubs = shared.where("base <> 0 and node = hub")
    hubs = hubs.select(F.col("base").alias("gram"), F.lit(0).cast("long").alias("base"), "node", "size", "place")
    first = _first_pairs(shared).unionByName(_first_pairs(_shared(hubs)))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(_neighbours(shared))
    spark = docs.sparkSession

    def checked(pairs: DataFrame) -> DataFrame:
        return _settled(spark, lambda: verify(docs, members, pairs))

    def open_pairs(sampled: bool) -> DataFrame:
        # a pair that was verified once is settled
        found = _open_pairs(shared, stored(connected(links)), members, sampled)
        return (_likeliest(found) if sampled else found).join(tried, ["a", "b"], "left_anti")

    tried = first = stored(first.distinct())
    links = checked(first)
    for _ in range(ROUNDS):
        near = _settled(spark, lambda: open_pairs(True))
        links, tried = links.unionByName(checked(near)), tried.unionByName(near)
    found = _settled(spark, lambda: open_pairs(False))
    likeliest = stored(_likeliest(found))
    links = links.unionByName(checked(likeliest))
    rest = _still_open(found, stored(connected(links))).join(likeliest, ["a", "b"], "left_anti")
    rest = stored(rest)
    if not rest.isEmpty():
        links = links.unionByName(checked(rest))
    groups = connected(links).withColumnRenamed("component", "group")
    joined = attach(members, groups, ["node"])
    return joined.select("doc_id", "digest", "n_shingles", F.coalesce("group", "node").alias("group"))


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the least id that links lead to, the own included.

    Nulls of ``doc_id`` do not count as least; a group of nulls alone has none.
    """
    grouped = stored(classes(docs))
    least = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    joined = attach(grouped, least, ["group"])
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _suspects(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether each row's ``digest`` may be among the keys'; all that are, and few others."""
    name = F.xxhash64("digest").alias("node")
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(keys.select(name)))

    @F.pandas_udf("boolean")
    def wanted(nodes: pd.Series) -> pd.Series:
        place = nodes.to_numpy() % BITS
        return pd.Series((bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool))

    return docs.withColumn("_maybe", wanted(F.xxhash64("digest")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id; all that are linked with nothing.

    Of equal ids the one with the least digest stays, and of its repeated rows one; a null id
    comes last. Texts without words, nulls among them, are in no group and all stay. An empty
    table stays empty. Only texts that may have to go, or to stay once, are shuffled.
    """
    docs, keys = docs.select(*DOCUMENT), ["doc_id", "digest"]
    rows = stored(classes(docs)).where("group is not null")
    named = stored(rows.groupBy("group", *keys).agg(F.count(F.lit(1)).alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), *keys)
    groups = named.groupBy("group").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
    groups = stored(groups.where("n_rows > 1"))
    met = join_counted(named, groups, ["group"], "n_keys")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    # keys that go, and keys of which one row stays
    settled = met.select(*keys, stays.alias("stays"), "n").where("NOT stays OR n > 1").select(*keys, "stays")
    settled = stored(settled)
    judged = _suspects(docs.withColumn("digest", F.md5(null_free())), settled)
    other = settled.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "stays").hint("merge")
    same = judged["doc_id"].eqNullSafe(other["_id"]) & (judged["digest"] == other["_digest"])
    suspects = judged.where("_maybe").join(other, same, "left")
    whole = judged.where("NOT _maybe").unionByName(suspects.where("stays IS NULL").select(judged.columns))
    once = suspects.where("stays").dropDuplicates(keys).select(judged.columns)
    return whole.unionByName(once).select(*DOCUMENT)
