"""Operators of leafscan.llm against brute force, round trips and their edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from leafscan.llm import bpe, chat, fingerprints, jaccard, mixing, nbsvm, quality_rules, suffix_tree, suffixes, toxicity
from leafscan.llm.fingerprints import Fingerprint, paragraphs
from leafscan.llm.graph import connected
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioulrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, a null, empty, blank and repeated rows, a long text."""
    rng = random.Random(3)
    base, passage = sentence(rng, 120).split(), sentence(rng, 60)
    texts = [" ".join(base), " ".join(base).upper()]
    for i in range(6):
        near = list(base)
        near[10 + 15 * i] = f"x{i}"
        texts.append(" ".join(near))
    texts += [sentence(rng, 80) + " " + passage + "\n" + sentence(rng, 40) for _ in range(3)]
    texts += [sentence(rng, 3), "a b", "A  b", "", None, " \n\t", "é ü #é\n" * 9, sentence(rng, 9000)]
    texts += ["spam spam spam spam " * 30, texts[0], "x" * 700, "x" * 199]
    out = [(i, text, "en", f"s{i % 3}" if i % 7 else None, len(text or "")) for i, text in enumerate(texts)]
    return out + [out[9], (None, texts[8], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, with columns named like results."""
    return spark.createDataFrame([(*row, 0.5, 1, "k") for row in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows):
    return [(i, (text or "").encode()) for i, text, *_ in rows]


def test_suffixes_match_brute_force(docs, rows, empty, monkeypatch):
    counts = Counter(raw[k : k + 200] for _, raw in by_text(rows) for k in range(len(raw) - 199))
    want = []
    for i, raw in by_text(rows):
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 199):
            if counts[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, out in zip(raw, gone) if not out)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    key = lambda row: (row[0] is None, *map(str, row))
    for bucket in (suffixes.BUCKET, 2):  # the second deals out each leading string by a salt
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        got = [tuple(row) for row in suffixes.remove_repeats(docs).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert suffixes.remove_repeats(empty).count() == 0
    cut = suffixes.cut_documents(docs)
    assert cut.columns == ["doc_id", "text", "lang", "source", "n_chars"] and cut.count() == len(rows)
    assert {r.doc_id for r in cut.where("n_chars = 0").collect()} >= {0, 20}


def test_multikey_sort_matches_sorted():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 2, (300, 16), dtype=np.uint8)
    order, common = suffixes.multikey_sort(strings)
    spelt = [strings[i].tobytes() for i in order]
    assert spelt == sorted(spelt)
    for a, b, n in zip(spelt, spelt[1:], common[1:]):
        assert n == next((k for k in range(16) if a[k] != b[k]), 16)


def test_jaccard_matches_brute_force(docs, rows, empty):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text, *_ in rows:
        words = WORD.findall((text or "").translate(lower))
        width = min(len(words), 5)
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    least = {}
    for g, row in zip(group, rows):
        least[g] = min(x for x in (least.get(g), row[0]) if x is not None) if (least.get(g), row[0]) != (None, None) else None
    want = [(row[0], len(s), least[g]) for row, s, g in zip(rows, sets, group)]
    got = [tuple(row) for row in jaccard.components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [row.doc_id for row in jaccard.keep_one(docs).collect()]
    assert Counter(kept)[0] == 1 and not set(kept) & {1, 2, 3, 7, 13, 20} and {8, 12} <= set(kept)
    assert jaccard.components(empty).count() == 0


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(connected(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_quality_rules(docs, rows, empty):
    got = quality_rules.score_documents(docs)
    assert got.count() == len(rows) and quality_rules.score_documents(empty).count() == 0
    by_id = {row.doc_id: row for row in got.collect()}
    assert by_id[19].n_repeat_words == 120 and not by_id[19].kept and by_id[0].kept
    assert by_id[15].n_words == 0 and by_id[15].base_failed
    assert by_id[17].n_dup_lines == 8 and by_id[17].n_symbols == 9
    kept = {row.doc_id for row in quality_rules.keep_documents(docs).collect()}
    assert kept == {row.doc_id for row in got.where("kept").collect()}


def test_bad_host_counts_own_failures(spark):
    good, odd = " ".join(f"w{i}ord" for i in range(60)), " ".join(f"#w{i}" for i in range(60))
    table = [(i, odd, "bad") for i in range(30)] + [(100 + i, good, "bad" if i < 2 else "fine") for i in range(90)]
    table += [(500, odd, "fine")]
    judged = quality_rules.score_documents(spark.createDataFrame(table, "doc_id long, text string, source string"))
    kept = {row.doc_id for row in judged.where("kept").collect()}
    assert not kept & set(range(30)) and {100, 101, 150, 500} <= kept


def test_mixing(docs, rows, empty):
    got = [row.asDict() for row in mixing.mix_sizes(docs).collect()]
    assert len(got) == len(rows) and mixing.mix_sizes(empty).count() == 0
    assert all(0 <= row["taken"] <= 2 * row["size"] for row in got)
    assert got == [row.asDict() for row in mixing.mix_sizes(docs.repartition(5)).collect()]
    sizes = {}
    for i, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = {row["source_size"]: row["target"] for row in got}
    assert set(targets) == set(sizes.values())
    assert sum(targets[s] for s in sizes.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sum(row["taken"] for row in got) == pytest.approx(1.5 * sum(sizes.values()), abs=2 * len(rows))
    mixed = mixing.mix_documents(docs)
    assert mixed.agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))).first()[0] == sum(
        row["taken"] for row in got
    )
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_demand_is_inverted(spark):
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for schedule in mixing.SCHEDULES:
        for row in shares.select("u", mixing.time_of(F.col("u"), schedule).alias("t")).collect():
            done = 0.0
            for t0, t1, _, w0, w1 in mixing.demand(schedule):
                t = min(max(row.t, t0), t1)
                done += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert done == pytest.approx(row.u, abs=1e-9)


def test_fingerprints(docs, rows, empty):
    a, b, c = "one line\nanother", "another\none line", "third thing"
    whole = Fingerprint().plus(paragraphs(a))
    assert str(whole) == str(Fingerprint().plus(paragraphs(b)))
    assert str(whole.plus([c]).plus([c], -1)) == str(whole)
    assert str(Fingerprint.parse(str(whole)).joined(Fingerprint().plus([c]))) == str(whole.plus([c]))
    assert str(whole.edited(paragraphs(a), [c, "another"])) == str(Fingerprint().plus(["another", c]))
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(rows) and fingerprints.edited_likeness(empty).count() == 0
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    row = next(r for r in got if r.doc_id == 2)
    text, after = rows[2][1], rows[1][1]
    third = len(text) // 3
    assert row.edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
    assert known[0][0] == 22 and row.near_edited > 0.4 and row.near_next < 0.4
    same = {r.fingerprint for r in got if r.doc_id in (0, 20)}
    assert len(same) == 1
    groups = fingerprints.merged(docs.join(fingerprints.fingerprint(docs).dropDuplicates(["doc_id"]), "doc_id"), ["source"])
    assert groups.count() == len({r[3] for r in rows if r[0] is not None})


def test_bpe_round_trip(docs, rows, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = bpe.encoding(path, pattern)
    whole = {row.doc_id: row for row in bpe.encode(docs, path, pattern, size=40).collect()}
    for i, text, *_ in rows[:23]:
        assert list(whole[i].ids) == encoder.encode_ordinary(text or "")
    got = bpe.digests(docs, path, pattern).collect()
    digests = {(i, hashlib.sha256((text or "").encode()).hexdigest()) for i, text, *_ in rows}
    assert {(row.doc_id, row.decoded_sha256) for row in got} == digests and len(got) == len(rows)
    assert bpe.digests(empty, path, pattern).count() == 0


def test_chat(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, None, None),
        (None, 0, "ann", "alone"), (2, 0, "system", "nobody"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    got = {(row.conv_id, row.speaker): row for row in chat.render(table).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.text.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nyo")
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi < |end|><|end|>"]
    bob = got[1, "bob"]
    assert [bob.text[m.start : m.end] for m in bob.mask] == ["yo<|end|>"] * 2
    parts = chat.render(table, part_chars=20).where("speaker = 'bob'").orderBy("part").collect()
    assert len(parts) > 1 and "".join(row.text for row in parts) == bob.text
    assert chat.render(table.where("false")).count() == 0


def test_suffix_tree(docs, rows, empty):
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(rows) and suffix_tree.score(empty).count() == 0
    import zlib

    low = lambda t: [w.decode() for w in suffix_tree.words_of(t or "")]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter()
    for i, text, *_ in rows:
        if not out(i):
            counts.update([*low(text), None])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), out(i), len(low(t)) + 1, sum(counts[w] > 0 for w in [*low(t), None]), total,
         round(sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in [*low(t), None]), 6))
        for i, t, *_ in rows
    )
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    tree = suffix_tree.learn(docs)
    probabilities = 10.0 ** tree.logs.astype(float)
    assert probabilities.sum(axis=1) == pytest.approx(np.ones(len(probabilities)), abs=1e-4)
    long = b"ab " * 700 + b"c"
    assert tree.scores([long, b""])[0] < tree.scores([b"ab"])[0] < 0


@pytest.mark.parametrize("column, module", [("toxic", toxicity), ("quality", nbsvm)])
def test_classifiers(spark, column, module):
    rng = random.Random(5)
    data = []
    for i in range(400):
        bad = i % 4 == 0
        words = sentence(rng, 60).split()
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(60), "dreadful!!")
        data.append((i, " ".join(words), int(bad if column == "toxic" else not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, ""), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1)], f"doc_id long, {column} int")
    got = {row.doc_id: row for row in module.score(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= row.score <= 1 for row in got.values())
    held = [(got[i], y) for i, _, y in data if got[i].held_out]
    assert len(held) > 40 and sum(row.predicted == y for row, y in held) / len(held) > 0.95
    assert module.score(docs, labels.where("false")).count() == 402
    assert module.score(docs.where("false"), labels).count() == 0


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    frame, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({row.doc_id for row in frame.collect()})
        if i < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 19 not in seen[0] and {0, 1, 8, 18} <= seen[0]
    assert 0 in seen[1] and 1 not in seen[1] and seen[2] == seen[1]
    assert {"doc_id", "ids"} <= set(frame.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_characters_go_whole(spark):
    middle = "x" * 198
    texts = [f"é{middle}è", f"ũ{middle}ñ", f"a€{middle}€b€{middle}€c"]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string, n_chars long")
    removed = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs).collect()}
    cut = {r.doc_id: (r.text, r.n_chars) for r in suffixes.cut_documents(docs).collect()}
    assert removed[0] == removed[1] == 200 and removed[2] > 200
    # the first byte of é and of ũ differ, the last byte of è and of ñ differ: both go whole
    assert cut == {0: ("", 0), 1: ("", 0), 2: ("abc", 3)}
    assert suffixes.whole_characters("aéb".encode(), [[2, 3]]) == "ab"
    assert suffixes.whole_characters("aéb€c".encode(), [[1, 2], [4, 5]]) == "abc"


def test_long_white_space_is_one_match(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = bpe.encoding(path, public_tokenizers.PATTERN)
    texts = ["a" + " " * 2_000_000 + "b c", "\n　 " * 5000 + "d", "x " + "\t" * 12_000, " " * 10_000, "\x1f" * 10_001 + " e"]
    texts += [f"{a}{blank * 10_000}{b}" for a in ("", "o", "'", "9") for b in ("", "p", "'s", "8") for blank in (" ", " ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    for r in got:
        assert bytes(r.bytes) == texts[r.doc_id].encode()
        if r.doc_id:  # the library itself cannot encode the first text
            assert r.ids == encoder.encode_ordinary(texts[r.doc_id]), r.doc_id


def test_keep_one_keeps_what_is_linked_with_nothing(spark, empty):
    words = " ".join(f"w{i}" for i in range(40))
    texts = [(1, words), (2, words.upper()), (2, words), (2, words), (5, ""), (5, None), (5, ""), (None, words), (None, "one two"), (7, "one two"), (7, "one two"), (8, "x")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == Counter({(1, words): 1, (5, ""): 2, (5, None): 1, (7, "one two"): 1, (8, "x"): 1})
    assert jaccard.keep_one(empty.select("doc_id", "text", "lang", "source", "n_chars")).count() == 0


def test_stored_tables_are_removed(spark, docs):
    from pathlib import Path

    from leafscan.llm.common import drop_stored, storing

    paths = []
    with storing(paths):
        kept = jaccard.keep_one(docs)
        n = kept.count()
    assert len(paths) > 5 and all(Path(p).exists() for p in paths)
    # what a result is still read from stays on request
    drop_stored(spark, paths, kept.inputFiles())
    assert paths and kept.count() == n
    left = list(paths)
    drop_stored(spark, paths)
    assert not paths and not any(Path(p).exists() for p in left)


def test_round_trip_digests(docs, rows, empty):
    """Digests of ids and bytes against the library itself, text by text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = bpe.encoding(path, public_tokenizers.PATTERN)
    want = []
    for doc_id, text, *_ in rows:
        ids = encoder.encode_ordinary(text or "")
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = [tuple(r) for r in bpe.digests(docs, path, public_tokenizers.PATTERN).collect()]
    assert Counter(got) == Counter(want) and bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_suffix_tree_mixes_words_with_their_shares(docs, rows):
    tree = suffix_tree.learn(docs.where(~suffix_tree.held_out()))
    got = Counter((str(r.doc_id), round(r.score, 4)) for r in suffix_tree.score(docs).collect())
    import zlib

    counts, ends = Counter(), 0
    for i, text, *_ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(suffix_tree.words_of(text or ""))
            ends += 1
    total = sum(counts.values()) + ends + len(counts) + 1 + 1
    end = (ends + 1) / total
    want = Counter()
    for i, text, *_ in rows:
        words = suffix_tree.words_of(text or "")
        logs, _ = tree.symbol_scores([b" ".join(words)])
        at, value = 0, 0.0
        for k, word in enumerate(words or [b""]):
            spelt = 10 ** logs[at : at + len(word) + 1].sum()
            at += len(word) + 1
            share = (counts[word] + 1) / total if words else end
            share *= (1 - end) if words and k == 0 else 1
            share *= end / (1 - end) if words and k == len(words) - 1 else 1
            value += np.log10(suffix_tree.TREE * spelt + (1 - suffix_tree.TREE) * share)
        want[str(i), round(float(value), 4)] += 1
    assert {k for k, _ in got} == {k for k, _ in want}
    for (a, x), (b, y) in zip(sorted(got.elements()), sorted(want.elements())):
        assert a == b and x == pytest.approx(y, rel=1e-4, abs=1e-3)


def test_suffix_tree_beats_word_shares_on_held_out_texts(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no corpus")
    scored = suffix_tree.score(spark.read.parquet(str(path))).where("held_out")
    better, score, base, n = scored.agg(
        F.avg((F.col("score") > F.col("base_score")).cast("int")), F.sum("score"), F.sum("base_score"), F.count("*")
    ).first()
    assert n > 100 and score > base and better > 0.9
