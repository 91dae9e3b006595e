"""Periodic runs, spelling variants and repeated passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from leafscan.llm import automata, runs, variants
from leafscan.llm.windows import divide

from tests.llm.test_llm import SCHEMA, WORD, sentence


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Copies, shared passages, periods, repeated lines, a null, blank and empty texts, a long one."""
    rng = random.Random(8)
    base, passage, tail = sentence(rng, 120).split(), sentence(rng, 70), sentence(rng, 20)
    texts = [" ".join(base), "\n ".join(base)]
    for i in range(5):
        near = list(base)
        near[12 + 18 * i] = f"X{i}"
        texts.append(" ".join(near))
    for i in range(14):
        end = tail if i % 2 else sentence(rng, 20)
        texts.append(f"{sentence(rng, 30)} {passage}\t{end}\n{sentence(rng, 30)}")
    texts += [sentence(rng, 3), "a b", "", None, " \n\t", "é ü #é\n" * 9, "ha " * 5, "ha " * 6, "x y " * 4]
    texts += ["a b a b c " * 9, ("one two " * 4 + "three ") * 6, "z " + "a a b " * 4 + "a a", sentence(rng, 34)]
    texts += [sentence(rng, 4000) + " " + "p q r s " * 700 + sentence(rng, 50), texts[0], passage]
    texts += ["  nbsp joined " * 40, "퟿\U0001f600 " * 20]
    out = [(i, text, "en", f"s{i % 3}", len(text or "")) for i, text in enumerate(texts)]
    return out + [out[9], (None, texts[8], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*row, 0.5, 1, "k") for row in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(words):
    """Every stretch that keeps a period and cannot be extended, if no smaller period fits."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                run, begin = words[start : i + q], start
                start = None
                if len(run) >= max(6, 4 * q) and all(run[d:] != run[:-d] for d in range(1, q)):
                    out.append((begin, len(run), q))
    return sorted(out)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_match_brute_force(docs, rows, empty, spark):
    want = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, WORD.findall(text or ""))
        found = brute_runs(words) if len(words) < 6000 else None
        if found is None:
            continue
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
        columns = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *columns, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = [tuple(r) for r in runs.digests(runs.collapse(runs.with_planted_runs(docs))).collect()]
    assert len(got) == len(rows)
    assert not Counter(want) - Counter(got)
    assert sum(row[1] for row in want) >= 6
    # the long text, without planting
    whole = {r.doc_id: r for r in runs.collapse(docs).collect()}
    long = next(i for i, text, *_ in rows if text and len(text) > 20_000)
    assert [tuple(r) for r in whole[long].runs] == [(4000, 2800, 4)]
    assert runs.digests(runs.collapse(runs.with_planted_runs(empty))).count() == 0
    # a text of one word and one period after the other, alone in its batch
    one = runs.collapse(spark.createDataFrame([(1, "w " * 300_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in one.runs] == [(0, 300_000, 1)] and one.collapsed == "w"


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_few_letters(seed):
    """Short alphabets make many overlapping periods."""
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 2 + seed % 2, n).astype(np.uint64) for n in (0, 1, 5, 30, 200, 400)]
    texts += [np.tile(rng.integers(0, 2, q), 1 + 60 // q).astype(np.uint64) for q in range(1, 16)]
    assert runs.find_runs(texts) == [brute_runs(text.tolist()) for text in texts]


def test_wavelet_matrix_finds_successors():
    rng = np.random.default_rng(5)
    values = rng.permutation(300)
    begin = rng.integers(0, 300, 500)
    end, bound = begin + rng.integers(0, 301 - begin), rng.integers(0, 300, 500)
    want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(begin, end, bound)]
    assert runs.WaveletMatrix(values).successor(begin, end, bound).tolist() == want


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            found = re.sub("[A-Z]", lambda m: m[0].lower(), found)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{found}".encode())
            if h % 97 == 0:
                found = found[: h % len(found)] + found[h % len(found) + 1 :]
            if len(found) >= 5:
                counts[found] += 1
    return {word: n for word, n in counts.items() if n >= 3}


def brute_forms(counts):
    near = defaultdict(set)
    for a in counts:
        for b in counts:
            short, long = sorted((a, b), key=len)
            if len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
                near[a].add(b)
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                near[a].add(b)
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}

    def root(word):
        return root(form[word]) if word in form else word

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_vocabulary_counts_what_documents_spell(docs, rows, empty):
    got = {tuple(r) for r in variants.vocabulary(docs).collect()}
    assert got == set(brute_words(rows).items()) and got
    assert variants.group_variants(variants.vocabulary(empty)).count() == 0
    # a share of one: every run loses a letter
    assert variants.typed(None, "é", 1) == "" and len(variants.typed(3, "abcdef", 1)) == 5


def test_variants_match_brute_force(spark):
    rng, counts = random.Random(4), {}
    for word in ("banana", "aabbcc", "éclair", "oooooo", "mirror"):
        counts[word] = 500
        for _ in range(60):
            out = word
            for _ in range(rng.randint(1, 3)):
                at, letter = rng.randrange(len(out)), rng.choice("abéo")
                out = rng.choice((out[:at] + out[at + 1 :], out[:at] + letter + out[at:], out[:at] + letter + out[at + 1 :]))
            counts.setdefault(out, rng.choice((3, 7, 7, 20, 60, 130)))
    long = "ab" * 3000
    counts |= {long: 9, long + "c": 4, "c" + long[1:]: 5, "alone": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in variants.group_variants(words).collect()}
    want = brute_forms({w: n for w, n in counts.items() if len(w) < 1000})
    assert {r for r in got if len(r[0]) < 1000} == want
    assert {(r[1], r[4]) for r in got if len(r[0]) > 1000} == {(None, 2), (long, 1), (None, 1)}
    assert any(r[1] and r[2] != r[1] for r in want)


def brute_passages(rows, length):
    counts = Counter()
    for _, text, *_ in rows:
        words = WORD.findall(text or "")
        counts.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            if counts[tuple(words[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        yield doc_id, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_passages_match_brute_force(docs, rows, empty, monkeypatch):
    want = Counter(brute_passages(rows, 35))
    assert sum(row[2] > 0 for row in want) > 12
    for crowd in (automata.CROWD, 2):  # the second divides every lead
        monkeypatch.setattr(automata, "CROWD", crowd)
        monkeypatch.setattr(automata, "SHARD", 3 * crowd)
        assert Counter(tuple(r) for r in automata.remove_repeats(docs).collect()) == want
    kept = {r.doc_id: r for r in automata.cut_texts(docs).collect()}
    assert kept[0].kept == b"" and kept[21].kept is None
    assert automata.remove_repeats(empty).count() == 0


def test_automaton_counts_places():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 7, 30, 30, 60)] + ["", "aaaa"]
    automaton = automata.SuffixAutomaton(texts)
    places = Counter(text[i:j] for text in texts for i in range(len(text)) for j in range(i + 1, len(text) + 1))
    for text in [*texts, "abcab" * 4]:
        covered, want = set(), set()
        for begin, end in automaton.repeats(text, 5):
            assert places[text[begin:end]] > 1 and end - begin >= 5
            covered |= set(range(begin, end))
        for i in range(len(text) - 4):
            if places[text[i : i + 5]] > 1:
                want |= set(range(i, i + 5))
        assert covered == want


def test_division_keeps_every_pair(spark):
    """Rows of one lead, divided down to single windows: each repeated window is found, or
    its rows still meet under one lead."""
    rng = random.Random(2)
    length, reach = 9, 6  # a lead of four symbols
    sides = ["".join(rng.choice("ab") for _ in range(5)) for _ in range(9)]
    rows = []
    for i in range(150):
        left, right = rng.choice(sides)[: rng.randint(0, 5)][::-1], "core" + rng.choice(sides)
        need = length - len(right)
        if len(left) >= need:
            rows.append((b"core", left.encode(), right.encode(), i, 0, 100))
    frame = spark.createDataFrame(rows, "lead binary, left binary, right binary, node long, other long, place long")
    want = defaultdict(set)
    for _, left, right, i, _, place in rows:
        text = left + right
        for at in range(len(text) - length + 1):
            want[text[at : at + length], len(left) - at].add(i)
    ready, found = divide(frame, length, reach, 1, 2)
    covered = defaultdict(set)
    for node, _, begin, end in found.collect():
        covered[node] |= set(range(begin, end - length + 1))
    met = defaultdict(set)
    for r in ready.collect():
        text = bytes(r.left + r.right)
        for at in range(len(text) - length + 1):
            met[text[at : at + length], len(r.left) - at, bytes(r.lead)].add(r.node)
    together = defaultdict(set)
    for (text, back, _), nodes in met.items():
        together[text, back] |= nodes if len(nodes) > 1 else set()
    for (text, back), nodes in want.items():
        for node in nodes:
            repeated = 100 - back in covered[node] or node in together[text, back]
            assert repeated == (len(nodes) > 1)
