import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from leafscan.functions.glob import fold, pattern_grams, wrap_substring
from leafscan.operators import grams as G
from leafscan.operators.candidates import candidates, look_up
from leafscan.plans import batch, listing, search as S, sql
from leafscan.plans.build import ingest_texts
from leafscan.sources.tables import ensure_tables

from tests.pages import TITLES, page
from tests.test_patterns import brute_glob


def names(result, block):
    return {r.name for r in result.collect() if r["pass"] == block}


# Page names in the sessions that the next two tests follow.
def test_golden_substring_search(small_index):
    result = S.search(small_index, "socket")
    assert names(result, 0) >= {
        "socket.7", "systemd.socket.5", "socketcall.2", "socket.2", "socketpair.2", "tipc-socket.8",
        "systemd-socket-proxyd.8",
    }
    assert names(result, 1) >= {"packet.7", "unix.7", "raw.7", "connect.2", "ss.8", "udp.7", "netstat.8"}
    assert not names(result, 0) & names(result, 1) and "Socket.9" not in names(result, 0)
    lines = [r.line for r in listing.aligned_blocks(result).orderBy("pass", "rank").collect()]
    assert "systemd-socket-proxyd.8 - systemd-socket-proxyd - Bidirectionally proxy local soc" in lines
    assert S.any_match(result).first().any_match and S.status(result).first().status == "content matches:"


def test_golden_regex_search(small_index):
    result = S.search(small_index, "system_[^_]*_types", is_re=True)
    assert names(result, 0) == {"system_data_types.7"}
    assert names(result, 1) >= {"FILE.3", "time_t.3", "ftm.7", "va_list.3"}
    assert {r.score for r in result.collect()} == {0.0}


def test_nothing_found(small_index):
    for pattern, is_re in (("no such text", False), ("(", True), ("[a", False)):
        result = S.search(small_index, pattern, is_re)
        assert result.count() == 0 and result.columns == ["name", "description", "pass", "rank", "score"]
        assert not S.any_match(result).first().any_match
        assert S.status(result).first().status == "no results"


def test_names_without_contents_say_no_results(small_index):
    result = S.search(small_index, "FILE.3")
    assert names(result, 0) == {"FILE.3"} and S.status(result).first().status == "no results"


def test_list_and_count(small_index):
    listed = [tuple(r) for r in listing.list_pages(small_index).collect()]
    assert listed == sorted(TITLES.items()) and listing.count_pages(small_index).first()[0] == len(TITLES)
    width = max(len(name) for name in TITLES)
    lines = [r.line for r in listing.aligned(listing.list_pages(small_index)).collect()]
    assert sorted(lines) == sorted(f"{n:{width}} - {d:.55}" for n, d in TITLES.items())


def test_anti_join_follows_the_limit(spark, tmp_path):
    folder = str(tmp_path)
    ensure_tables(spark, folder)
    pages = [page(f"needle{i:02}.1", f"needle{i:02} - x", "the needle") for i in range(30)]
    index = ingest_texts(spark, spark.createDataFrame(pages, "path string, raw string"), folder)
    result = S.search(index, "needle", k=25)
    # equal scores: both blocks rank the same rows, so the second one is emptied
    assert len(names(result, 0)) == 25 and not names(result, 1)
    # by content alone every row may come
    assert len(names(S.search(index, "the needle", k=25), 1)) == 25
    ranks = [r["rank"] for r in result.collect()]
    assert ranks == list(range(1, 26))


TEXTS = [
    ("", ""), ("a", "b"), ("ab", "cde"), ("abc", "abcabcabc"), ("ΣΑΣ", "aΣb σας ΣΑΣ"), ("İi", "xİyİz"),
    ("\U0001f600\U0001f601\U0001f602", "a\nb\nc d"), ("Socket", "socket SOCKET sOcKeT"), ("aaaa", "aaaaaaa"),
]


def brute_grams(text):
    folded = fold(text)
    return [folded[i : i + 3] for i in range(len(folded) - 2)]


@pytest.fixture
def texts(spark):
    rows = [(i, *pair) for i, pair in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "row_id long, name string, content string").repartition(3)


def test_gram_index_against_brute_force(texts):
    want = {i: Counter(brute_grams(n) + brute_grams(c)) for i, (n, c) in enumerate(TEXTS)}
    tf = {(i, g): n for i, counted in want.items() for g, n in counted.items()}
    length = {i: counted.total() for i, counted in want.items()}
    occurrences = Counter((r.row_id, r.gram) for r in G.trigrams(texts).collect())
    assert occurrences == tf
    posted = G.postings(texts)
    assert {(r.row_id, r.gram): (r.tf, r.n_grams) for r in posted.collect()} == {
        key: (n, length[key[0]]) for key, n in tf.items()
    }
    assert {r.gram: r.df for r in G.gram_df(posted).collect()} == Counter(g for _, g in tf)
    assert {r.row_id: r.n_grams for r in G.doc_stats(texts).collect()} == length
    totals = G.corpus_stats(G.doc_stats(texts)).first()
    assert (totals.n_rows, totals.n_grams) == (len(TEXTS), sum(length.values()))


BODIES = [
    "Socket programming", "a socket", "sockets and more sockets", "the end\n", "end the", "theend", "ΣΑΣ ΟΔΟΣ",
    "x*y", "abc[d]", "abcabcabcabc", "one two three four", "THE END", "", "ab",
]
QUERIES = ["socket", "Socket", "the end", "end*the", "the*end\n*", "ΑΣ ΟΔ", "ΟΔΟΣ", "abcabc", "abc[[]d", "t?o th", "nothing", "[a-c]bc", "", "e", "?"]
PATTERN_REGEXES = ["^a", r"\bsock", "(", "e$", "[oΟ]"]


@pytest.fixture(scope="module")
def bodies_index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bodies"))
    ensure_tables(spark, folder)
    # names repeat, and the pages come in two batches
    rows = [(f"/r{i:02}/man1/n{i % 5}.1.gz", text) for i, text in enumerate(BODIES)]
    for part in (rows[:9], rows[9:]):
        index = ingest_texts(spark, spark.createDataFrame(part, "path string, raw string"), folder)
    return index


def brute_search(pattern, k):
    """The ranking worked out row by row: (pass, rank, name, score)."""
    glob = wrap_substring(pattern)
    rows = [(i + 1, i % 5 + 1, f"n{i % 5}.1", text) for i, text in enumerate(BODIES)]
    counted = {row: Counter(brute_grams(name) + brute_grams(text)) for row, _, name, text in rows}
    length = {row: c.total() for row, c in counted.items()}
    average = sum(length.values()) / len(rows)
    df = Counter(g for c in counted.values() for g in c)

    def score(row):
        total = 0.0
        for gram in pattern_grams(glob):
            idf = max(math.log((len(rows) - df[gram] + 0.5) / (df[gram] + 0.5)), 0) or 1e-6
            tf = counted[row][gram]
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[row] / average))
        return -round(total, 9) + 0.0

    blocks = []
    for side in (2, 3):
        hits = sorted((score(r[0]), r[1], r[0], r[2]) for r in rows if brute_glob(glob, r[side]))
        blocks.append(hits[:k])
    shown = {hit[3] for hit in blocks[0]}
    blocks[1] = [hit for hit in blocks[1] if hit[3] not in shown]
    return [(p, n, hit[3], hit[0]) for p, block in enumerate(blocks) for n, hit in enumerate(block, 1)]


def ranking(rows):
    return sorted((r["pass"], r["rank"], r["name"], round(r["score"], 9)) for r in rows)


@pytest.mark.parametrize("selective", [0, 64])
@pytest.mark.parametrize("pattern", QUERIES)
def test_search_against_brute_force(bodies_index, monkeypatch, pattern, selective):
    """With 0 the postings answer, with 64 this small table is always scanned."""
    monkeypatch.setattr(S, "SELECTIVE", selective)
    assert ranking(S.search(bodies_index, pattern, k=4).collect()) == brute_search(pattern, 4)


def test_candidates_hold_every_match(bodies_index):
    for pattern in QUERIES:
        glob = wrap_substring(pattern)
        grams = pattern_grams(glob)
        if grams:
            found = look_up(bodies_index, grams)
            kept = {r.row_id for r in candidates(bodies_index, found).collect()}
            assert kept >= {i + 1 for i, text in enumerate(BODIES) if brute_glob(glob, text)}
            assert len(kept) <= found.bound


@pytest.mark.parametrize("selective, broadcast", [(0, 500_000), (0, 0), (64, 500_000)])
def test_batch_against_brute_force(spark, bodies_index, monkeypatch, selective, broadcast):
    """With a broadcast limit of 0 every join takes its shuffled form."""
    monkeypatch.setattr(batch, "SELECTIVE", selective)
    monkeypatch.setattr(batch, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(batch, "SCAN_PATTERNS", 4)
    patterns = [(p, False) for p in QUERIES] + [(p, True) for p in PATTERN_REGEXES]
    rows = [(i, p, r) for i, (p, r) in enumerate(patterns)]
    queries = spark.createDataFrame(rows, "query_id long, pattern string, is_re boolean")
    got = {}
    for row in batch.search_batch(bodies_index, queries, k=4).collect():
        got.setdefault(row["query_id"], []).append(row)
    for query_id, pattern, is_re in rows:
        if is_re:
            want = ranking(S.search(bodies_index, pattern, is_re, k=4).collect())
        else:
            want = brute_search(pattern, 4)
        assert ranking(got.get(query_id, [])) == want, pattern


@pytest.mark.parametrize("n_bytes, n_scans", [(1 << 20, 1), (400, 2)])
def test_many_needles_take_few_scans(spark, bodies_index, monkeypatch, n_bytes, n_scans):
    """Needles with and without grams, with repeats, all by automata; the rest as ever."""
    monkeypatch.setattr(batch, "SELECTIVE", 1 << 40)
    monkeypatch.setattr(batch, "MANY_NEEDLES", 0)
    monkeypatch.setattr(batch, "NEEDLE_BYTES", n_bytes)
    made, scans = [], batch.needle_scans

    def counted(*given):
        found = scans(*given)
        made.append(len(found))
        return found

    monkeypatch.setattr(batch, "needle_scans", counted)
    patterns = [*QUERIES, *QUERIES, "", "e", "a", "s*e", "\u00e9", "\U0001f600"]
    queries = spark.createDataFrame([(i, p, False) for i, p in enumerate(patterns)], "query_id long, pattern string, is_re boolean")
    got = {}
    for row in batch.search_batch(bodies_index, queries, k=4).collect():
        got.setdefault(row["query_id"], []).append(row)
    for query_id, pattern in enumerate(patterns):
        assert ranking(got.get(query_id, [])) == brute_search(pattern, 4), pattern
    assert len(made) == 1 and (made == [1] if n_scans == 1 else made[0] >= n_scans)


def test_sql_functions_and_parameters(spark, small_index):
    sql.register_functions(spark)
    sql.register_tables(small_index)
    found = sql.query(spark, "SELECT name FROM page WHERE regexp_match(:p, name) ORDER BY name", p="^socket\\.")
    assert [r.name for r in found.collect()] == ["socket.2", "socket.7"]
    with pytest.raises(PySparkException):
        spark.sql("SELECT regexp_match('a')")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan and "Python" not in plan


def test_search_prunes_and_pushes(small_index, monkeypatch):
    monkeypatch.setattr(S, "SELECTIVE", 0)
    plan = S.search(small_index, "socket")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(content,socket)" in plan and "WindowGroupLimit" in plan
    assert "In(gram, [" in plan and "bucket" in plan.split("PartitionFilters")[-1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_needle_scans_score_without_reading_texts_again(spark, small_index, monkeypatch):
    """One hit for each row of a query id, scored as a single search scores it."""
    from leafscan.plans import batch
    from leafscan.plans.search import search

    patterns = ["socket", "ock", "the", "so", "aaa"]
    rows = [(i, pattern, False) for i, pattern in enumerate(patterns)]
    queries = spark.createDataFrame(rows, "query_id long, pattern string, is_re boolean")
    monkeypatch.setattr(batch, "MANY_NEEDLES", 0)
    monkeypatch.setattr(batch, "SELECTIVE", 1 << 40)
    monkeypatch.setattr(batch, "score_in_place", None)
    found = {}
    for row in batch.search_batch(small_index, queries).collect():
        found.setdefault(row.query_id, set()).add(tuple(row)[1:])
    for number, pattern, _ in rows:
        assert found.get(number, set()) == set(map(tuple, search(small_index, pattern).collect())), pattern
    assert any(score < 0 for hits in found.values() for *_, score in hits)
