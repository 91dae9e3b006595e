"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.corpus import (
    catalogue,
    catalogue_folder,
    document_texts,
    new_folder,
    page_source,
    page_sources,
    table,
    word,
    write_named_files,
    write_page_files,
)
from leafscan.functions.glob import glob_match, pattern_grams, wrap_substring
from leafscan.functions.regex import regex_match
from leafscan.functions.text import (
    checked_text,
    description,
    page_name,
    plain_text,
    section_and_mtime,
    shorten,
)
from leafscan.operators import grams
from leafscan.operators.candidates import candidates as candidate_rows
from leafscan.operators.candidates import look_up
from leafscan.operators.pages import assign_ids, insert_pages, lookup_id, text_rows
from leafscan.plans import listing, sql
from leafscan.plans.batch import compile_globs, glob_match_column, search_batch
from leafscan.plans.build import build, ingest_texts
from leafscan.plans.merge import merge_batches, remove_merged
from leafscan.plans.search import found_any, search, status
from leafscan.session import spread
from leafscan.sources.files import decode_all, discover
from leafscan.sources.tables import Index, ensure_tables, footprint, load_index
from leafscan.streaming.ingest import ingest_available

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Patterns of the queries below and of their SQL.
NAME_GLOBS = {"starts": "blue*", "ends": "*bolt", "holds": "*d w*", "single": "r?d *", "exact": "red widget"}
CLASS_GLOBS = {
    "ranged": "[a-c]*",
    "negated": "*[^a-z ]*",
    "bracket": "*[]x]*",
    "digits": "*ring[0-9]*",
    "unclosed": "[a-",
    "reversed": "[r-b]*",
}
TEXT_GLOBS = {"plain": "thou", "starred": "*the*on the*", "upper": "THOU", "empty": "", "dotted": "e.\n"}
NAME_REGEXES = {"either": "^(?:red|blue) ", "tail": "(?P<last>t|g)$", "two_words": r"^\w+\s\w+$", "none": "^$"}
TEXT_REGEXES = {
    "repeat": r"(?:ha){3,}",
    "word": r"\bthou\b",
    "accent": r"[éèê]{2}",
    "line": r"(?m)^[A-Z]\w+\.$",
    "fold": r"(?i)THOU",
    "chosen": r"(?:\w|\s)*zzzz",
}
# Patterns that a matcher which tries one way after the other does not finish, or not in
# time, and what only some engines have.
HOSTILE_REGEXES = {
    "choices": r"(?:ab|c|\w\s?)*zzzz",
    "nested": r"^(?:a+)+$",
    "tail": r"(ab|c)*x",
    "words": r"^(?:\w+[\s.,]*)*$",
    "twice": r"(?:[a-z]+ ?)+(?:\.\s*)+[A-Z]\w*\.(?:\s|$)",
    "optional": r"(?:e?){20}e{20}",
    "difference": r"[a-z--[aeiou]]{4}",
    "common": r"\b[\w&&[^\d]]{2}[a-m~~h-z]\b",
}
# Patterns of rows: by the remainder of the part's key.
ROW_REGEXES = ("(", "a(?=b)", r"^\w+ (?:\w|-)+$", "(?i)RED|É", r"(?:[a-z]+\s?){2}t$")
ROW_GLOBS = ("*e*[r-t]", "[^a-m]*", "[a-", "*d w?dget", "")
RARE, COMMON, NAMED = "hahahe", "thou", "nth"
FLAGGED = (RARE, NAMED, "no such text")


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def flags(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    return df.select(key, *(test.alias(name) for name, test in tests.items()))


def ranked(result: DataFrame) -> DataFrame:
    return result.withColumn("score", F.round("score", 9))


@registered
def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.count_pages(catalogue(spark, sf_dir))


@registered
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_pages(catalogue(spark, sf_dir))


@registered
def aligned_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.aligned(listing.list_pages(catalogue(spark, sf_dir)))


@registered
def describe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text stands in the NAME section, so all of its lines are joined."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    whole = description(checked_text(page_source(F.col("text"))))
    constant, mtime = section_and_mtime(False, F.col("source"), None)
    described = documents.select(
        "doc_id", whole.alias("description"), constant.alias("section"), mtime.alias("last_modified")
    )
    return described.withColumn("shown", shorten(F.col("description")))


@registered
def undescribed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a NAME section have the empty description."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", description(F.col("text")).alias("description"))


@registered
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        page_name(url).alias("plain"),
        page_name(F.concat(url, F.lit(".gz.gz"))).alias("zipped"),
        page_name(F.concat(url, F.lit("gz"))).alias("undotted"),
    )


@registered
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", plain_text(F.col("html")).alias("text"))


@registered
def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: glob_match(F.col("p_name"), glob) for name, glob in NAME_GLOBS.items()}
    return flags(table(spark, sf_dir, "part"), "p_partkey", tests)


@registered
def glob_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: glob_match(F.col("p_name"), glob) for name, glob in CLASS_GLOBS.items()}
    return flags(table(spark, sf_dir, "part"), "p_partkey", tests)


@registered
def glob_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: glob_match(F.col("text"), wrap_substring(g)) for name, g in TEXT_GLOBS.items()}
    return flags(table(spark, sf_dir, "documents"), "doc_id", tests)


@registered
def regex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: regex_match(spark, F.col("p_name"), p) for name, p in NAME_REGEXES.items()}
    return flags(table(spark, sf_dir, "part"), "p_partkey", tests)


@registered
def regex_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: regex_match(spark, F.col("text"), p) for name, p in TEXT_REGEXES.items()}
    return flags(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", tests)


@registered
def regex_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns outside the dialect match nothing and do not fail."""
    bad = {"unclosed": "(", "ahead": "a(?=b)", "again": r"(a)\1", "nothing": "*a"}
    tests = {name: regex_match(spark, F.col("text"), p) for name, p in bad.items()}
    return flags(table(spark, sf_dir, "documents"), "doc_id", tests)


@registered
def regex_hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {name: regex_match(spark, F.col("text"), p) for name, p in HOSTILE_REGEXES.items()}
    return flags(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", tests)


def _of_row(values: tuple[str, ...]) -> Column:
    """One of the values for each part, by its key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


@registered
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both match functions with patterns of the rows, some of them invalid, and bound ones."""
    sql.register_functions(spark)
    part = table(spark, sf_dir, "part").withColumns({"re": _of_row(ROW_REGEXES), "gl": _of_row(ROW_GLOBS)})
    part.createOrReplaceTempView("part_patterns")
    return sql.query(
        spark,
        "SELECT p_partkey, regexp_match(re, p_name) AS by_regex, glob_match(gl, p_name) AS by_glob, "
        "regexp_match(:bad, p_name) AS bad, glob_match(:glob, p_name) AS fixed FROM part_patterns",
        bad="(a)\\1",
        glob="*[^a-z ]*w*",
    )


@registered
def regexp_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function, with a constant pattern and with one from the row."""
    sql.register_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return sql.query(
        spark,
        "SELECT p_partkey, regexp_match(:pattern, p_name) AS fixed, "
        "regexp_match(concat('^', substring_index(p_name, ' ', 1), ' [b-r]'), p_name) AS own FROM part",
        pattern="e[dt] ?",
    )


@registered
def glob_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs that come with the rows: each part's brand digits and name as a pattern."""
    part = table(spark, sf_dir, "part")
    first, letter = F.substring_index("p_name", " ", 1), F.lower(F.substring("p_type", 2, 1))
    pattern = F.concat(first, F.lit("* [a-"), letter, F.lit("]?")).alias("pattern")
    queries = part.select(F.col("p_partkey").alias("query_id"), pattern)
    compiled = compile_globs(queries).join(part, F.col("query_id") == F.col("p_partkey"))
    return glob_match_column(compiled, "p_name").select("p_partkey", "p_name")


@registered
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    page = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return lookup_id(page, page)


@registered
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows joined to their pages by id."""
    index = catalogue(spark, sf_dir)
    fts = index.fts.select("row_id", "id", F.col("name").alias("text_name"), F.md5("content").alias("digest"))
    return fts.join(index.page.select("id", "name", "description", "path"), "id")


@registered
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under few paths, some taken by web pages; a document without a word is ignored."""
    source_path = F.concat_ws("/", F.lit(""), F.col("source"), F.col("lang"))
    name = F.nullif(word(), F.lit(""))
    new = table(spark, sf_dir, "documents").select(
        source_path.alias("path"), name.alias("name"), "doc_id"
    )
    taken = F.concat(F.lit("/src"), F.col("page_id"), F.lit("/en")).alias("path")
    return insert_pages(new, table(spark, sf_dir, "pages").select(taken), ["doc_id"])


@registered
def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "p_name", "p_partkey").alias("path")
    part = spread(table(spark, sf_dir, "part"), "p_partkey").select(key)
    return assign_ids(part, 1000)


@registered
def shared_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of few names: texts go to the first page of their name."""
    path = F.concat_ws("/", "p_name", "p_partkey").alias("path")
    named = table(spark, sf_dir, "part").withColumnsRenamed({"p_partkey": "id", "p_name": "name"})
    pages = named.select("id", "name", F.col("p_type").alias("description"), F.concat_ws("/", "name", "id").alias("path"))
    texts = table(spark, sf_dir, "part").select(path, F.col("p_name").alias("name"), F.col("p_brand").alias("content"))
    return text_rows(pages, texts).select("path", "id", "name", "description", "content")


@registered
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = grams.trigrams(document_texts(spark, sf_dir))
    return occurrences.groupBy("gram").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )


@registered
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.postings(document_texts(spark, sf_dir))


@registered
def gram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.gram_df(grams.postings(document_texts(spark, sf_dir)))


@registered
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.doc_stats(document_texts(spark, sf_dir))


@registered
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = grams.corpus_stats(grams.doc_stats(document_texts(spark, sf_dir)))
    return stats.withColumn("avg_grams", F.round("avg_grams", 6))


@registered
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = catalogue(spark, sf_dir)
    found = candidate_rows(index, look_up(index, pattern_grams(wrap_substring(COMMON))))
    return ranked(found.select("row_id", "score"))


@registered
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(catalogue(spark, sf_dir), RARE))


@registered
def two_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(catalogue(spark, sf_dir), NAMED))


@registered
def common_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(catalogue(spark, sf_dir), COMMON))


@registered
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(catalogue(spark, sf_dir), "and?the*[aeiou]sh"))


@registered
def short_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too short for a gram: a full scan, ordered by id."""
    return ranked(search(catalogue(spark, sf_dir), "Th"))


@registered
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(catalogue(spark, sf_dir), r"^[A-M]\w*(?:th|ou)[a-z]*\.[0-9]$|(?:ha){3}", True))


@registered
def regex_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regex whose literals are rare: answered through the postings."""
    return ranked(search(catalogue(spark, sf_dir), r"(?:\w+ )*(?:ha){2}he\w*\b|qq[0-9]+zz", True))


@registered
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.aligned_blocks(search(catalogue(spark, sf_dir), NAMED))


@registered
def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = catalogue(spark, sf_dir)
    found = [found_any(index, p).withColumn("pattern", F.lit(p)) for p in FLAGGED]
    return reduce(DataFrame.unionByName, found)


@registered
def block_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = catalogue(spark, sf_dir)
    found = [status(search(index, p)).withColumn("pattern", F.lit(p)) for p in FLAGGED]
    return reduce(DataFrame.unionByName, found)


@registered
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items as substrings, short substrings and regexes."""
    kind = F.col("item_id") % 5
    words = F.split("text", " ")
    second, third = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    pattern = (
        F.when(kind == 0, F.concat(F.lit("[a-z]"), F.substring(second, 1, 4)))
        .when(kind == 1, F.substring(second, 1, 2))
        .when(kind == 2, second)
        .otherwise(F.concat_ws(" ", second, third))
    )
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), pattern.alias("pattern"), (kind == 0).alias("is_re")
    )
    return ranked(search_batch(catalogue(spark, sf_dir), queries))


@registered
def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two and every three letters that a word of the benchmark items begins with."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    starts = words.select(F.explode(F.array(F.left("word", F.lit(2)), F.left("word", F.lit(3)))).alias("pattern"))
    starts = starts.where(F.rlike("pattern", F.lit("^[a-z]{2,3}$"))).distinct()
    number = sum(F.ascii(F.substring("pattern", i + 1, 1)) * 256**i for i in range(3))
    queries = starts.select(number.cast("long").alias("query_id"), "pattern", F.lit(False).alias("is_re"))
    found = search_batch(catalogue(spark, sf_dir), queries)
    # scores are whole multiples of 1e-12; a fifth of that settles ties of the rounding
    return found.withColumn("score", F.when(F.col("score") < 0, F.round(F.col("score") - 2e-13, 9)).otherwise(F.lit(0.0)))


@registered
def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register_tables(catalogue(spark, sf_dir))
    return sql.query(
        spark,
        "SELECT fts.name, count(*) AS n, min(page.id) AS first_id FROM fts JOIN page ON page.id = fts.id "
        "WHERE contains(fts.content, :word) AND page.section = :section GROUP BY fts.name",
        word="thou",
        section=1,
    )


def _sizes(index: Index) -> DataFrame:
    def size(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.max(key).alias("last"))

    return size(index.page, "page", "id").unionByName(size(index.fts, "fts", "row_id"))


@registered
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creating the tables again leaves the rows that are in them."""
    folder = new_folder(spark)
    ensure_tables(spark, folder)
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    ingest_texts(spark, page_sources(documents), folder)
    ensure_tables(spark, folder)
    index = load_index(spark, folder)
    return _sizes(index)


def _named(index: Index) -> DataFrame:
    """Each page with its own text, and a row with the number of damaged files."""
    fts = index.fts.select("id", F.md5("content").alias("digest"))
    pages = index.page.join(fts, "id").select("name", "description", "digest", "section")
    dropped = [("damaged", str(index.n_dropped), "", 0)]
    return pages.unionByName(index.spark.createDataFrame(dropped, pages.schema))


@registered
def named_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of fixed names, some hidden and some damaged, built twice: each page with its text."""
    root, folder = new_folder(spark), new_folder(spark)
    write_named_files(table(spark, sf_dir, "documents"), root)
    build(spark, [root, f"{root}/"], folder, derive=True)
    return _named(build(spark, [root], folder, derive=True))


@registered
def named_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by stream: odd documents arrive first, then all; damaged ones count once."""
    root, folder, progress = (new_folder(spark) for _ in range(3))
    documents = table(spark, sf_dir, "documents")
    write_named_files(documents.where("doc_id % 2 = 1"), root)
    ingest_available(spark, [root], folder, progress)
    write_named_files(documents.where("doc_id % 2 = 0"), root)
    ingest_available(spark, [root], folder, progress)
    ingest_available(spark, [root], folder, progress)
    return _named(load_index(spark, folder))


def _merged(spark: SparkSession, sf_dir: str) -> Index:
    """A catalogue of all documents, built language by language and merged."""
    folder = new_folder(spark)
    ensure_tables(spark, folder)
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    lang = F.coalesce("lang", F.lit(""))
    for part in (lang == "en", lang == "de", ~lang.isin("en", "de")):
        ingest_texts(spark, page_sources(documents.where(part)), folder)
    index = merge_batches(spark, folder, ratio=float("inf"))
    remove_merged(spark, folder)
    return index


@registered
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each gram and each path, from batches that were merged into one."""
    index = _merged(spark, sf_dir)
    pages = index.page.select(F.lit("page").alias("part"), F.col("path").alias("key"), F.lit(1).cast("long").alias("n"))
    lists = index.gram_df.select(F.lit("gram").alias("part"), F.col("gram").alias("key"), F.col("df").alias("n"))
    return pages.unionByName(lists)


@registered
def compressed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored texts, read back in place."""
    fts = catalogue(spark, sf_dir).fts
    return fts.groupBy("name").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("n_bytes")
    )


@registered
def stored_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes depend on the codec, so the SQL checks the raw bytes and a bound."""
    size = footprint(spark, catalogue_folder(spark, sf_dir))
    return size.select("raw_bytes", (F.col("ratio") < 2).alias("under_twice"))


@registered
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_page_files(table(spark, sf_dir, "documents"), root)
    found = discover(spark, [root, root, f"{root}/absent"])
    folder = F.regexp_extract("path", "/man=([0-9]+)/", 1).cast("long").alias("section")
    return found.groupBy(folder).agg(F.count("*").alias("n_files"))


@registered
def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_page_files(table(spark, sf_dir, "documents"), root)
    decoded = decode_all(discover(spark, [root]))
    return decoded.groupBy(F.md5("raw").alias("digest")).agg(F.count("*").alias("n_files"))


def _contents(index: Index) -> DataFrame:
    """How often each description and each content is stored.

    The two are not paired: the files' names repeat, and equal names share a description.
    """
    def tally(df: DataFrame, part: str, value: Column) -> DataFrame:
        counted = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        return counted.withColumn("part", F.lit(part))

    pages = tally(index.page, "page", F.col("description"))
    return pages.unionByName(tally(index.fts, "fts", F.md5("content")))


@registered
def full_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, folder = new_folder(spark), new_folder(spark)
    write_page_files(table(spark, sf_dir, "documents"), root)
    return _contents(build(spark, [root], folder))


@registered
def repeated_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building again adds nothing; the faithful form adds each text once more."""
    root, folder = new_folder(spark), new_folder(spark)
    write_page_files(table(spark, sf_dir, "documents"), root)
    build(spark, [root], folder)
    build(spark, [root], folder)
    index = build(spark, [root], folder, faithful=True)
    return _sizes(index)


@registered
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents arrive first, the others after the first run."""
    first, second, folder, progress = (new_folder(spark) for _ in range(4))
    documents = table(spark, sf_dir, "documents")
    write_page_files(documents.where("lang = 'en'"), first)
    ingest_available(spark, [first, second], folder, progress)
    write_page_files(documents.where("lang <> 'en' OR lang IS NULL"), second)
    ingest_available(spark, [first, second], folder, progress)
    ingest_available(spark, [first, second], folder, progress)
    return _contents(load_index(spark, folder))

