"""For each registered query the SQL that must give the same rows."""

from __future__ import annotations

from contract.queries import (
    COMMON,
    FLAGGED,
    NAME_GLOBS,
    NAMED,
    RARE,
)
from leafscan.functions.text import BLOCK, DOCTYPE, ENTITIES, HIDDEN, INLINE

# The characters Unicode calls whitespace, as members of a class.
SPACE = (
    r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The categories of word characters, as members of a class.
WORD_CHARS = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}"
LETTERS = r"\pL\pM\p{Nl}\p{Pc}"


def text(value: str) -> str:
    """SQL literal."""
    quoted = value.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"('{quoted}')"


def replaced(expr: str, pattern: str, put: str) -> str:
    return f"regexp_replace({expr}, {text(pattern)}, {text(put)}, 'g')"


def plain(expr: str) -> str:
    out = f"replace({replaced(expr, r'(?s).\x08', '')}, chr(8), '')"
    for pattern, put in ((HIDDEN, ""), (DOCTYPE, ""), (BLOCK, "\n"), (INLINE, "")):
        out = replaced(out, pattern, put)
    for entity, char in ENTITIES:
        out = f"replace({out}, {text(entity)}, {text(char)})"
    return out


def described(expr: str) -> str:
    found = f"regexp_extract({expr}, '(?s)NAME(.*?)\\n\\n', 1)"
    trimmed = replaced(found, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    joined = replaced(trimmed, rf"\n([^{SPACE}])", r"\1")
    return replaced(joined, rf"[{SPACE}][{SPACE}]+", " ")


def folded(expr: str) -> str:
    return f"replace(lower(replace({expr}, 'İ', 'i')), 'ς', 'σ')"


def source(body: str) -> str:
    return (
        "lang || '(' || doc_id || ')' || chr(10) || chr(10) || 'NAME' || chr(10) || '       ' || source "
        f"|| '.' || doc_id || ' - ' || {body} || chr(10) || chr(10) || 'DESCRIPTION' || chr(10) || text"
    )


FIRST_LINE = "split_part(text, chr(10), 1)"
SECTION = "(1 + doc_id % 8)"
WORD = "regexp_extract(text, '[A-Za-z]+')"

# The catalogue of all documents: pages numbered by path, texts under the first page of
# their name.
PAGES = f"""
raw AS MATERIALIZED (SELECT '/corpus/' || source || '/' || doc_id || '/man' || {SECTION} || '/' || {WORD} || '.'
    || {SECTION} || '.gz' AS path, {WORD} || '.' || {SECTION} AS name, {plain(source(FIRST_LINE))} AS content
  FROM documents),
page AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path) AS id, name, {described("content")} AS description,
    path, content FROM raw),
fts AS MATERIALIZED (SELECT page.id AS row_id, first.id, page.name, first.description, page.content
  FROM page JOIN (SELECT name, min(id) AS id, arg_min(description, id) AS description FROM page GROUP BY name) first
  ON page.name = first.name)"""


def gram_tables(rows: str) -> str:
    """Postings, document frequencies and totals of rows ``(row_id, name, content)``."""
    return f"""
parts AS (SELECT row_id, 0 AS part, {folded("name")} AS t FROM {rows}
  UNION ALL SELECT row_id, 1, {folded("content")} FROM {rows}),
chars AS (SELECT row_id, part, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i
  FROM parts),
grams AS MATERIALIZED (SELECT row_id, c || lead(c) OVER w || lead(c, 2) OVER w AS gram FROM chars
  WINDOW w AS (PARTITION BY row_id, part ORDER BY i)),
doc AS MATERIALIZED (SELECT row_id, sum(greatest(length(t) - 2, 0))::BIGINT AS n_grams FROM parts GROUP BY row_id),
postings AS MATERIALIZED (SELECT gram, row_id, count(*) AS tf, any_value(n_grams) AS n_grams
  FROM grams JOIN doc USING (row_id) WHERE gram IS NOT NULL GROUP BY gram, row_id),
gram_df AS MATERIALIZED (SELECT gram, count(*) AS df FROM postings GROUP BY gram),
totals AS (SELECT count(*) AS n_rows, sum(n_grams)::BIGINT AS n_grams, avg(n_grams) AS avg_grams FROM doc)"""


def scored(pairs: str) -> str:
    """Score of every ``(query_id, row_id)`` whose grams, with their repeats, are all there."""
    return f"""
wanted AS (SELECT query_id, gram, count(*) AS repeats FROM {pairs} GROUP BY query_id, gram),
weighed AS (SELECT query_id, gram, repeats * CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0
    THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS weight
  FROM wanted JOIN gram_df USING (gram), totals),
scored AS MATERIALIZED (SELECT query_id, row_id, -(sum(floor(weight * (tf * 2.2) / (tf + 1.2 * (0.25
    + 0.75 * postings.n_grams / avg_grams)) * 1e12 + 0.5)::BIGINT)::DOUBLE / 1e12) AS score
  FROM postings JOIN weighed USING (gram), totals GROUP BY query_id, row_id
  HAVING count(*) = (SELECT count(*) FROM wanted WHERE wanted.query_id = weighed.query_id))"""


BLOCKS = """
top AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, pass ORDER BY score, id, row_id) <= 25),
kept AS (SELECT * FROM top WHERE pass = 0 UNION ALL SELECT * FROM top WHERE pass = 1
  AND (query_id, name) NOT IN (SELECT (query_id, name) FROM top WHERE pass = 0)),
blocks AS (SELECT query_id, name, description, pass,
    row_number() OVER (PARTITION BY query_id, pass ORDER BY score, id, row_id) AS rank, round(score, 9) AS score
  FROM kept)"""


def literal_grams(pattern: str) -> str:
    grams = [pattern[i : i + 3].lower() for i in range(len(pattern) - 2)]
    rows = ", ".join(f"(0, {text(gram)})" for gram in grams)
    return f"(VALUES {rows}) AS pattern(query_id, gram)"


def hits(test: str, score: str = "scored.score", scores: str = "JOIN scored USING (row_id)") -> str:
    """Rows whose name or content passes a test written for ``{0}``."""
    sides = [
        f"SELECT 0 AS query_id, row_id, id, name, description, {place} AS pass, {score} AS score "
        f"FROM fts {scores} WHERE {test.format(side)}"
        for place, side in enumerate(("fts.name", "fts.content"))
    ]
    return f"hits AS ({' UNION ALL '.join(sides)})"


def search(pattern: str, test: str, grams: str | None = None) -> str:
    pairs = grams or literal_grams(pattern)
    return (
        f"WITH {PAGES}, {gram_tables('fts')}, {scored(pairs)}, {hits(test)}, {BLOCKS} "
        "SELECT name, description, pass, rank, score FROM blocks"
    )


def contains(pattern: str) -> str:
    return f"contains({{0}}, {text(pattern)})"


def unscored(test: str) -> str:
    return (
        f"WITH {PAGES}, {hits(test, '0.0::DOUBLE', '')}, {BLOCKS} "
        "SELECT name, description, pass, rank, score FROM blocks"
    )


def columns(tests: dict[str, str]) -> str:
    return ", ".join(f"{test} AS {name}" for name, test in tests.items())


def regexes(column: str, patterns: dict[str, str]) -> str:
    return columns({name: f"regexp_matches({column}, {text(p)})" for name, p in patterns.items()})


WIDTH = "(SELECT coalesce(max(strlen(name)), 1) FROM page)::INTEGER"
DOCUMENT_ROWS = "docs AS (SELECT doc_id AS row_id, source AS name, text AS content FROM documents)"
STORED = (
    "SELECT 'page' AS part, description AS value, count(*) AS n FROM named GROUP BY ALL "
    "UNION ALL SELECT 'fts', md5(content), count(*) FROM named GROUP BY ALL"
)
FLAG_ROWS = ", ".join(f"({text(pattern)})" for pattern in FLAGGED)

ORACLE: dict[str, str] = {
    "count_pages": "SELECT count(*) AS n_pages FROM documents",
    "list_pages": f"WITH {PAGES} SELECT name, description FROM page ORDER BY name, id",
    "aligned_listing": f"WITH {PAGES} SELECT rpad(name, {WIDTH}, ' ') || ' - ' || left(description, 55) AS line FROM page",
    "describe_pages": f"SELECT doc_id, d AS description, 1 AS section, 0::BIGINT AS last_modified, left(d, 55) AS shown "
    f"FROM (SELECT doc_id, {described(source('text'))} AS d FROM documents)",
    "undescribed_pages": f"SELECT doc_id, {described('text')} AS description FROM documents",
    "page_names": "SELECT page_id, regexp_replace(split_part(url, '/', -1), '(\\.gz)+\\z', '') AS plain, "
    "regexp_replace(split_part(url, '/', -1), '(\\.gz)+\\z', '') AS zipped, "
    "split_part(url, '/', -1) || 'gz' AS undotted FROM pages",
    "plain_pages": f"SELECT page_id, {plain('html')} AS text FROM pages",
    "glob_names": "SELECT p_partkey, "
    + columns({name: f"p_name GLOB {text(glob)}" for name, glob in NAME_GLOBS.items()})
    + " FROM part",
    "glob_class": "SELECT p_partkey, p_name GLOB '[a-c]*' AS ranged, regexp_matches(p_name, '[^a-z ]') AS negated, "
    "regexp_matches(p_name, '[]x]') AS bracket, regexp_matches(p_name, 'ring[0-9]') AS digits, "
    "false AS unclosed, starts_with(p_name, 'r') AS reversed FROM part",
    "glob_content": "SELECT doc_id, contains(text, 'thou') AS plain, "
    "regexp_matches(text, '(?s)the.*on the') AS starred, contains(text, 'THOU') AS upper, "
    "true AS empty, contains(text, 'e.' || chr(10)) AS dotted FROM documents",
    "regex_names": "SELECT p_partkey, "
    + regexes("p_name", {"either": "^(?:red|blue) ", "tail": "(t|g)$", "two_words": r"^\w+\s\w+$", "none": "^$"})
    + " FROM part",
    "regex_content": "SELECT doc_id, regexp_matches(text, '(?:ha){3,}') AS repeat, "
    r"regexp_matches(text, '(?:^|[^\pL\pM\p{Nd}\p{Pc}])thou(?:$|[^\pL\pM\p{Nd}\p{Pc}])') AS word, "
    "regexp_matches(text, '[éèê]{2}') AS accent, "
    r"regexp_matches(text, '(?m)^[A-Z][\pL\pM\p{Nd}\p{Pc}]+\.$') AS line, "
    "regexp_matches(text, '(?i)THOU') AS fold, contains(text, 'zzzz') AS chosen FROM documents",
    "regex_invalid": "SELECT doc_id, false AS unclosed, false AS ahead, false AS again, false AS nothing FROM documents",
    "regex_hostile": "SELECT doc_id, contains(text, 'zzzz') AS choices, regexp_matches(text, '^a+$') AS nested, "
    "contains(text, 'x') AS tail, "
    f"regexp_matches(text, '^(?:[{WORD_CHARS}]+[{SPACE}.,]*)*$') AS words, "
    f"regexp_matches(text, '[a-z] ?(?:\\.[{SPACE}]*)+[A-Z][{WORD_CHARS}]*\\.(?:[{SPACE}]|$)') AS twice, "
    "contains(text, repeat('e', 20)) AS optional, regexp_matches(text, '[b-df-hj-np-tv-z]{4}') AS difference, "
    f"regexp_matches(text, '(?:^|[^{WORD_CHARS}])[{LETTERS}]{{2}}[a-gn-z](?:$|[^{WORD_CHARS}])') AS common FROM documents",
    "sql_functions": "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN regexp_matches(p_name, '^[a-z0-9]+ [a-z0-9-]+$') "
    "WHEN 3 THEN regexp_matches(lower(p_name), 'red|é') WHEN 4 THEN regexp_matches(p_name, '[a-z] ?[a-z]+ ?t$') "
    "ELSE false END AS by_regex, CASE p_partkey % 5 WHEN 0 THEN regexp_matches(p_name, 'e.*[r-t]$') "
    "WHEN 1 THEN regexp_matches(p_name, '^[^a-m]') WHEN 3 THEN regexp_matches(p_name, 'd w.dget$') "
    "ELSE false END AS by_glob, false AS bad, regexp_matches(p_name, '[^a-z ].*w') AS fixed FROM part",
    "regex_index_search": unscored("(contains({0}, 'hahahe') OR regexp_matches({0}, 'qq[0-9]+zz'))"),
    "regexp_function": "SELECT p_partkey, regexp_matches(p_name, 'e[dt] ?') AS fixed, "
    "regexp_matches(p_name, '^' || split_part(p_name, ' ', 1) || ' [b-r]') AS own FROM part",
    "glob_columns": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, "
    "split_part(p_name, ' ', 1) || '.* [a-' || lower(substring(p_type, 2, 1)) || '].')",
    "lookup_ids": "SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name",
    "pages_joined": f"WITH {PAGES} SELECT fts.row_id, fts.id, fts.name AS text_name, page.name, page.description, "
    "page.path, md5(fts.content) AS digest FROM fts JOIN page ON page.id = fts.id",
    "insert_or_ignore": f"SELECT path, name, doc_id FROM (SELECT '/' || source || '/' || lang AS path, "
    f"nullif({WORD}, '') AS name, doc_id FROM documents) WHERE path IS NOT NULL AND name IS NOT NULL "
    "AND path NOT IN (SELECT '/src' || page_id || '/en' FROM pages) "
    "QUALIFY row_number() OVER (PARTITION BY path ORDER BY doc_id) = 1",
    "number_rows": "SELECT p_name || '/' || p_partkey AS path, "
    "1000 + row_number() OVER (ORDER BY p_name || '/' || p_partkey) AS id FROM part",
    "shared_text_rows": "SELECT p_name || '/' || p_partkey AS path, min(p_partkey) OVER w AS id, p_name AS name, "
    "first_value(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS description, p_brand AS content "
    "FROM part WINDOW w AS (PARTITION BY p_name)",
    "trigrams": f"WITH {DOCUMENT_ROWS}, {gram_tables('docs')} SELECT gram, count(*) AS n, min(row_id) AS first_row, "
    "max(row_id) AS last_row FROM grams WHERE gram IS NOT NULL GROUP BY gram",
    "postings": f"WITH {DOCUMENT_ROWS}, {gram_tables('docs')} SELECT gram, row_id, tf, n_grams FROM postings",
    "gram_df": f"WITH {DOCUMENT_ROWS}, {gram_tables('docs')} SELECT gram, df FROM gram_df",
    "doc_stats": "SELECT doc_id AS row_id, (greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0))::BIGINT "
    "AS n_grams FROM documents",
    "corpus_stats": "SELECT count(*) AS n_rows, sum(n)::BIGINT AS n_grams, round(avg(n), 6) AS avg_grams FROM "
    "(SELECT greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS n FROM documents)",
    "candidates": f"WITH {PAGES}, {gram_tables('fts')}, {scored(literal_grams(COMMON))} "
    "SELECT row_id, round(score, 9) AS score FROM scored",
    "bm25_search": search(RARE, contains(RARE)),
    "two_block_search": search(NAMED, contains(NAMED)),
    "common_search": search(COMMON, contains(COMMON)),
    "wildcard_search": search(
        "",
        "regexp_matches({0}, '(?s)and.the.*[aeiou]sh')",
        "(VALUES (0, 'and'), (0, 'the')) AS pattern(query_id, gram)",
    ),
    "short_search": unscored("contains({0}, 'Th')"),
    "regex_search": unscored(
        r"regexp_matches({0}, '^[A-M][\pL\pM\p{{Nd}}\p{{Pc}}]*(?:th|ou)[a-z]*\.[0-9]$|(?:ha){{3}}')"
    ),
    "search_lines": f"WITH shown AS ({search(NAMED, contains(NAMED))}) SELECT pass, rank, rpad(name, (max(strlen(name)) "
    "OVER (PARTITION BY pass))::INTEGER, ' ') || ' - ' || left(description, 55) AS line FROM shown",
    "match_flags": f"WITH {PAGES}, p(pattern) AS (VALUES {FLAG_ROWS}) SELECT pattern, EXISTS (SELECT 1 FROM fts "
    "WHERE contains(name, pattern) OR contains(content, pattern)) AS any_match FROM p",
    "param_search": f"WITH {PAGES} SELECT name, count(*) AS n, min(id) AS first_id FROM fts "
    "WHERE contains(content, 'thou') GROUP BY name",
    "bootstrap": "SELECT unnest(['page', 'fts']) AS part, count(*) AS n, count(*) AS last FROM documents",
    "compressed_sink": f"WITH {PAGES} SELECT name, count(*) AS n, sum(strlen(content))::BIGINT AS n_bytes FROM fts GROUP BY name",
    "stored_footprint": f"WITH {PAGES} SELECT sum(strlen(content))::BIGINT AS raw_bytes, true AS under_twice FROM fts",
    "discover_files": f"SELECT {SECTION} AS section, count(*) AS n_files FROM documents GROUP BY ALL",
    "decode_files": f"SELECT md5({source(FIRST_LINE)} || chr(10)) AS digest, count(*) AS n_files FROM documents GROUP BY ALL",
}

FILES = f"""named AS (SELECT content, {described("content")} AS description FROM
  (SELECT {plain(source(FIRST_LINE) + " || chr(10)")} AS content FROM documents))"""
ORACLE["full_build"] = ORACLE["incremental_ingest"] = f"WITH {FILES} {STORED}"


def named_pages(section: str) -> str:
    """Files of fixed names; those cut short count and are no page."""
    start = "CASE doc_id % 7 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END"
    return f"""
WITH found AS MATERIALIZED (SELECT {start} || doc_id || '.' || {SECTION} AS name, {section} AS section, doc_id % 11 = 5 AS cut,
    {plain(source(FIRST_LINE))} AS content FROM documents)
SELECT name, {described("content")} AS description, md5(content) AS digest, section::INTEGER AS section
FROM found WHERE NOT cut
UNION ALL SELECT 'damaged', count(*)::VARCHAR, '', 0 FROM found WHERE cut"""


ORACLE["named_build"], ORACLE["named_ingest"] = named_pages(SECTION), named_pages("1")
ORACLE["repeated_build"] = (
    "SELECT 'page' AS part, count(*) AS n, count(*) AS last FROM documents "
    "UNION ALL SELECT 'fts', 2 * count(*), 2 * count(*) FROM documents"
)
ORACLE["block_status"] = " UNION ALL ".join(
    f"SELECT * FROM (WITH found AS ({search(p, contains(p))}) SELECT {text(p)} AS pattern, CASE WHEN "
    "count(*) FILTER (pass = 1) > 0 THEN 'content matches:' ELSE 'no results' END AS status FROM found)"
    for p in FLAGGED
)

ORACLE["merged_batches"] = f"""
WITH {PAGES}, {gram_tables("fts")}
SELECT 'page' AS part, path AS key, 1::BIGINT AS n FROM page UNION ALL SELECT 'gram', gram, df FROM gram_df"""

# The batch: patterns with grams are scored, the others keep score 0.
ORACLE["many_patterns"] = f"""
WITH {PAGES}, {gram_tables("fts")},
words AS (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark),
starts AS (SELECT left(word, 2) AS pattern FROM words UNION SELECT left(word, 3) FROM words),
query AS (SELECT pattern, (ord(pattern[1]) + 256 * ord(pattern[2])
    + CASE length(pattern) WHEN 3 THEN 65536 * ord(pattern[3]) ELSE 0 END)::BIGINT AS query_id
  FROM starts WHERE regexp_full_match(pattern, '[a-z]{{2,3}}')),
pieces AS (SELECT query_id, pattern AS gram FROM query WHERE length(pattern) = 3),
{scored("pieces")},
tested AS (SELECT query_id, row_id, id, name, description, length(pattern) < 3 AS whole,
    contains(name, pattern) AS by_name, contains(content, pattern) AS by_content FROM query, fts),
joined AS (SELECT tested.*, CASE WHEN whole THEN 0.0::DOUBLE ELSE score - 2e-13 END AS score
  FROM tested LEFT JOIN scored USING (query_id, row_id) WHERE by_name OR by_content),
hits AS (SELECT query_id, row_id, id, name, description, 0 AS pass, score FROM joined WHERE by_name
  UNION ALL SELECT query_id, row_id, id, name, description, 1, score FROM joined WHERE by_content), {BLOCKS}
SELECT query_id, name, description, pass, rank, score FROM blocks"""

ORACLE["batch_search"] = f"""
WITH {PAGES}, {gram_tables("fts")},
items AS (SELECT item_id, item_id % 5 AS kind, split_part(text, ' ', 2) AS second, split_part(text, ' ', 3) AS third
  FROM benchmark),
query AS (SELECT item_id AS query_id, kind = 0 AS is_re, CASE kind WHEN 0 THEN '[a-z]' || left(second, 4)
  WHEN 1 THEN left(second, 2) WHEN 2 THEN second ELSE second || ' ' || third END AS pattern FROM items),
pieces AS (SELECT query_id, unnest([substring(f, i, 3) for i in range(1, length(f) - 1)]) AS gram
  FROM (SELECT query_id, {folded("pattern")} AS f FROM query WHERE NOT is_re)),
{scored("pieces")},
tested AS (SELECT query_id, row_id, id, name, description, is_re OR length(pattern) < 3 AS whole,
    CASE WHEN is_re THEN regexp_matches(name, pattern) ELSE contains(name, pattern) END AS by_name,
    CASE WHEN is_re THEN regexp_matches(content, pattern) ELSE contains(content, pattern) END AS by_content
  FROM query, fts),
joined AS (SELECT tested.*, CASE WHEN whole THEN 0.0::DOUBLE ELSE score END AS score
  FROM tested LEFT JOIN scored USING (query_id, row_id) WHERE by_name OR by_content),
hits AS (SELECT query_id, row_id, id, name, description, 0 AS pass, score FROM joined WHERE by_name
  UNION ALL SELECT query_id, row_id, id, name, description, 1, score FROM joined WHERE by_content), {BLOCKS}
SELECT query_id, name, description, pass, rank, score FROM blocks"""
