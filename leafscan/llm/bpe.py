"""Byte-level BPE: texts to token ids by a rank file, and ids back to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import map_rows, null_free

# A longer text is encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 16
# Where white space follows something else a match of the pattern always ends, whatever
# stands around: in each of its alternatives white space comes first or not at all.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# White space that is encoded without the regex, which recurses over it. What follows such a
# run takes its last character; the rest of it is a match of its own.
LONG_RUN = 10_000
_BLANK = re.compile(r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, read once by each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# A pattern whose one match is the whole text.
WHOLE = r"(?s:.+)"


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text cut at safe boundaries, each the first one ``size`` or more after the last."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def long_blanks(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts ``(part, blank)``; blank parts are one match of the pattern each."""
    start = 0
    for run in _BLANK.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() - (run.end() < len(text))
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def token_ids(text: str, path: str, pattern: str, size: int = PIECE_CHARS) -> list[int]:
    """The ids of one text."""
    encoder, ids = encoding(path, pattern), []
    for part, blank in long_blanks(text):
        if blank:
            ids += encoding(path, WHOLE).encode_ordinary(part)
            continue
        for piece in pieces(part, size):
            ids += encoder.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, path: str, pattern: str, size: int = PIECE_CHARS) -> DataFrame:
    """``(doc_id, text, ids)`` for each row of ``(doc_id, text)``.

    ``path`` names a file of ranks that every executor has, ``pattern`` the regex that splits
    a text before merging. Names of special tokens are ordinary text. A null text counts as
    empty and has no ids; repeated rows and null ids stay as they are. A text without any
    safe boundary is encoded as one piece, but for long white space, which is a match whatever
    stands around it.
    """

    def run(rows):
        for doc_id, text in rows:
            yield doc_id, text, np.array(token_ids(text, path, pattern, size), np.int32)

    texts = docs.select("doc_id", null_free().alias("text"))
    return map_rows(texts, run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, bytes)``: the raw bytes behind each row's ids, joined; null ids give none.

    Bytes, not text: a sequence of ids that was cut may end inside a character.
    """

    def run(rows):
        encoder = encoding(path, pattern)
        for doc_id, ids in rows:
            yield doc_id, ids, encoder.decode_bytes(ids or [])

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, bytes)``: the ids of each text and what they decode to, by ``encode`` and
    ``decode`` in one pass, so that a task keeps one Python worker and one encoder."""

    def run(rows):
        for doc_id, text in rows:
            ids = token_ids(text, path, pattern)
            yield doc_id, np.array(ids, np.int32), encoding(path, pattern).decode_bytes(ids)

    return map_rows(docs.select("doc_id", null_free()), run, "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded bytes, for each document."""
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spelt, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
