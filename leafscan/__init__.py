"""leafscan: a page catalogue and ranked substring search, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from leafscan.operators.pages import assign_ids, insert_pages, lookup_id, text_rows
from leafscan.plans.batch import search_batch
from leafscan.plans.build import build, ingest_texts
from leafscan.plans.listing import aligned, count_pages, list_pages
from leafscan.plans.merge import merge_batches, remove_merged
from leafscan.plans.search import any_match, search
from leafscan.sources.files import decode, discover
from leafscan.sources.tables import ensure_tables, footprint, load_index
from leafscan.streaming.ingest import ingest_available

# Functions of this package reach the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "aligned",
    "any_match",
    "assign_ids",
    "build",
    "count_pages",
    "decode",
    "discover",
    "ensure_tables",
    "footprint",
    "ingest_available",
    "ingest_texts",
    "insert_pages",
    "list_pages",
    "load_index",
    "lookup_id",
    "merge_batches",
    "remove_merged",
    "search",
    "search_batch",
    "text_rows",
]
