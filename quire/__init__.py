"""Corpus search and lookup as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quire.operators.catalog import listing  # noqa: E402
from quire.operators.lookup import get_by_id  # noqa: E402
from quire.plans.ingest import backfill_stored_speakers, embed_changed, embed_pending, ingest  # noqa: E402
from quire.plans.search import Corpus, resolve, search, unified_corpus, write_term_index  # noqa: E402
from quire.streaming.ingest import ingest_stream  # noqa: E402

__all__ = [
    "Corpus", "backfill_stored_speakers", "embed_changed", "embed_pending", "get_by_id", "ingest", "ingest_stream",
    "listing", "resolve", "search", "unified_corpus", "write_term_index",
]
