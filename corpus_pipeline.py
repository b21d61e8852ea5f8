"""From raw documents to packed training sequences: five stages, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, importance, jaccard, line_dedup, packing, passages
from quire.llm.common import Store, table
from quire.llm.jobs import good_document, vocabulary

#: A document with any benchmark window goes altogether.
MAX_COVERAGE = 0.0
WIDTH, PERCENT = 5, 80

_SCRATCH = "corpus-pipeline"


def _store(spark: SparkSession, stage: str) -> Store:
    """Scratch tables of this stage. Those of earlier stages go: their results have been written by now."""
    Store.drop_owned(_SCRATCH)
    return Store(spark, f"pipeline-{stage}", _SCRATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good, non-toxic text selects."""
    _store(spark, "quality")
    return importance.keep(docs, table(spark, sf_dir, "labels"), good_document())


def _counted(cut: DataFrame, docs: DataFrame, n_cut: str) -> DataFrame:
    """Rows of ``cut`` that lost nothing or have words left, in the columns of ``docs``, with their lengths."""
    cut = cut.filter((F.col(n_cut) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        counted = F.when(F.col(n_cut) == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")
        cut = cut.withColumn("n_chars", counted)
    return cut.select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of 50 words and more: runs of whole lines go first, then passages that
    begin or end inside lines. Documents that lose every word go."""
    store = _store(spark, "lines")
    first = Store(spark, "pipeline-whole-lines", _SCRATCH)
    lines = line_dedup.dedup_lines(docs, store=first)
    kept = store.save(_counted(lines, docs, lines.columns[-1]), "lines")
    first.drop()
    store.release()
    cut = passages.dedup_passages(kept, store=store)
    return _counted(cut, docs, cut.columns[-1])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return jaccard.representatives(docs, WIDTH, PERCENT, _store(spark, "jaccard"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    _store(spark, "benchmark")
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), max_coverage=MAX_COVERAGE)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    _store(spark, "packing")
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packed_sequences),
]

#: SQL has no tokenizer and no importance model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    results = Store(spark, "pipeline-results")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, results.save(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if i:
            results.drop(before)
    Store.drop_owned(_SCRATCH)
    return docs
