"""Search and lookup over the state tables, a whole table of requests at a time."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.analysis import ENGLISH, Analyzer
from quire.operators.fusion import decorate_links, hybrid_merge
from quire.operators.keyword import build_term_index, keyword_search
from quire.operators.lookup import cross_references, get_passages, resolve_citations
from quire.operators.semantic import semantic_search
from quire.schemas import CARD_COLUMNS, HIT_COLUMNS, SOURCE_TYPES
from quire.session import materialise

MODES = ("keyword", "semantic", "hybrid")


def unified_corpus(tables: dict[str, DataFrame]) -> DataFrame:
    """The five content tables as one: source_type, source_id, content and card columns."""
    shapes = {
        "scriptures": {"reference": "reference", "content": "text"},
        "talks": {"title": "title", "content": "content", "speaker": "speaker", "year": "year", "month": "month"},
        "manuals": {"title": "title", "content": "content"},
        "books": {"title": "title", "content": "content"},
        "study_aids": {"title": "title", "content": "content", "aid_type": "aid_type", "slug": "slug"},
    }
    kinds = {c: "string" for c in (*CARD_COLUMNS, "content")} | {"year": "int"}
    kinds.pop("snippet")
    parts = [
        tables[name].select(
            F.lit(name).alias("source_type"),
            F.col("id").alias("source_id"),
            *[
                (F.col("file_path") if c == "file_path" else F.col(shape[c]) if c in shape else F.lit(None))
                .cast(kind)
                .alias(c)
                for c, kind in kinds.items()
            ],
        )
        for name, shape in shapes.items()
        if name in tables
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@dataclass
class Corpus:
    """What a search needs: card rows, a stored term index, and vectors if there are any."""

    cards: DataFrame
    index: DataFrame | None = None
    embeddings: DataFrame | None = None
    analyzer: Analyzer = ENGLISH
    model: str | None = None


def write_term_index(corpus: DataFrame, path: str, analyzer: Analyzer = ENGLISH) -> DataFrame:
    """Store the term index, one folder per source type, so a source filter prunes whole folders."""
    index = build_term_index(corpus, analyzer)
    index.write.mode("overwrite").partitionBy("source_type").parquet(path)
    return corpus.sparkSession.read.schema(index.schema).parquet(path)


def search(
    queries: DataFrame,
    corpus: Corpus,
    mode: str = "hybrid",
    sources: list[str] | None = None,
    link_mode: str = "both",
    limit: int | None = None,
) -> DataFrame:
    """Answer (query_id, query[, vector, sources, limit]) and return hits in rank order per query.

    ``limit`` holds for queries without one of their own. Hybrid search without vectors is keyword
    search; so is each query that has none, and, with a warning, the whole batch when its vectors
    cannot be searched.
    """
    mode = (mode or "hybrid").lower()
    if mode not in MODES:
        raise ValueError(f"unknown search mode {mode!r}; choose from {MODES}")
    asked = queries.filter(F.trim("query") != "")
    if limit is not None:
        own = F.col("limit") if "limit" in queries.columns else F.lit(None)
        asked = asked.withColumn("limit", F.coalesce(own, F.lit(limit)))
    vectors = corpus.embeddings is not None and "vector" in queries.columns
    if mode == "semantic":
        if not vectors:
            raise ValueError("semantic search needs stored embeddings and query vectors")
        hits = semantic_search(asked, corpus.embeddings, corpus.cards, sources, corpus.model)
    else:
        hits = keyword_search(asked, corpus.index, sources, corpus.analyzer)
        if mode == "hybrid" and vectors:
            try:
                near = semantic_search(asked, corpus.embeddings, corpus.cards, sources, corpus.model)
            except ValueError as problem:
                warnings.warn(f"keyword hits only: {problem}", stacklevel=2)
            else:
                hits = hybrid_merge(asked, hits, near)
    return decorate_links(hits, link_mode).select(*HIT_COLUMNS)


def resolve(
    citations: DataFrame, tables: dict[str, DataFrame], cross_refs: bool = False, aliases: DataFrame | None = None,
    ordered: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Passages of (request_id, citation), and on demand the cross-references of their verses, ``ordered`` or not."""
    parsed = materialise(resolve_citations(citations, aliases), "resolved")
    passages = get_passages(parsed, tables["scriptures"], tables["chapters"])
    if not cross_refs:
        return passages, None
    return passages, cross_references(
        passages.filter((F.col("status") == "ok") & F.col("shape").isin("verse", "range")),
        tables["cross_references"],
        tables["scriptures"],
        ordered,
    )


__all__ = ["MODES", "SOURCE_TYPES", "Corpus", "resolve", "search", "unified_corpus", "write_term_index"]
