"""Reciprocal rank fusion, hybrid search and link decoration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.links import LIBRARY_MARKER, STUDY_URL, canonical_url
from quire.schemas import CARD_COLUMNS, MAX_LIMIT, RRF_K, normalised_limit, source_ordinal

LINK_MODES = ("both", "web", "fs")
KEYS = ["source_type", "source_id"]


def _fuse(ranked: DataFrame, k: int) -> DataFrame:
    """Fuse lists given as rows with ``list``, ``rank`` and ``fuse``.

    A document that occurs several times in one list adds one term for each.
    It is shown as in its first row, the first list counting before the second.
    A query whose rows have ``fuse`` false keeps its scores.
    """
    merged = ranked.groupBy("query_id", "limit", "fuse", *KEYS).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("fused"),
        F.min_by(F.struct("score", *CARD_COLUMNS), F.struct("list", "rank")).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), source_ordinal("source_type"), "source_id"
    )
    return (
        merged.withColumn(
            "score", F.when(F.col("fuse"), F.round("fused", 12)).otherwise(F.col("first.score"))
        )
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= MAX_LIMIT) & (F.col("rank") <= F.col("limit")))
        .select("query_id", "rank", *KEYS, "score", *[F.col(f"first.{c}").alias(c) for c in CARD_COLUMNS])
    )


def _listed(hits: DataFrame, number: int) -> DataFrame:
    return hits.select("query_id", "rank", *KEYS, "score", *CARD_COLUMNS, F.lit(number).alias("list"))


def rrf_merge(a: DataFrame, b: DataFrame, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Fuse two hit tables: every document scores the sum of 1 / (k + rank) over both."""
    both = _listed(a, 0).unionByName(_listed(b, 1))
    return _fuse(
        both.withColumn("limit", normalised_limit(limit)).withColumn("fuse", F.lit(True)), k
    )


def hybrid_merge(
    queries: DataFrame, keyword: DataFrame, semantic: DataFrame | None, k: int = RRF_K
) -> DataFrame:
    """Fuse per query; queries without a vector keep their keyword list and its scores.

    A query whose semantic list exists but is empty is still fused.
    """
    if semantic is None:
        return keyword
    limit = F.col("limit") if "limit" in queries.columns else None
    how = queries.select(
        "query_id", normalised_limit(limit).alias("limit"), F.col("vector").isNotNull().alias("fuse")
    )
    both = _listed(keyword, 0).unionByName(_listed(semantic, 1))
    return _fuse(both.join(how, "query_id"), k)


def decorate_links(
    hits: DataFrame, mode: str = "both", base_url: str = STUDY_URL, marker: str = LIBRARY_MARKER
) -> DataFrame:
    """Say where a hit comes from: ``fs`` path only, ``web`` address only, anything else both."""
    if mode == "fs":
        return hits.withColumn("web_url", F.lit(""))
    linked = hits.withColumn("web_url", canonical_url(F.col("file_path"), base_url, marker))
    return linked.withColumn("file_path", F.lit("")) if mode == "web" else linked
