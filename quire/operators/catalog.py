"""Grouped listings and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schemas import COLLECTIONS_LISTED, COUNTED_TABLES, SESSIONS_LISTED


def list_volumes(scriptures: DataFrame) -> DataFrame:
    """Books and verses per volume; counted per book first, so a huge volume is spread out."""
    return volumes_of(scriptures.groupBy("volume", "book").agg(F.count("*").alias("n")))


def volumes_of(per_book: DataFrame) -> DataFrame:
    return (
        per_book.groupBy("volume")
        .agg(F.count("book").alias("books"), F.sum("n").alias("verses"))
        .orderBy("volume")
    )


def list_sessions(talks: DataFrame, limit: int = SESSIONS_LISTED) -> DataFrame:
    return (
        talks.groupBy("year", "month")
        .agg(F.count("*").alias("talks"))
        .orderBy(F.col("year").desc(), F.col("month").desc())
        .limit(limit)
    )


def list_manual_collections(manuals: DataFrame, limit: int = COLLECTIONS_LISTED) -> DataFrame:
    return (
        manuals.groupBy(F.col("collection_id").alias("collection"))
        .agg(F.count("*").alias("pages"))
        .orderBy("collection")
        .limit(limit)
    )


def list_book_collections(books: DataFrame) -> DataFrame:
    return books.groupBy("collection").agg(F.count("*").alias("sections")).orderBy("collection")


def list_study_aids(study_aids: DataFrame) -> DataFrame:
    return study_aids.groupBy("aid_type").agg(F.count("*").alias("entries")).orderBy("aid_type")


def corpus_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for the seven content tables; a missing table counts as empty."""
    spark = next(iter(tables.values())).sparkSession
    counted = [
        tables[name].agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        for name in COUNTED_TABLES
        if name in tables
    ]
    missing = [(name, 0) for name in COUNTED_TABLES if name not in tables]
    if missing:
        counted.append(spark.createDataFrame(missing, "table string, n bigint"))
    stats = counted[0]
    for one in counted[1:]:
        stats = stats.unionByName(one)
    return stats


LISTINGS = {
    "scriptures": list_volumes,
    "talks": list_sessions,
    "manuals": list_manual_collections,
    "books": list_book_collections,
    "study_aids": list_study_aids,
}


def kept_listing(counts: dict[str, DataFrame], kind: str = "") -> DataFrame:
    """As ``listing``, from the stored counts of the tables instead of their rows (``StateTables.all_counts``)."""
    if not kind:
        spark = next(iter(counts.values())).sparkSession
        names = spark.createDataFrame([(i, name) for i, name in enumerate(COUNTED_TABLES)], "place int, table string")
        totals = [counts[n].agg(F.lit(n).alias("table"), F.sum("n").alias("n")) for n in COUNTED_TABLES if n in counts]
        known = names.join(reduce(DataFrame.unionByName, totals), "table", "left")
        return known.orderBy("place").select("table", F.coalesce("n", F.lit(0)).alias("n"))
    if kind not in LISTINGS:
        raise ValueError(f"unknown type {kind!r}; choose from {sorted(LISTINGS)}")
    kept = counts[kind]
    if kind == "scriptures":
        return volumes_of(kept)
    if kind == "talks":
        newest = kept.select("year", "month", F.col("n").alias("talks")).orderBy(F.col("year").desc(), F.col("month").desc())
        return newest.limit(SESSIONS_LISTED)
    if kind == "manuals":
        return kept.select(F.col("collection_id").alias("collection"), F.col("n").alias("pages")).orderBy("collection").limit(COLLECTIONS_LISTED)
    key, shown = {"books": ("collection", "sections"), "study_aids": ("aid_type", "entries")}[kind]
    return kept.select(key, F.col("n").alias(shown)).orderBy(key)


def listing(tables: dict[str, DataFrame], kind: str = "") -> DataFrame:
    """The listing of one content type, or the table counts when none is named."""
    if not kind:
        return corpus_stats(tables)
    if kind not in LISTINGS:
        raise ValueError(f"unknown type {kind!r}; choose from {sorted(LISTINGS)}")
    return LISTINGS[kind](tables[kind])
