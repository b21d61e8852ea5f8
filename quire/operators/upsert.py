"""Snapshot upserts: old snapshot plus a batch gives the new snapshot.

Plain Parquet tables have no MERGE. The batch is first reduced to one row per
key, with a partial top-1 before the shuffle, so one key repeated by a third
of the batch costs nothing extra. One full outer join on the key then gives
updated, kept and new rows, reading batch and snapshot once each; stored tables
bring in only the partitions that the batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.schemas import surrogate_id


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") == 1).drop("_n")




def absent_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the snapshot lacks.

    The snapshot's key columns are first cut down to the keys of the batch, so
    only matches are carried into the second join.
    """
    present = existing.select(*keys).join(incoming.select(*keys), keys, "left_semi")
    return incoming.join(present, keys, "left_anti")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    update_cols: list[str],
    order_col: str,
) -> DataFrame:
    """Insert or update by key; of equal keys in the batch the highest ``order_col`` wins.

    Only ``update_cols`` change on a conflict; ids and carried columns survive,
    and an incoming null does overwrite. The result has the schema of ``existing``.
    """
    return applied(existing, incoming_rows(incoming, existing.schema, keys, update_cols, order_col), keys, update_cols)


def incoming_rows(incoming: DataFrame, schema: StructType, keys: list[str], update_cols: list[str], order_col: str) -> DataFrame:
    """The rows of a batch that count, one a key, with the columns of ``schema``."""
    ties = [F.col(c).desc_nulls_last() for c in update_cols]
    return _as_schema(latest_per_key(incoming, keys, [F.col(order_col).desc_nulls_last(), *ties]), schema, keys)


def applied(existing: DataFrame, fresh: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """``existing`` with rows of its own columns, one a key, inserted or updated."""
    marked = fresh.select(*[F.col(c).alias(f"_new_{c}") for c in fresh.columns], F.lit(True).alias("_hit"))
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(key) == F.col(f"_new_{key}"))
    joined = existing.withColumn("_kept", F.lit(True)).join(marked, on, "full_outer")
    return joined.select(
        *[
            F.when(F.col("_hit") if c in update_cols else F.col("_kept").isNull(), F.col(f"_new_{c}"))
            .otherwise(F.col(c))
            .alias(c)
            for c in existing.columns
        ]
    )


def _as_schema(rows: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """Cast to the table's columns: new ids from the natural key, unknown columns null."""
    columns = []
    for field in schema.fields:
        if field.name in rows.columns:
            value = F.col(field.name)
        elif field.name == "id":
            value = surrogate_id(*keys)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order_col: str
) -> DataFrame:
    """Rows to append: keys not stored yet; of equal keys in the batch the lowest ``order_col`` wins."""
    batch = latest_per_key(incoming, keys, [F.col(order_col).asc()])
    return absent_rows(batch, existing, keys)


def prune_vanished(existing: DataFrame, listing: DataFrame) -> DataFrame:
    """Optional clean-up: drop rows whose file is no longer listed."""
    present = listing.select(F.col("path").alias("file_path"))
    return existing.join(present, "file_path", "left_semi")


# key columns and columns to overwrite, per table
UPSERTS: dict[str, tuple[list[str], list[str]]] = {
    "chapters": (["volume", "book", "chapter"], ["title", "full_content", "file_path"]),
    "scriptures": (["volume", "book", "chapter", "verse"], ["reference", "text", "file_path"]),
    "study_aids": (["file_path"], ["aid_type", "slug", "title", "content"]),
    "talks": (["file_path"], ["year", "month", "speaker", "title", "content"]),
    "manuals": (["file_path"], ["title", "content", "collection_id"]),
    "books": (["file_path"], ["title", "content", "collection", "section"]),
    "index_metadata": (
        ["file_path"],
        ["content_type", "file_mtime", "file_size", "record_count", "indexed_at"],
    ),
}


def upsert_table(name: str, existing: DataFrame, incoming: DataFrame, order_col: str = "file_path") -> DataFrame:
    """Upsert with the key and the overwrite list of a known table."""
    keys, update_cols = UPSERTS[name]
    return upsert(existing, incoming, keys, update_cols, order_col)
