"""Nearest-neighbour search by cosine similarity.

Three forms share the scoring code:

* ``semantic_search`` with a query batch of checked size reads the vectors
  once; every task keeps its own best rows, so only top-k rows are shuffled.
* A larger batch goes in blocks of bounded size. A slice of the vectors gives each
  query of a block a bound, its k-th score there; the pass over all vectors starts
  from these bounds, so tasks send on little more than the final rows.
* ``semantic_search_approx`` groups the vectors into cells around pivot vectors and
  visits the nearest cells only. Hot cells, and hot query groups in a cell, are split
  by salts sized from counts.

The exact forms carry keys and scores; snippets are fetched for the final rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import snippet
from quire.functions.vectors import QueryBlock, best_of_stream, matrix
from quire.schemas import (
    CARD_COLUMNS,
    MAX_LIMIT,
    OVERFETCH,
    SOURCE_TYPES,
    check_sources,
    normalised_limit,
    source_ordinal,
)
from quire.session import materialise, scratch_path

# A query batch of at most this many floats is sent to every task.
SHARED_QUERY_FLOATS = 4_000_000
# Pivot vectors sent to every task are bounded the same way.
MIN_PIVOTS = 16
MAX_PIVOTS = 1024
# Rows and queries that meet in one group of the cell join.
CELL_ROWS = 50_000
CELL_QUERIES = 2_000
# Nearest cells visited by the approximate form.
PROBES = 16
# One vector in so many gives the bounds of a query block.
BOUND_SHARE = 32

_VECTOR_ROW = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("layer", T.StringType()),
        T.StructField("snippet", T.StringType()),
    ]
)
_KEY_ROW = T.StructType([f for f in _VECTOR_ROW.fields if f.name != "snippet"])
_BEST = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("limit", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        *_VECTOR_ROW.fields,
    ]
)
_KEY_BEST = T.StructType([f for f in _BEST.fields if f.name != "snippet"])


def check_model(embeddings: DataFrame, model: str | None) -> DataFrame:
    """Only vectors of one model are comparable: keep those of ``model``, which may be left out if there is one only."""
    if model is not None:
        return embeddings.filter(F.col("model") == model)
    if embeddings.select("model").distinct().limit(2).count() > 1:
        raise ValueError("vectors of several models are stored; name the one to search")
    return embeddings


def model_census(embeddings: DataFrame) -> DataFrame:
    """(model, dim, n): more than one row means that models were mixed."""
    return embeddings.groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def _asked(queries: DataFrame, sources: list[str], factor: int = 1) -> DataFrame:
    """(query_id, vector, limit, wanted[5 booleans]); queries without a vector drop out."""
    own = F.col("sources") if "sources" in queries.columns else F.lit(None).cast("array<string>")
    limit = F.col("limit") if "limit" in queries.columns else None
    named = own.isNull() | (F.size(own) == 0)
    wanted = F.array(
        *[F.lit(s in sources) & (named | F.coalesce(F.array_contains(own, s), F.lit(False))) for s in SOURCE_TYPES]
    )
    return queries.filter(F.col("vector").isNotNull()).select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col("vector").cast("array<float>").alias("vector"),
        (normalised_limit(limit) * factor).cast("int").alias("limit"),
        wanted.alias("wanted"),
    )


def _vector_rows(embeddings: DataFrame, sources: list[str]) -> DataFrame:
    """Columns the scoring needs; the source filter reaches the scan."""
    rows = embeddings
    if len(sources) < len(SOURCE_TYPES):
        rows = rows.filter(F.col("source_type").isin(*sources))
    return rows.filter(F.col("embedding").isNotNull()).select(
        source_ordinal("source_type").alias("ordinal"),
        "source_id",
        "layer",
        snippet(F.col("content")).alias("snippet"),
        "embedding",
    )


def _as_rows(pool: pa.Table | None, queries: QueryBlock, names: list[str] = _VECTOR_ROW.names) -> Iterator[pa.RecordBatch]:
    """Result rows in the column order of ``_BEST``, with the vector columns ``names``."""
    if pool is None:
        return
    owner = pool.column("query").to_numpy()
    columns = {
        "query_id": pa.array(queries.ids[owner]),
        "limit": pa.array(queries.limits[owner].astype(np.int32)),
        "score": pool.column("score"),
        **{name: pool.column(name) for name in names},
    }
    yield from pa.table(columns).to_batches()


def _shared_queries(asked: DataFrame) -> list | None:
    """The query rows, if they are few enough to send to every task; None otherwise."""
    widest = asked.agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("n")).first()
    if not widest.n:
        return []
    if widest.n * widest.dim > SHARED_QUERY_FLOATS:
        return None
    return asked.collect()  # bounded by the check above


def _nearest_shared(rows: DataFrame, asked: list, bounds: dict[int, float] | None = None) -> DataFrame:
    """Best rows of each task, keys and scores only; ``bounds`` are scores that the k-th row of a query reaches at least."""
    vectors = matrix(pa.array([q.vector for q in asked], type=pa.list_(pa.float32())))
    wanted = np.array([q.wanted for q in asked], dtype=bool)
    floors = np.array([(bounds or {}).get(q.query_id, -np.inf) for q in asked])
    # plain arrays: what is broadcast must be readable without this package
    parts = ([q.query_id for q in asked], vectors, [q.limit for q in asked], wanted, floors)
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, floors = shared.value
        queries = QueryBlock(*parts)
        tables = (pa.Table.from_batches([b]) for b in batches)
        yield from _as_rows(best_of_stream(tables, queries, floors.copy()), queries, _KEY_ROW.names)

    return rows.select(*_KEY_ROW.names, "embedding").mapInArrow(best, _KEY_BEST)


def _nearest_in_blocks(rows: DataFrame, asked: DataFrame, block_floats: int) -> DataFrame:
    """Ranked keys of each query, one block of queries after the other.

    A block holds about ``block_floats`` floats; its bounds come from a slice of the vectors.
    Driver and tasks hold one block and its k best keys, whatever the number of queries.
    """
    size = asked.agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("n")).first()
    n = max(1, -(-size.n * (size.dim or 1) // block_floats))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    blocks = materialise(asked.withColumn("block", block), "query-blocks", partition_by="block")
    first = F.pmod(F.xxhash64(*_KEY_ROW.names), F.lit(BOUND_SHARE)) == 0
    stored = rows.select(*_KEY_ROW.names, "embedding").withColumn("first", first.cast("int"))
    stored = materialise(stored, "vectors", partition_by="first")
    place = scratch_path(rows.sparkSession, "block-hits")
    empty = _rank(_nothing(rows))
    empty.write.parquet(place)
    for i in range(n):
        queries = blocks.filter(F.col("block") == i).collect()  # one block
        if not queries:
            continue
        limits = {q.query_id: q.limit for q in queries}
        seen = _rank(_nearest_shared(stored.filter("first = 1"), queries))
        last = seen.groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("score")).collect()  # one row a query
        bounds = {r.query_id: r.score for r in last if r.n == limits[r.query_id]}
        _rank(_nearest_shared(stored, queries, bounds)).write.mode("append").parquet(place)
    return rows.sparkSession.read.schema(empty.schema).parquet(place)


def _rank(best: DataFrame) -> DataFrame:
    """Final top-k per query over the tasks' candidates."""
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), "ordinal", "source_id", "layer"
    )
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= MAX_LIMIT * OVERFETCH) & (F.col("rank") <= F.col("limit")))
        .select(
            "query_id", "rank",
            F.get(F.array(*[F.lit(s) for s in SOURCE_TYPES]), F.col("ordinal")).alias("source_type"),
            *[c for c in ("source_id", "layer", "snippet", "score") if c in best.columns],
        )
    )


def with_snippets(hits: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Add the stored texts' snippets to ranked keys. The hits are stored first, so the text scan is cut down to them."""
    few = materialise(hits, "near")
    keys = ["source_type", "source_id", "layer"]
    texts = embeddings.select(*keys, "content").join(few.select(*keys).distinct(), keys, "left_semi")
    texts = texts.groupBy(*keys).agg(F.min(snippet(F.col("content"))).alias("snippet"))
    return few.join(texts, keys, "left").select("query_id", "rank", *keys, "snippet", "score")


def nearest(
    queries: DataFrame,
    embeddings: DataFrame,
    sources: list[str] | None = None,
    model: str | None = None,
    factor: int = 1,
    shared: bool | None = None,
    block_floats: int = SHARED_QUERY_FLOATS,
) -> DataFrame:
    """Exact nearest stored vectors of each query, before enrichment.

    ``queries`` is (query_id, vector[, sources, limit]) with distinct ids. ``shared`` forces the
    one-pass form (True) or blocks of ``block_floats`` query floats (False); by default the size decides.
    Of a key stored several times the smallest snippet is shown.
    """
    wanted = check_sources(sources)
    asked = materialise(_asked(queries, wanted, factor), "queries")
    known = check_model(embeddings, model)
    rows = _of_dimension(_vector_rows(known, wanted), asked)
    few = None if shared is False else _shared_queries(asked)
    if few is None:
        best = _nearest_in_blocks(rows, asked, block_floats)
    else:
        best = _rank(_nearest_shared(rows, few) if few else _nothing(rows))
    return with_snippets(best, known)


def _of_dimension(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Vectors of the queries' dimension, others match nothing; queries of several dimensions are an error."""
    size = F.size("vector")
    widths = asked.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
    if widths.low != widths.high:
        raise ValueError(f"query vectors have {widths.low} to {widths.high} dimensions; they must come from one model")
    return rows if widths.low is None else rows.filter(F.size("embedding") == widths.low)


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], _KEY_BEST)


# --- cells ------------------------------------------------------------------


def _pivots(rows: DataFrame, cells: int | None) -> np.ndarray:
    """Up to ``cells`` stored vectors, picked by the hash of their key.

    By default as many as the square root of the table's size.

    A top-n over the table, bounded in size.
    """
    if cells is None:
        cells = min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(rows.count())))
    if not 1 <= cells <= MAX_PIVOTS:
        raise ValueError(f"cells must be between 1 and {MAX_PIVOTS}")
    key = F.md5(F.concat_ws("/", "ordinal", "source_id", "layer"))
    picked = rows.select(key.alias("key"), "embedding").orderBy("key").limit(cells).collect()
    unit = matrix(pa.array([p.embedding for p in picked], type=pa.list_(pa.float32())))
    return unit[~np.isnan(unit).any(axis=1)]


def _with_cell(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the angle to it; zero vectors, which match nothing, are left out."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.round(matrix(batch.column("embedding"), shared.value.shape[1]) @ shared.value.T, 9)
            usable = ~np.isnan(cosine).any(axis=1)
            cell = np.where(usable, np.nan_to_num(cosine).argmax(axis=1), 0).astype(np.int32)
            angle = np.arccos(np.clip(np.nan_to_num(cosine.max(axis=1)), -1.0, 1.0))
            whole = pa.table({**dict(zip(batch.schema.names, batch.columns, strict=True)),
                              "cell": pa.array(cell), "angle": pa.array(angle)})
            yield from whole.filter(pa.array(usable)).to_batches()

    return rows.mapInArrow(assign, schema)


def _route_columns() -> list[T.StructField]:
    return [
        T.StructField("query_id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("limit", T.IntegerType()),
        T.StructField("wanted", T.ArrayType(T.BooleanType())),
        T.StructField("cell", T.IntegerType()),
    ]


def _routes(asked: DataFrame, pivots: np.ndarray, probes: int) -> DataFrame:
    """Query rows copied to their ``probes`` nearest cells."""
    shared = asked.sparkSession.sparkContext.broadcast(pivots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            cosine = np.round(matrix(batch.column("vector"), pivots.shape[1]) @ pivots.T, 9)
            usable = ~np.isnan(cosine).any(axis=1)
            cosine = np.where(usable[:, None], cosine, 0.0)
            place = np.argsort(np.argsort(-cosine, axis=1, kind="stable"), axis=1, kind="stable")
            rows, cells = np.nonzero((place < probes) & usable[:, None])
            chosen = batch.select(["query_id", "vector", "limit", "wanted"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns, pa.array(cells.astype(np.int32))], names=[f.name for f in _route_columns()]
            )

    return asked.mapInArrow(route, T.StructType(_route_columns()))


def _salt(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")


def _join_cells(stored: DataFrame, routes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Score every routed query against its cells.

    Each cell becomes a grid of row salts and query salts, so both sides of a
    group stay bounded however hot the cell is.
    """
    load = routes.groupBy("cell").agg(F.count("*").alias("n_queries"))
    grid = sizes.join(load, "cell").select(
        "cell",
        _parts(F.col("n_rows"), CELL_ROWS).alias("row_parts"),
        _parts(F.col("n_queries"), CELL_QUERIES).alias("query_parts"),
    )
    grid = F.broadcast(grid)  # at most MAX_PIVOTS rows
    left = (
        stored.join(grid, "cell")
        .withColumn("row_salt", _salt(F.concat_ws("/", "source_id", "layer"), F.col("row_parts")))
        .withColumn("query_salt", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        .select("cell", "row_salt", "query_salt", *_VECTOR_ROW.names, "embedding")
    )
    right = (
        routes.join(grid, "cell")
        .withColumn("query_salt", _salt(F.col("query_id"), F.col("query_parts")))
        .withColumn("row_salt", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))
        .select("cell", "row_salt", "query_salt", "query_id", "limit", "wanted", "vector")
    )

    def score(rows: pa.Table, group: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches(
            [], pa.schema([("query_id", pa.int64()), ("limit", pa.int32()), ("score", pa.float64()),
                           ("ordinal", pa.int32()), ("source_id", pa.int64()), ("layer", pa.string()),
                           ("snippet", pa.string())])
        )
        if rows.num_rows == 0 or group.num_rows == 0:
            return empty
        wanted = group.column("wanted").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        block = QueryBlock(
            group.column("query_id").to_numpy(),
            matrix(group.column("vector")),
            group.column("limit").to_numpy(),
            wanted.reshape(group.num_rows, -1),
        )
        pool = best_of_stream(iter([rows.select([*_VECTOR_ROW.names, "embedding"])]), block)
        batches = list(_as_rows(pool, block))
        return pa.Table.from_batches(batches).cast(empty.schema) if batches else empty

    keys = ["cell", "row_salt", "query_salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _BEST)


def _nearest_by_cell(rows: DataFrame, asked: DataFrame, cells: int | None, probes: int) -> DataFrame:
    pivots = _pivots(rows, cells)
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], _BEST)
    stored = materialise(_with_cell(rows, pivots), "cells")
    sizes = materialise(stored.groupBy("cell").agg(F.count("*").alias("n_rows")), "sizes")
    return _join_cells(stored, materialise(_routes(asked, pivots, probes), "routes"), sizes)


# --- composed searches --------------------------------------------------------


def enrich(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """Add title, reference and so on from the source rows; a hit without one is kept.

    The hits are stored first: they are few, Spark then sees their size, and the
    card scan is cut down to them before the outer join.
    """
    few = materialise(hits, "hits")
    keys = ["source_type", "source_id"]
    own = [c for c in CARD_COLUMNS if c != "snippet"]
    found = cards.select(*keys, *own).join(few.select(*keys).distinct(), keys, "left_semi")
    return few.join(found, keys, "left").select(
        "query_id", "rank", *keys, "score", *CARD_COLUMNS, "layer"
    )


def semantic_search(
    queries: DataFrame,
    embeddings: DataFrame,
    cards: DataFrame,
    sources: list[str] | None = None,
    model: str | None = None,
    shared: bool | None = None,
    block_floats: int = SHARED_QUERY_FLOATS,
) -> DataFrame:
    """Nearest stored chunks of each query vector, enriched; sources are filtered before the top-k."""
    return enrich(nearest(queries, embeddings, sources, model, shared=shared, block_floats=block_floats), cards)


def semantic_search_overfetch(
    queries: DataFrame,
    embeddings: DataFrame,
    cards: DataFrame,
    sources: list[str] | None = None,
    model: str | None = None,
) -> DataFrame:
    """The filter-afterwards form: take the nearest 4 x limit of any source, then filter and cut.

    May return fewer than ``limit`` hits although more exist.
    """
    wanted = check_sources(sources)
    fetched = nearest(queries.drop("sources"), embeddings, None, model, factor=OVERFETCH)
    asked = _asked(queries, wanted).select(
        "query_id", "limit", F.filter(F.transform("wanted", lambda w, i: F.when(w, i)), F.isnotnull).alias("_ok")
    )
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = (
        fetched.join(asked, "query_id")
        .filter(F.array_contains("_ok", source_ordinal("source_type")))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= F.col("limit"))
        .withColumn("rank", F.col("_place"))
        .drop("_place", "_ok", "limit")
    )
    return enrich(kept, cards)


def semantic_search_approx(
    queries: DataFrame,
    embeddings: DataFrame,
    cards: DataFrame,
    sources: list[str] | None = None,
    model: str | None = None,
    cells: int | None = None,
    probes: int = PROBES,
) -> DataFrame:
    """Search only the ``probes`` cells whose pivots are nearest to the query."""
    wanted = check_sources(sources)
    asked = materialise(_asked(queries, wanted), "queries")
    rows = _of_dimension(_vector_rows(check_model(embeddings, model), wanted), asked)
    found = _nearest_by_cell(rows, asked, cells, probes)
    return enrich(_rank(found), cards)
