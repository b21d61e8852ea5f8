"""Nearest-neighbour scoring of Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCORE_DIGITS = 6
# Queries scored against a batch at a time; bounds the score matrix.
QUERY_BLOCK = 256
# Order of equal scores.
_TIE_ORDER = [("ordinal", "ascending"), ("source_id", "ascending"), ("layer", "ascending")]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Rows of an array<float> column as float64 unit vectors; zero vectors become NaN rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return np.empty((0, dim or 0))
    width = dim or len(values) // len(column)
    if len(values) != width * len(column):
        raise ValueError(f"vectors do not all have dimension {width}; they must come from one model")
    rows = values.reshape(len(column), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class QueryBlock:
    """Unit query vectors with their ids, limits and allowed sources."""

    def __init__(self, ids, vectors: np.ndarray, limits, allowed: np.ndarray):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.vectors = vectors
        self.limits = np.asarray(limits, dtype=np.int64)
        self.allowed = allowed  # queries x source ordinals, boolean

    def __len__(self) -> int:
        return len(self.ids)


def _best_of(scores: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Positions of the k highest scores not below ``floor``; earlier rows win ties."""
    found = np.flatnonzero(scores >= floor)
    if len(found) > k:
        cut = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= cut]
    return found[np.argsort(-scores[found], kind="stable")[:k]]


def score_batch(batch: pa.Table, queries: QueryBlock, floors: np.ndarray) -> pa.Table | None:
    """Best rows of one batch for every query, as (query, score, batch columns without the vector)."""
    batch = batch.sort_by(_TIE_ORDER)
    vectors = matrix(batch.column("embedding"), queries.vectors.shape[1])
    sources = batch.column("ordinal").to_numpy()
    rows, owners, scores = [], [], []
    for start in range(0, len(queries), QUERY_BLOCK):
        block = slice(start, min(start + QUERY_BLOCK, len(queries)))
        score = np.round(vectors @ queries.vectors[block].T, SCORE_DIGITS)
        score[np.isnan(score)] = -np.inf
        score[~queries.allowed[block][:, sources].T] = -np.inf
        for j, q in enumerate(range(block.start, block.stop)):
            best = _best_of(score[:, j], int(queries.limits[q]), max(floors[q], -2.0))
            if len(best):
                rows.append(best)
                owners.append(np.full(len(best), q))
                scores.append(score[best, j])
    if not rows:
        return None
    picked = batch.drop_columns(["embedding"]).take(pa.array(np.concatenate(rows)))
    return picked.append_column("query", pa.array(np.concatenate(owners))).append_column(
        "score", pa.array(np.concatenate(scores))
    )


def merge_best(pool: pa.Table, queries: QueryBlock, floors: np.ndarray) -> pa.Table:
    """Keep the best ``limit`` rows per query and raise the floors to the last of them."""
    pool = pool.sort_by([("query", "ascending"), ("score", "descending"), *_TIE_ORDER])
    owner = pool.column("query").to_numpy()
    starts = np.searchsorted(owner, owner, side="left")
    place = np.arange(len(owner)) - starts
    kept = pool.filter(pa.array(place < queries.limits[owner]))
    full = place == queries.limits[owner] - 1
    floors[owner[full]] = pool.column("score").to_numpy()[full]
    return kept


def best_of_stream(
    batches: Iterator[pa.Table], queries: QueryBlock, floors: np.ndarray | None = None
) -> pa.Table | None:
    """Running top-k over a stream of batches; memory holds one batch and the k best per query.

    ``floors`` are scores that the k-th row of each query is known to reach; rows below them are left out.
    """
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    pool = None
    for batch in batches:
        if batch.num_rows == 0 or len(queries) == 0:
            continue
        found = score_batch(batch, queries, floors)
        if found is not None:
            pool = found if pool is None else pa.concat_tables([pool, found])
            pool = merge_best(pool, queries, floors)
    return pool
