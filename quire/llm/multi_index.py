"""Inverted multi-index for largest inner products: two quantised halves, cells of centroid pairs, exact reranking.

Each half of a vector is lifted by one coordinate that makes all halves equally
long, and a query's half by 0. The squared distance of query and vector, summed
over both halves, is then a constant less twice their inner product, so
centroid pairs in ascending order of summed distance promise falling products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store

#: Rows of the codebooks' sample, and of the queries by which the visits are set.
FIT_ROWS, TUNE_QUERIES = 20_000, 200
#: Vectors a cell holds on average, until a half has ``MOST_CENTROIDS``.
ROWS_PER_CELL, MOST_CENTROIDS = 12, 1024
TARGET_RECALL = 0.97
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Scores this close, in units of the product of norms, are told apart by the exact measure alone.
_CLOSE = 1e-9


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x): one row per id, of the vectors that take part.

    Null ids, null or empty vectors, zero vectors and those with null or
    non-finite components are out, as are vectors of another length than the most
    frequent one (the shorter on ties). Of several vectors of one id the smallest,
    component by component, counts.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    fine = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0)).filter(fine)
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("x") == (length[0]["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def _centres(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means; a centre that loses all its points stays where it is."""
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Codebook:
    """Centroids of the two lifted halves, and the squared lengths that vectors are lifted to."""

    middle: int
    lengths: tuple[float, float]
    centres: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, longest: tuple[float, float], k: int) -> Codebook:
        book = cls(sample.shape[1] // 2, longest, (np.empty(0), np.empty(0)))
        book.centres = tuple(_centres(half, min(k, len(half))) for half in book.lifted(sample))
        return book

    def lifted(self, x: np.ndarray) -> list[np.ndarray]:
        halves = x[:, : self.middle], x[:, self.middle :]
        return [np.column_stack([h, np.sqrt(np.maximum(0, most - (h**2).sum(axis=1)))]) for h, most in zip(halves, self.lengths, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = (_nearest(h, c) for h, c in zip(self.lifted(x), self.centres, strict=True))
        return first * len(self.centres[1]) + second

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of one query's halves to the centroids, less what is the same for all of them."""
        halves = q[: self.middle], q[self.middle :]
        one, two = ((c**2).sum(axis=1) - 2 * c[:, :-1] @ h for h, c in zip(halves, self.centres, strict=True))
        return one, two


def visit(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, least: int) -> tuple[list[int], float]:
    """Cells with entries in ascending order of summed distance until they hold ``least``, and the last sum.

    The two lists of distances are sorted; a heap holds at most one candidate
    pair per place of the first list. A pair joins it once both its
    predecessors, in either list, have left.
    """
    by_one, by_two = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    d1, d2 = one[by_one].tolist(), two[by_two].tolist()
    r1, r2 = by_one.tolist(), by_two.tolist()
    width, reached = len(r2), [0] * len(r1)  # pairs (i, j) with j < reached[i] have left the heap
    heap, found, held, last = [(d1[0] + d2[0], 0, 0)], [], 0, float("-inf")
    while heap and held < least:
        last, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        cell = r1[i] * width + r2[j]
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(r1) and reached[i + 1] == j:
            heapq.heappush(heap, (d1[i + 1] + d2[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
    return found, last


def _deal(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share one in order, a large one has several."""
    parts = np.maximum(1, -(-sizes // rows))
    first, block, room = np.zeros(len(sizes), np.int64), 0, rows
    for cell in np.nonzero(sizes)[0]:
        n = int(sizes[cell])
        if n > room and room < rows:
            block, room = block + 1, rows
        first[cell] = block
        if parts[cell] > 1:
            block, room = block + int(parts[cell]), rows
        else:
            room -= n
    return first, parts


@dataclass
class MultiIndex:
    """Codebook, number of entries of each cell, the cells' blocks, and ``entries`` (block, cell, x, ids)."""

    book: Codebook
    sizes: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    entries: DataFrame


def build(rows: DataFrame, keep: int, store: Store, fit_rows: int = FIT_ROWS, rows_per_cell: int = ROWS_PER_CELL, block_rows: int = BLOCK_ROWS) -> MultiIndex | None:
    """Index of all ``rows`` (vec_id, x); None when there are none.

    Equal vectors are one entry with the ``keep`` smallest ids, the only ones of
    them that can be among the ``keep`` nearest of any query. The codebooks are
    fitted on about ``fit_rows`` entries chosen by hash; every row is indexed.
    What reaches the driver is bounded: the sample, and one number per cell
    (``MOST_CENTROIDS`` squared).
    """
    few = rows.withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("i") <= keep)
    entries = store.save(few.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    middle = F.expr("cast(size(x) / 2 as int)")
    squares = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    halves = squares(F.slice("x", F.lit(1), middle)), squares(F.slice("x", middle + 1, F.size("x")))
    n, *longest = entries.agg(F.count("*"), *[F.max(h) for h in halves]).first()
    if not n:
        return None
    spot = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 30))
    sample = entries.filter(spot < int((1 << 30) * min(1.0, fit_rows / n))).select("x").limit(2 * fit_rows).toArrow()
    points = _matrix(sample["x"]) if sample.num_rows else _matrix(entries.select("x").limit(1).toArrow()["x"])
    points = points[np.lexsort(points.T)]  # the same codebook whatever order the rows came in
    book = Codebook.fit(points, tuple(longest), int(min(MOST_CENTROIDS, max(1, (n / rows_per_cell) ** 0.5))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pa.array(book.cells(_matrix(batch.column("x"))), pa.int64())
                yield pa.RecordBatch.from_arrays([cells, *batch.columns], ["cell", *batch.schema.names])

    placed = entries.mapInArrow(assign, f"cell bigint, {entries.schema.simpleString()[7:-1].replace(':', ' ')}")
    placed = store.save(placed, "cells")
    sizes = np.zeros(len(book.centres[0]) * len(book.centres[1]), np.int64)
    counted = placed.groupBy("cell").count().toArrow()
    sizes[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    first, parts = _deal(sizes, block_rows)
    return MultiIndex(book, sizes, first, parts, placed)


def _best(queries: np.ndarray, x: np.ndarray, allowed: np.ndarray | None, ids: list[list[int]], k: int) -> list[list[tuple[float, int, int]]]:
    """For each query the ``k`` best (-score, id, row of x); scores are sums of products in the order of one row."""
    rough = queries @ x.T
    if allowed is not None:
        rough = np.where(allowed, rough, -np.inf)
    slack = _CLOSE * np.sqrt((queries**2).sum(axis=1) * (x**2).sum(axis=1).max())
    out = []
    for i, scores in enumerate(rough):
        if len(scores) > k:
            close = np.nonzero(scores >= np.partition(scores, -k)[-k] - slack[i])[0]
        else:
            close = np.arange(len(scores))
        close = close[scores[close] > -np.inf]
        exact = (x[close] * queries[i]).sum(axis=1)
        ranked = sorted((-s, v, int(row)) for s, row in zip(exact.tolist(), close, strict=True) for v in ids[row])
        out.append(ranked[:k])
    return out


def visits_for(index: MultiIndex, queries: DataFrame, k: int, target: float = TARGET_RECALL, most: int = TUNE_QUERIES) -> int:
    """Entries a query has to visit so that a share ``target`` of true neighbours is among them.

    It is measured: about ``most`` queries, chosen by hash, meet all entries in one
    pass, and the depth of each true neighbour's cell in the order of cells is
    looked up. With one centroid a half or ``target`` 1, all are visited.
    """
    book, sizes = index.book, index.sizes
    total = int(sizes.sum())
    n = queries.count()
    spot = F.pmod(F.xxhash64("query", F.lit("tune")), F.lit(1 << 30))
    chosen = queries.filter(spot < int((1 << 30) * min(1.0, most / max(n, 1)))).limit(2 * most).toArrow()
    if not chosen.num_rows or len(sizes) == 1 or target >= 1:
        return total
    probes = _matrix(chosen["x"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, int, int]]] = [[] for _ in probes]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_pylist()
            found = _best(probes, _matrix(batch.column("x")), None, [[v] for v in range(batch.num_rows)], k)
            kept = [sorted([*old, *((s, cells[row], 0) for s, _, row in new)])[:k] for old, new in zip(kept, found, strict=True)]
        rows = [(i, -s, cell) for i, one in enumerate(kept) for s, cell, _ in one]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        kinds = [pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "score", "cell"])

    each = index.entries.select("cell", "x").mapInArrow(nearest, "query bigint, score double, cell bigint")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
    true = each.withColumn("i", order).filter(F.col("i") <= k).groupBy("query").agg(F.collect_list("cell").alias("cells")).collect()
    depths: list[int] = []
    for r in true:
        one, two = book.distances(probes[r["query"]])
        sums = (one[:, None] + two[None, :]).ravel()
        way = np.argsort(sums, kind="stable")
        held = np.empty(len(sums), np.int64)
        held[way] = np.cumsum(sizes[way])
        depths += held[r["cells"]].tolist()
    return int(np.sort(depths)[min(len(depths) - 1, int(target * len(depths)))])


def search(index: MultiIndex, queries: DataFrame, k: int, visits: int, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, found): the ``k`` best (score, vec_id) among the entries that each of ``queries`` (query, x) visits.

    A query walks the centroid pairs until their cells hold ``visits`` entries, and is sent to those
    blocks that hold such cells, with the summed distance at which the walk ended: a block's cells up to it are
    the visited ones. Blocks hold at most ``block_rows`` entries and meet at most ``query_rows``
    queries at a time, dealt so that queries of neighbouring cells go together;
    neither a crowded cell nor a crowd of queries ends up in one task.
    """
    book, sizes, first, parts = index.book, index.sizes, index.first, index.parts
    width = len(book.centres[1])
    names = queries.schema["x"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pa.array(book.cells(_matrix(batch.column("x"))), pa.int64())
                yield pa.RecordBatch.from_arrays([cells, batch.column("query"), batch.column("x")], ["own", "query", "x"])

    owned = queries.select("query", "x").mapInArrow(own, f"own bigint, query bigint, x {names}")
    counted = owned.groupBy("own").count().toArrow()
    crowd = np.zeros(len(sizes), np.int64)
    crowd[counted["own"].to_numpy()] = counted["count"].to_numpy()
    chunk_first, chunk_parts = _deal(crowd, query_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, blocks, rows, ends = [], [], [], []
            x = _matrix(batch.column("x")) if batch.num_rows else []
            for row, (q, at, query) in enumerate(zip(x, batch.column("own").to_pylist(), batch.column("query").to_pylist(), strict=True)):
                found, end = visit(*book.distances(q), sizes, visits)
                mine = {int(first[c]) + p for c in found for p in range(int(parts[c]))}
                chunk = int(chunk_first[at]) + query * 0x9E3779B1 % int(chunk_parts[at])
                chunks += [chunk] * len(mine)
                blocks += sorted(mine)
                rows += [row] * len(mine)
                ends += [end] * len(mine)
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(chunks, pa.int64()), pa.array(blocks, pa.int64()), pa.array(ends, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, taken.column("query"), taken.column("x")], ["chunk", "block", "end", "query", "x"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            lead = np.array([v[0] for v in batch.column("ids").to_pylist()], np.int64)
            block = first[cells] + lead * 0x9E3779B1 % parts[cells] if len(cells) else cells
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int]] = []
        if left.num_rows and right.num_rows:
            q, x, cells = _matrix(left["x"]), _matrix(right["x"]), right["cell"].to_numpy()
            ids, names = right["ids"].to_pylist(), left["query"].to_pylist()
            ends = left["end"].to_numpy()
            for i in range(0, len(q), 512):
                some = q[i : i + 512]
                sums = np.stack([one[cells // width] + two[cells % width] for one, two in map(book.distances, some)])
                allowed = sums <= ends[i : i + 512, None]
                for name, best in zip(names[i : i + 512], _best(some, x, allowed, ids, k), strict=True):
                    out += [(name, -s, v) for s, v, _ in best]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        kinds = [pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "score", "vec_id"])

    sent = owned.mapInArrow(route, f"chunk bigint, block bigint, end double, query bigint, x {names}")
    kind = index.entries.schema["x"].dataType.simpleString()
    held = index.entries.mapInArrow(blocked, f"block bigint, cell bigint, x {kind}, ids array<bigint>")
    spark = queries.sparkSession
    store = Store(spark, "multi-index-search", "multi-index")
    sent = store.save(sent, "routes")
    asked = sent.select(F.col("block").alias("met_block"), F.col("chunk").alias("met_chunk")).distinct()
    held = held.join(asked, F.col("block") == F.col("met_block"))
    met = sent.groupBy("chunk", "block").cogroup(held.groupBy("met_chunk", "met_block")).applyInArrow(meet, "query bigint, score double, vec_id bigint")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = met.withColumn("i", order).filter(F.col("i") <= k)
    hits = F.transform(F.sort_array(F.collect_list(F.struct("i", "score", "vec_id"))), lambda h: F.struct(h["score"].alias("score"), h["vec_id"].alias("vec_id")))
    return best.groupBy("query").agg(hits.alias("found"))


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    target: float = TARGET_RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, store: Store | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides.

    Nearness is the largest inner product in double precision; ties go to the smaller id; a
    query is not its own neighbour. Which rows take part, and what repeated ids mean, is
    said at ``usable``; other columns, of whatever name, are not read. Queries with equal
    vectors are searched once, for one neighbour more than asked, and each leaves itself out.
    Of a table without usable vectors the result is empty.
    """
    store = store or Store(vectors.sparkSession, "multi-index")
    rows = store.save(usable(vectors, key, vector), "usable")
    index = build(rows, k + 1, store, block_rows=block_rows)
    asked = rows.filter(F.col("vec_id") % every == 0)
    kinds = store.save(asked.groupBy("x").agg(F.min("vec_id").alias("query")), "queries")
    if index is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    visits = max(k + 1, visits_for(index, kinds, k, target))
    found = store.save(search(index, kinds, k + 1, visits, query_rows, block_rows), "found")
    named = asked.join(kinds, "x").select(F.col("vec_id").alias("query_id"), "query")
    others = F.slice(F.filter("found", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    each = named.join(found, "query").select("query_id", F.posexplode(others).alias("i", "h"))
    return each.select("query_id", (F.col("i") + 1).alias("rank"), "h.vec_id", "h.score")
