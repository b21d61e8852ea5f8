"""Keyword top-k that ends early: postings in blocks of documents, with the best frequency of each term in each block.

A block holds documents of one source and of similar length, because a short
document cannot repeat a term often: blocks of long documents carry the high
scores, and most blocks of short ones fall below the k-th score. A search adds
up each block's best frequencies to a bound, scores the blocks with the highest
bounds, and leaves out every block whose bound is below the k-th score found.
What is left out cannot be in the result, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.analysis import PLAIN, Analyzer
from quire.operators.keyword import (
    IN_ROW_TERMS,
    KEYS,
    TERM_PARTS,
    _in_list,
    _source_wanted,
    _term_part,
    _top_hits,
    query_terms,
)
from quire.schemas import check_sources, source_ordinal
from quire.session import materialise

# Documents of a block, on average.
BLOCK_DOCS = 1024
# Blocks of each query that are scored in the first rounds; one more round takes those still above the k-th score.
ROUNDS = (8, 64)
# Scores are rounded to six digits, so a block this close to the k-th score is still scored.
SLACK = 2e-6
# Lengths double in this many steps.
STEPS = 4

_POSTING = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("doc_len", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("term_part", T.IntegerType()),
    ]
)
_BLOCK = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("max_tf", T.IntegerType()),
        T.StructField("term_part", T.IntegerType()),
    ]
)
_TERM = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("n_blocks", T.LongType()),
        T.StructField("term_part", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class BlockIndex:
    """The three stored tables of the index, all in partitions of ``term_part``."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    parts: int


def _level() -> Column:
    return F.floor(F.log2(F.col("doc_len").cast("double")) * STEPS).cast("int")


def with_blocks(postings: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Add ``block``: documents of one source and length level, cut by hash into slices of about ``block_docs``.

    ``postings`` should be stored: it is read twice. The number of slices comes from a count per
    source and level, of which there are at most 6 x 125.
    """
    level = F.struct(source_ordinal("source_type").alias("source"), _level().alias("level"))
    sizes = (
        postings.select(level.alias("at"), *KEYS).distinct().groupBy("at").agg(F.count("*").alias("n"))
        .select("at", F.ceil(F.col("n") / block_docs).alias("slices"))
    )
    placed = postings.withColumn("at", level).join(materialise(sizes, "levels"), "at")
    first = (F.col("at.source") * 128 + F.col("at.level")).cast("long") * F.lit(1 << 32)
    return placed.withColumn("block", first + F.pmod(F.xxhash64(*KEYS), F.col("slices"))).drop("at", "slices")


def write_block_index(
    postings: DataFrame, path: str, block_docs: int = BLOCK_DOCS, parts: int = TERM_PARTS
) -> BlockIndex:
    """Store postings by term and block, the best frequency per term and block, and document counts per term.

    A hot term is counted per block before anything meets in one group, and rebalancing cuts
    its partition into several files.
    """
    placed = with_blocks(postings, block_docs).withColumn("term_part", _term_part(F.col("term"), parts))
    _store(placed.select(_POSTING.names), f"{path}/postings", ["term_part", "term", "block"])
    stored = placed.sparkSession.read.schema(_POSTING).parquet(f"{path}/postings")
    best = stored.groupBy("term_part", "term", "source_type", "block").agg(
        F.count("*").alias("n_docs"), F.max("tf").alias("max_tf")
    )
    _store(best, f"{path}/blocks", ["term_part", "term", "block"])
    blocks = placed.sparkSession.read.schema(_BLOCK).parquet(f"{path}/blocks")
    terms = blocks.groupBy("term_part", "term").agg(F.sum("n_docs").alias("df"), F.count("*").alias("n_blocks"))
    _store(terms, f"{path}/terms", ["term_part", "term"])
    return read_block_index(placed.sparkSession, path, parts)


def _store(rows: DataFrame, path: str, order: list[str]) -> None:
    (
        rows.hint("rebalance", "term_part")
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("term_part")
        .parquet(path)
    )


def read_block_index(spark: SparkSession, path: str, parts: int = TERM_PARTS) -> BlockIndex:
    """A stored index; ``parts`` as when it was written."""
    postings, blocks, terms = (
        spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in (("postings", _POSTING), ("blocks", _BLOCK), ("terms", _TERM))
    )
    return BlockIndex(postings, blocks, terms, parts)


def _of_terms(tables: list[DataFrame], named: DataFrame, parts: int, max_terms: int) -> list[DataFrame]:
    """Rows of the terms in ``named``: by lists in the filter, which prune partitions, or by a join if they are many."""
    there = named.select("term").distinct().withColumn("term_part", _term_part(F.col("term"), parts))
    rows = there.limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        return [t.join(there, ["term_part", "term"], "left_semi") for t in tables]
    numbers = sorted({r.term_part for r in rows})  # at most one per term
    words = F.expr(f"term IN ({_in_list(sorted(r.term for r in rows))})")
    return [t.filter(F.col("term_part").isin(*numbers) & words) for t in tables]


def _asked(queries: DataFrame, index: BlockIndex, analyzer: Analyzer, max_terms: int) -> DataFrame:
    """One row per query and term, with the query's rarest term; queries with a term that no document holds drop out."""
    asked = materialise(query_terms(queries, analyzer), "asked")
    each = asked.select("query_id", "sources", "limit", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    stored = _of_terms([index.terms], each, index.parts, max_terms)[0]
    known = each.join(stored.select("term", "df"), "term")
    rarest = (
        known.groupBy("query_id", "n")
        .agg(F.count("*").alias("found"), F.min(F.struct("df", "term")).alias("rarest"))
        .filter(F.col("found") == F.col("n"))
        .select("query_id", F.col("rarest.term").alias("driver"))
    )
    return materialise(known.drop("df").join(rarest, "query_id"), "asked-terms")


def _bounds(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, limit, block, bound) of blocks that hold every term of the query in a wanted source."""
    return (
        blocks.join(asked, "term")
        .filter(_source_wanted())
        .groupBy("query_id", "limit", "n", "block")
        .agg(F.count("*").alias("found"), F.sum(F.lit(1.0) + F.ln("max_tf")).alias("bound"))
        .filter(F.col("found") == F.col("n"))
        .select("query_id", "limit", "block", "bound")
    )


def _scored(asked: DataFrame, chosen: DataFrame, postings: DataFrame) -> DataFrame:
    """All matches in the chosen blocks: documents of the rarest term first, the other terms then meet these only."""
    wanted = asked.join(chosen.select("query_id", "block"), "query_id")
    driven = wanted.filter(F.col("term") == F.col("driver")).select("query_id", "limit", "n", "term", "block")
    candidates = materialise(postings.select(*KEYS, "term", "tf", "block").join(driven, ["term", "block"]), "candidates")
    others = asked.filter(F.col("term") != F.col("driver")).select("query_id", "term")
    met = (
        candidates.drop("term", "tf")
        .join(others, "query_id")
        .join(postings.select(*KEYS, "term", "tf", "block"), [*KEYS, "block", "term"])
    )
    columns = ["query_id", "limit", "n", *KEYS, "tf"]
    return (
        candidates.select(columns)
        .unionByName(met.select(columns))
        .groupBy("query_id", "limit", "n", *KEYS)
        .agg(F.count("*").alias("found"), F.sum(F.lit(1.0) + F.ln("tf")).alias("score"))
        .filter(F.col("found") == F.col("n"))
        .select("query_id", "limit", *KEYS, F.round("score", 6).alias("score"))
    )


def _best_blocks(open_blocks: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` blocks with the highest bounds per query. Spark cuts every task to ``n`` per query before the shuffle."""
    if n is None:
        return open_blocks
    order = F.struct((-F.col("bound")).alias("b"), "block")
    best = Window.partitionBy("query_id").orderBy(order)
    return open_blocks.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).drop("_r")


def _search(
    queries: DataFrame,
    index: BlockIndex,
    sources: list[str] | None,
    analyzer: Analyzer,
    max_terms: int,
    rounds: tuple[int, ...],
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    wanted = check_sources(sources)
    asked = _asked(queries, index, analyzer, max_terms)
    tables = [index.postings, index.blocks]
    if len(wanted) < 5:
        tables = [t.filter(F.col("source_type").isin(*wanted)) for t in tables]
    postings, blocks = _of_terms(tables, asked, index.parts, max_terms)
    bounds = waiting = materialise(_bounds(asked, blocks), "bounds")
    hits, read = None, []
    for n in (*rounds, None):
        chosen = materialise(_best_blocks(waiting, n), "chosen")
        if chosen.isEmpty():
            break
        read.append(chosen)
        found = _scored(asked, chosen, postings)
        if hits is not None:
            limits = asked.select("query_id", "limit").distinct()
            found = found.unionByName(hits.drop("rank").join(limits, "query_id").select(found.columns))
        hits = materialise(_top_hits(found).select("query_id", "rank", *KEYS, "score"), "hits")
        floors = hits.groupBy("query_id").agg(F.count("*").alias("_hits"), F.min("score").alias("_floor"))
        left = waiting.join(chosen.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floors, "query_id", "left")
        above = F.col("_floor").isNull() | (F.col("_hits") < F.col("limit")) | (F.col("bound") + SLACK >= F.col("_floor"))
        waiting = materialise(left.filter(above).select(bounds.columns), "waiting")
    if hits is None:
        hits = _top_hits(_scored(asked, bounds, postings)).select("query_id", "rank", *KEYS, "score")
    return hits, bounds, read


def search_blocks(
    queries: DataFrame,
    index: BlockIndex,
    sources: list[str] | None = None,
    analyzer: Analyzer = PLAIN,
    max_terms: int = IN_ROW_TERMS,
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """The log-tf ranking of :func:`quire.operators.keyword.keyword_search`: query_id, rank, source_type, source_id, score.

    ``queries`` is (query_id, query[, sources, limit]). The result does not depend on ``rounds``.
    """
    return _search(queries, index, sources, analyzer, max_terms, rounds)[0]


def blocks_scored(
    queries: DataFrame,
    index: BlockIndex,
    sources: list[str] | None = None,
    analyzer: Analyzer = PLAIN,
    max_terms: int = IN_ROW_TERMS,
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """What a search skips: (query_id, n_blocks that hold all terms, n_scored of them)."""
    _, bounds, read = _search(queries, index, sources, analyzer, max_terms, rounds)
    every = bounds.groupBy("query_id").agg(F.count("*").alias("n_blocks"))
    scored = reduce(DataFrame.unionByName, read, bounds.limit(0)).groupBy("query_id").agg(F.count("*").alias("n_scored"))
    return every.join(scored, "query_id", "left").fillna(0, ["n_scored"])
