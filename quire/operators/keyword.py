"""Term index and keyword search, in two stored forms.

The index is one row per document with its term vector: the counterpart of a
stored text-search column. Building it is a single narrow pass, because a
document's terms are counted inside its own row. Searching a batch of queries
keeps work inside the row as well: a document is paired with a query only
through one rare term of that query, all other terms are checked in place, and
only true matches reach the shuffle for the top-k. That reads the whole index
once for the whole batch. For a few queries over a large corpus the postings
form reads only the partitions that hold their terms.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.analysis import PLAIN, Analyzer
from quire.functions.stem_steps import stems
from quire.functions.text import snippet
from quire.schemas import CARD_COLUMNS, MAX_LIMIT, check_sources, normalised_limit, source_ordinal
from quire.session import materialise

RANKERS = ("log_tf", "bm25")
BM25_K1 = 1.2
BM25_B = 0.75
# A batch with at most this many distinct terms is matched inside the index rows.
IN_ROW_TERMS = 20_000
# Copies of each query over which one hot term is spread in the shuffled form.
TERM_SALTS = 16

# Partitions of a stored postings table.
TERM_PARTS = 256
# Stored bytes of postings that are shuffled at a time, for shuffle files take several times as much.
SLICE_BYTES = 512 << 20

KEYS = ["source_type", "source_id"]


def searchable_text(source_type: Column, title: Column, content: Column) -> Column:
    """Verses index their text only, everything else title and text alike."""
    return F.when(source_type == "scriptures", content).otherwise(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    )


def hit_text(source_type: Column, content: Column) -> Column:
    """Verse hits show the whole verse, other hits a snippet."""
    return F.when(source_type == "scriptures", content).otherwise(snippet(content))


def build_term_index(corpus: DataFrame, analyzer: Analyzer = PLAIN) -> DataFrame:
    """(source_type, source_id, doc_len, terms[{term, tf}], card columns) per document.

    Terms are counted by sorting the document's tokens and measuring the runs.
    Store the result and search the stored table.
    """
    text = searchable_text(F.col("source_type"), F.col("title"), F.col("content"))
    cards = [
        hit_text(F.col("source_type"), F.col("content")).alias("snippet") if c == "snippet" else F.col(c)
        for c in CARD_COLUMNS
    ]
    # always true, but Spark does not push filters through it: pushed further down they
    # would repeat the tokenising for every token
    sorted_tokens = F.when(F.rand() >= 0.0, F.sort_array(analyzer.tokens(text)))
    tokenised = corpus.select(*KEYS, *cards, sorted_tokens.alias("_tokens"))
    runs = tokenised.withColumn("doc_len", F.size("_tokens")).withColumn(
        "_starts",
        F.filter(
            F.transform(
                "_tokens",
                lambda t, i: F.when((i == 0) | (t != F.get("_tokens", i - 1)), i),
            ),
            lambda start: start.isNotNull(),
        ),
    )
    terms = F.transform(
        "_starts",
        lambda start, j: F.struct(
            F.get("_tokens", start).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.col("doc_len")) - start).alias("tf"),
        ),
    )
    return runs.withColumn("terms", terms).drop("_tokens", "_starts")


def build_postings(corpus: DataFrame, analyzer: Analyzer = PLAIN) -> DataFrame:
    """The index turned sideways: (source_type, source_id, term, tf, doc_len)."""
    # the outer form, because the inner one makes Spark count twice, once to test for emptiness
    return (
        build_term_index(corpus, analyzer)
        .select(*KEYS, "doc_len", F.inline_outer("terms"))
        .filter(F.col("term").isNotNull())
        .select(*KEYS, "term", "tf", "doc_len")
    )


def _slices(postings: DataFrame, slice_bytes: int) -> int:
    """Slices of ``slice_bytes`` in a stored table; 1 for what is made by more than reading, which slices would repeat."""
    plan = postings._jdf.queryExecution().optimizedPlan()
    kinds = {re.match(r"[\s:+\-|]*(\w*)", line)[1] for line in plan.toString().strip().split("\n")}
    if not kinds <= {"Relation", "Project", "Filter", "Union"}:
        return 1
    return max(1, -(-int(str(plan.stats().sizeInBytes())) // slice_bytes))


def _in_slices(postings: DataFrame, slice_bytes: int) -> Iterator[DataFrame]:
    """``postings`` in slices by document, one after the other; shuffle files of a slice go before the next one."""
    n = _slices(postings, slice_bytes)
    for i in range(n):
        yield postings if n == 1 else postings.filter(F.pmod(F.xxhash64(*KEYS), F.lit(n)) == i)
        if n > 1:
            gc.collect()
            postings.sparkSession._jvm.System.gc()  # Spark drops the shuffle files of what is not referred to any more


def stemmed_postings(postings: DataFrame, vocabulary: DataFrame | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Plain postings under the stems of their terms: frequencies of terms with one stem are added up.

    ``vocabulary`` is (term, stem), for instance a stored one; by default the distinct terms of
    the postings are stemmed in one table. A task holds the words of its share of the terms in a hash table;
    a hot term is counted per document, so it does not pile up. A large table is stemmed in slices of documents, each
    stored before the next, so shuffle files never take more disk than one slice's.
    """
    if vocabulary is None:
        vocabulary = materialise(stems(postings.select("term").distinct()), "stems")

    def stemmed(some: DataFrame) -> DataFrame:
        # else every posting is sorted by its term first
        named = some.join(vocabulary.hint("shuffle_hash"), "term").select(*KEYS, F.col("stem").alias("term"), "tf", "doc_len")
        return named.groupBy(*KEYS, "doc_len", "term").agg(F.sum("tf").cast("int").alias("tf")).select(*KEYS, "term", "tf", "doc_len")

    if _slices(postings, slice_bytes) == 1:
        return stemmed(postings)
    return reduce(DataFrame.unionByName, [materialise(stemmed(some), "stemmed", compression="zstd") for some in _in_slices(postings, slice_bytes)])


def query_terms(queries: DataFrame, analyzer: Analyzer = PLAIN) -> DataFrame:
    """(query_id, sources, limit, terms): distinct sorted terms; queries without any drop out."""
    optional = {
        "sources": F.lit(None).cast("array<string>"),
        "limit": F.lit(None).cast("int"),
    }
    return (
        queries.select(
            "query_id",
            F.when(F.trim("query") != "", F.col("query")).alias("query"),
            *[F.col(c) if c in queries.columns else v.alias(c) for c, v in optional.items()],
        )
        .select(
            "query_id",
            "sources",
            normalised_limit(F.col("limit")).alias("limit"),
            analyzer.distinct_terms(F.col("query")).alias("terms"),
        )
        .filter(F.size("terms") > 0)
    )


def _source_wanted() -> Column:
    """Per-query source lists; a missing or empty list means every source."""
    return (
        F.col("sources").isNull()
        | (F.size("sources") == 0)
        | F.array_contains("sources", F.col("source_type"))
    )


def _in_list(terms: list[str]) -> str:
    # terms hold letters and digits only, so they need no quoting beyond this
    return ", ".join(f"'{t}'" for t in terms) or "''"


def _driver_term() -> Column:
    """The term that pairs a query with documents: the longest, hence usually the rarest."""
    return F.array_min(
        F.transform("terms", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("term")))
    ).getField("term")


def _rank_weights(asked: DataFrame, index: DataFrame, vocabulary: str | None, ranker: str) -> DataFrame:
    """Add ``weights`` (one per term) and, for BM25, ``mean_len``; document counts span all sources."""
    if ranker == "log_tf":
        return asked.withColumn("weights", F.transform("terms", lambda t: F.lit(1.0))).withColumn(
            "mean_len", F.lit(1.0)
        )
    wanted = F.col("terms")
    if vocabulary is not None:
        wanted = F.expr(f"filter(terms, t -> t.term IN ({vocabulary}))")
    frequency = (
        index.select(F.explode(wanted).alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.count("*").alias("df"))
    )
    totals = index.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("mean_len")).first()
    df = F.coalesce("df", F.lit(0))
    weighted = (
        asked.select("query_id", F.explode("terms").alias("term"))
        .join(frequency, "term", "left")
        .select("query_id", "term", F.log1p((totals.n_docs - df + 0.5) / (df + 0.5)).alias("idf"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_w"))
        .select("query_id", F.col("_w.idf").alias("weights"))
    )
    return asked.join(weighted, "query_id").withColumn("mean_len", F.lit(totals.mean_len))


def _score(ranker: str) -> Column:
    """Sum over the query's terms, in term order, from the document's ``hits``."""
    found = F.map_from_arrays(F.col("hits.term"), F.col("hits.tf"))
    if ranker == "log_tf":
        parts = F.transform(
            "terms", lambda t, i: F.lit(1.0) + F.ln(F.element_at(found, t).cast("double"))
        )
    else:
        norm = BM25_K1 * (F.lit(1 - BM25_B) + BM25_B * F.col("doc_len") / F.col("mean_len"))
        parts = F.transform(
            "terms",
            lambda t, i: F.get("weights", i)
            * (F.element_at(found, t) * (BM25_K1 + 1.0))
            / (F.element_at(found, t) + norm),
        )
    return F.round(F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part), 6)


def _top_hits(matches: DataFrame) -> DataFrame:
    """Best ``limit`` matches of each query.

    The constant bound lets Spark cut every task to its own top 100 per query
    before the shuffle, so a query that matches a third of the corpus is cheap.
    """
    best = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), source_ordinal("source_type"), "source_id"
    )
    return (
        matches.withColumn("rank", F.row_number().over(best))
        .filter((F.col("rank") <= MAX_LIMIT) & (F.col("rank") <= F.col("limit")))
        .drop("limit")
    )


def _vocabulary(asked: DataFrame, bound: int) -> tuple[list[str], list[str]] | None:
    """All terms of a batch and those that pair; None when there are more than ``bound``."""
    # bounded fetch: at most one row more than is admitted
    rows = (
        asked.select(F.explode("terms").alias("term"), "driver")
        .groupBy("term")
        .agg(F.max(F.col("term") == F.col("driver")).alias("drives"))
        .limit(bound + 1)
        .collect()
    )
    if len(rows) > bound:
        return None
    return sorted(r.term for r in rows), sorted(r.term for r in rows if r.drives)


def keyword_search(
    queries: DataFrame,
    index: DataFrame,
    sources: list[str] | None = None,
    analyzer: Analyzer = PLAIN,
    ranker: str = "log_tf",
    in_row_terms: int = IN_ROW_TERMS,
) -> DataFrame:
    """Documents holding all terms of a query, best first.

    ``queries`` is (query_id, query[, sources, limit]); ``index`` comes from
    :func:`build_term_index` with the same analyzer. Result: query_id, rank,
    source_type, source_id, score and the card columns.
    """
    if ranker not in RANKERS:
        raise ValueError(f"unknown ranker {ranker!r}; choose from {RANKERS}")
    wanted = check_sources(sources)
    # stored, so that the queries are analysed once and Spark knows their true size
    asked = materialise(query_terms(queries, analyzer).withColumn("driver", _driver_term()), "asked")
    searched = index if len(wanted) == 5 else index.filter(F.col("source_type").isin(*wanted))
    vocabulary = _vocabulary(asked, in_row_terms)
    if vocabulary is not None:
        matches = _match_in_row(asked, searched, index, *vocabulary, ranker)
    else:
        matches = _match_shuffled(asked, searched, index, ranker)
    scored = matches.select(
        "query_id", "limit", *KEYS, _score(ranker).alias("score"), *CARD_COLUMNS
    )
    return _top_hits(scored).select("query_id", "rank", *KEYS, "score", *CARD_COLUMNS)


def _all_terms_found() -> Column:
    return F.size(F.array_intersect(F.col("terms"), F.col("hits.term"))) == F.size("terms")


def _match_in_row(
    asked: DataFrame,
    searched: DataFrame,
    index: DataFrame,
    vocabulary: list[str],
    drivers: list[str],
    ranker: str,
) -> DataFrame:
    """One pass over the index; nothing but matches leaves the row.

    Both lists are bounded, and Spark broadcasts the stored queries only if their size allows.
    """
    if ranker != "log_tf":
        asked = materialise(_rank_weights(asked, index, _in_list(vocabulary), ranker), "weighted")
    else:
        asked = _rank_weights(asked, index, None, ranker)
    narrowed = searched.select(
        *KEYS,
        "doc_len",
        *CARD_COLUMNS,
        F.expr(f"filter(terms, t -> t.term IN ({_in_list(vocabulary)}))").alias("hits"),
    )
    paired = narrowed.select(
        "*", F.explode(F.expr(f"filter(hits.term, t -> t IN ({_in_list(drivers)}))")).alias("driver")
    )
    return paired.join(asked, "driver").filter(_source_wanted() & _all_terms_found())


def _match_shuffled(asked: DataFrame, searched: DataFrame, index: DataFrame, ranker: str) -> DataFrame:
    """For batches too large to broadcast: pair on the rare term, then fetch the term vector.

    A hot term is spread over salts by document; every query is copied to all
    salts, which is cheap because the query side is the small one.
    """
    asked = _rank_weights(asked, index, None, ranker)
    salt = F.pmod(F.xxhash64(*KEYS), F.lit(TERM_SALTS)).cast("int")
    postings = searched.select(*KEYS, salt.alias("salt"), F.explode("terms.term").alias("driver"))
    drivers = asked.select("query_id", "driver", "sources").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
    )
    pairs = (
        postings.join(drivers, ["driver", "salt"]).filter(_source_wanted()).select("query_id", *KEYS)
    )
    wanted = pairs.join(asked.drop("driver", "sources"), "query_id")
    return (
        wanted.join(searched.withColumnRenamed("terms", "_all"), KEYS)
        .filter(F.size(F.array_intersect(F.col("terms"), F.col("_all.term"))) == F.size("terms"))
        .withColumn("hits", F.filter("_all", lambda h: F.array_contains("terms", h.getField("term"))))
    )


# --- postings form --------------------------------------------------------------


def _term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def write_postings(postings: DataFrame, path: str, parts: int = TERM_PARTS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Store postings by hash of the term, sorted by term inside each file.

    Rebalancing cuts the partition of a hot term into several files. A large stored table is dealt out in
    slices of documents, each with files of its own.
    """
    spark = postings.sparkSession
    schema = postings.withColumn("term_part", _term_part(F.col("term"), parts)).schema
    for i, some in enumerate(_in_slices(postings, slice_bytes)):
        (
            some.withColumn("term_part", _term_part(F.col("term"), parts))
            .hint("rebalance", "term_part")
            .sortWithinPartitions("term_part", "term")
            .write.mode("append" if i else "overwrite")
            .partitionBy("term_part")
            .parquet(path)
        )
    return spark.read.schema(schema).parquet(path)


def search_postings(
    queries: DataFrame,
    postings: DataFrame,
    sources: list[str] | None = None,
    analyzer: Analyzer = PLAIN,
    parts: int = TERM_PARTS,
    max_terms: int = IN_ROW_TERMS,
) -> DataFrame:
    """The log-tf ranking of :func:`keyword_search` from a stored postings table, without card columns.

    Only partitions with a query term are read; a batch of more than ``max_terms`` distinct
    terms finds its postings by a join instead of lists in the filter. The postings of each query's
    rare term give the candidates. These are stored, so their size is known, and joined
    with the query's terms first; postings then meet them by document and term, so a hot
    term is spread over its documents.
    """
    wanted = check_sources(sources)
    # stored, so that the queries are analysed once and Spark knows their true size
    asked = materialise(query_terms(queries, analyzer).withColumn("driver", _driver_term()), "asked")
    each = asked.select("query_id", "limit", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    terms, drivers = _vocabulary(asked, max_terms) or (None, None)
    searched = postings if len(wanted) == 5 else postings.filter(F.col("source_type").isin(*wanted))

    spark = postings.sparkSession

    def lists(of: list[str] | None, named: DataFrame) -> DataFrame:
        if of is None:
            there = named.distinct().withColumn("term_part", _term_part(F.col("term"), parts))
            return searched.join(there, ["term_part", "term"], "left_semi")
        places = spark.createDataFrame([(t,) for t in of], "term string").select(
            _term_part(F.col("term"), parts).alias("part")
        )
        numbers = sorted({r.part for r in places.collect()})  # at most one per term
        return searched.filter(F.col("term_part").isin(*numbers)).filter(F.expr(f"term IN ({_in_list(of)})"))

    candidates = materialise(
        lists(drivers, asked.select(F.col("driver").alias("term")))
        .join(asked.withColumnRenamed("driver", "term"), "term")
        .filter(_source_wanted())
        .select("query_id", *KEYS),
        "candidates",
    )
    scored = (
        candidates.join(each, "query_id")
        .join(lists(terms, each.select("term")), [*KEYS, "term"])
        .groupBy("query_id", "limit", "n", *KEYS)
        .agg(F.count("*").alias("found"), F.sum(F.lit(1.0) + F.ln("tf")).alias("score"))
        .filter(F.col("found") == F.col("n"))
        .select("query_id", "limit", *KEYS, F.round("score", 6).alias("score"))
    )
    return _top_hits(scored).select("query_id", "rank", *KEYS, "score")
