"""Phrase search: postings with the places of each term.

A document holds a phrase where the places of its terms, each shifted back by
the term's place in the phrase, have a common start. The shifts are compared as
arrays inside one row per query and document, so no place is ever a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.analysis import PLAIN, Analyzer
from quire.operators.keyword import KEYS, _source_wanted, _top_hits, searchable_text
from quire.schemas import check_sources, normalised_limit
from quire.session import materialise


def build_positions(corpus: DataFrame, analyzer: Analyzer = PLAIN) -> DataFrame:
    """(source_type, source_id, term, positions, doc_len): ascending places from 0 among the kept tokens.

    Counted inside the document's own row, without a shuffle: tokens are sorted with their
    places, and each run of one token is a slice of that array.
    """
    text = searchable_text(F.col("source_type"), F.col("title"), F.col("content"))
    placed = F.sort_array(F.transform(analyzer.tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("at"))))
    # stored in the plan by an explode of one element, so that the sorting is not repeated in each later expression
    sorted_tokens = corpus.select(*KEYS, F.explode(F.array(placed)).alias("_s")).withColumn("doc_len", F.size("_s"))
    starts = F.filter(
        F.transform("_s", lambda t, i: F.when((i == 0) | (t["term"] != F.get("_s", i - 1)["term"]), i)),
        lambda start: start.isNotNull(),
    )
    runs = sorted_tokens.select("*", F.explode(F.array(starts)).alias("_starts"))
    ends = F.transform("_starts", lambda s, j: F.coalesce(F.get("_starts", j + 1), F.col("doc_len")))
    terms = F.zip_with(
        "_starts",
        ends,
        lambda s, e: F.struct(F.get("_s", s)["term"].alias("term"), F.slice("_s", s + 1, e - s)["at"].alias("positions")),
    )
    return runs.select(*KEYS, "doc_len", F.inline(terms)).select(*KEYS, "term", "positions", "doc_len")


def search_phrases(
    queries: DataFrame, positions: DataFrame, sources: list[str] | None = None, analyzer: Analyzer = PLAIN
) -> DataFrame:
    """Documents that hold the whole phrase, most occurrences first: query_id, rank, source_type, source_id, n_found, score.

    ``queries`` is (query_id, query[, sources, limit]); the analyzer drops stop words on both sides, so a
    phrase may skip them. Occurrences may overlap. The score is 1 + ln(n_found). Phrases without terms find nothing.
    The phrase's longest term gives candidates, which are stored; the other terms meet these by document and term.
    """
    wanted = check_sources(sources)
    searched = positions if len(wanted) == 5 else positions.filter(F.col("source_type").isin(*wanted))
    optional = {"sources": F.lit(None).cast("array<string>"), "limit": F.lit(None).cast("int")}
    said = queries.select(
        "query_id",
        analyzer.tokens(F.col("query")).alias("_terms"),
        *[F.col(c) if c in queries.columns else value.alias(c) for c, value in optional.items()],
    ).filter(F.size("_terms") > 0)
    # the place of the first of the longest terms,
    lengths = F.transform("_terms", lambda t: F.length(t))
    longest = F.array_position(lengths, F.array_max(lengths)).cast("int") - 1
    each = materialise(
        said.withColumn("driver", longest).select(
            "query_id", "sources", normalised_limit(F.col("limit")).alias("limit"), F.size("_terms").alias("n"),
            "driver", F.posexplode("_terms").alias("i", "term"),
        ),
        "phrases",
    )

    # only postings of the phrases' terms go on; Spark sends the terms to every task if their table is small
    searched = searched.join(each.select("term").distinct(), "term", "left_semi")

    def shifted(rows: DataFrame) -> DataFrame:
        """Where the phrase would start, from the places of its ``i``-th term."""
        back = F.filter(F.transform("positions", lambda p: p - F.col("i")), lambda p: p >= 0)
        return rows.select("query_id", "limit", "n", *KEYS, back.alias("starts"))

    first = each.filter(F.col("i") == F.col("driver"))
    candidates = materialise(shifted(first.join(searched, "term").filter(_source_wanted())), "candidates")
    rest = each.filter(F.col("i") != F.col("driver")).select("query_id", "i", "term")
    others = shifted(candidates.drop("starts").join(rest, "query_id").join(searched, [*KEYS, "term"]))
    met = (
        candidates.unionByName(others)
        .groupBy("query_id", "limit", "n", *KEYS)
        .agg(F.collect_list("starts").alias("_starts"))  # one array per term of the phrase
        .filter(F.size("_starts") == F.col("n"))
    )
    common = F.aggregate("_starts", F.get("_starts", F.lit(0)), lambda kept, starts: F.array_intersect(kept, starts))
    found = met.withColumn("n_found", F.size(common)).filter(F.col("n_found") > 0)
    scored = found.select("query_id", "limit", *KEYS, "n_found", F.round(1.0 + F.ln("n_found"), 6).alias("score"))
    return _top_hits(scored).select("query_id", "rank", *KEYS, "n_found", "score")
