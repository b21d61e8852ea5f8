"""Top-k from blocks: the same rows as a full search, from fewer blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, keyword
from quire.schemas import SOURCE_TYPES
from quire.session import materialise
from tests.test_search import CORPUS, doc

QUERIES = "query_id bigint, query string, sources array<string>, `limit` int"


@pytest.fixture(scope="module")
def library(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(3000):
        size = 400 if i % 100 == 0 else draw.randint(1, 60)
        text = " ".join(draw.choices(words, [1 / (j + 1) for j in range(40)], k=size))
        rows.append(doc(SOURCE_TYPES[i % 5], i // 3 * 3 if i % 7 else i, text, "title"))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [doc("talks", 9001, None, None), doc("talks", 9002, "", ""), doc("books", 9003, "solitary", None)]
    return materialise(spark.createDataFrame(rows, CORPUS), "library")


@pytest.fixture(scope="module")
def index(spark, library, tmp_path_factory):
    postings = materialise(keyword.build_postings(library), "postings")
    return blocks.write_block_index(postings, str(tmp_path_factory.mktemp("blocks")), block_docs=16, parts=8)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [
        (1, "w0", None, 3), (2, "w0 w1", None, 20), (3, "w0 w1 w2", None, 100), (4, "w39 w38 w37 w36", None, 0),
        (5, "w0", ["talks", "books"], 101), (6, "w3 w3 w5", [], None), (7, "absent", None, 5), (8, "w0 absent", None, 5),
        (9, "", None, 5), (10, None, None, 5), (11, "title", None, 7), (12, "solitary", None, 7), (13, "w30 w31", ["manuals"], 50),
        (14, "W0, the w1!", None, 1),
    ]
    return materialise(spark.createDataFrame(rows, QUERIES), "queries")


def rows(df):
    return sorted((r.query_id, r.rank, r.source_type, r.source_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"max_terms": 0}, {"rounds": ()}, {"rounds": (1, 2, 4)}, {"sources": ["talks", "manuals"]}])
def test_equal_to_the_full_search(library, index, queries, options):
    full = keyword.keyword_search(queries, keyword.build_term_index(library), sources=options.get("sources"))
    got = rows(blocks.search_blocks(queries, index, **options))
    assert got == rows(full) and len(got) > 100


def test_blocks_below_the_last_score_are_skipped(index, queries):
    read = {r.query_id: (r.n_scored, r.n_blocks) for r in blocks.blocks_scored(queries.filter("query_id in (1, 11, 14)"), index).collect()}
    assert read[1][0] < read[1][1] / 4 and read[14][0] < read[14][1] / 2
    # every document has the same score here, so no block can be left out by its bound
    assert read[11][0] == read[11][1]


def test_blocks_hold_one_source_and_bound_their_documents(index):
    bad = index.postings.join(index.blocks.drop("term_part"), ["term", "source_type", "block"], "left").filter("max_tf is null or tf > max_tf")
    assert bad.isEmpty()
    sizes = index.postings.groupBy("block").agg(F.countDistinct("source_type").alias("s"), F.countDistinct("source_type", "source_id").alias("n"))
    assert sizes.filter("s > 1 or n > 64").isEmpty()
    assert index.terms.filter("term = 'solitary'").select("df", "n_blocks").first() == (1, 1)


def test_empty_tables(spark, index, queries, tmp_path):
    assert blocks.search_blocks(queries.limit(0), index).count() == 0
    nothing = blocks.write_block_index(index.postings.drop("block", "term_part").limit(0), str(tmp_path / "i"))
    hits = blocks.search_blocks(queries, nothing)
    assert hits.count() == 0 and hits.columns == ["query_id", "rank", "source_type", "source_id", "score"]


def test_a_stored_index_is_found_again(spark, library, queries, tmp_path):
    postings = materialise(keyword.build_postings(library), "postings")
    first = blocks.write_block_index(postings, str(tmp_path / "i"), parts=4)
    again = blocks.read_block_index(spark, str(tmp_path / "i"), parts=4)
    some = queries.filter("query_id < 3")
    assert rows(blocks.search_blocks(some, again)) == rows(blocks.search_blocks(some, first))
