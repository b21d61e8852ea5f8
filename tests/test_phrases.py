"""Phrases: places of terms, repeats, overlaps, stop words, limits and odd rows."""

from quire.operators import phrases
from quire.session import materialise
from tests.test_search import CORPUS, doc


def test_phrases(spark):
    docs = [
        doc("scriptures", 1, "faith hope charity faith hope", "faith hope"),
        doc("talks", 2, "hope faith charity hope", "T"),
        doc("talks", 3, "Faith, and HOPE!", "T"),
        doc("books", 4, "ha ha ha ha", None),
        doc("manuals", 5, None, None),
        doc("books", 6, "", ""),
        doc("books", 7, "x " * 20000 + "faith hope", None),
    ]
    positions = materialise(phrases.build_positions(spark.createDataFrame(docs, CORPUS)), "positions")
    places = {(r.source_id, r.term): list(r.positions) for r in positions.filter("source_id < 7").collect()}
    assert places[1, "faith"] == [0, 3] and places[1, "hope"] == [1, 4] and places[4, "ha"] == [0, 1, 2, 3] and places[3, "hope"] == [1]  # a title of one stop word takes no place
    assert positions.filter("source_id in (5, 6)").isEmpty()
    asked = [
        (1, "faith hope", None, None), (2, "ha ha", None, 5), (3, "hope hope", None, 5), (4, "charity faith hope", None, 5),
        (5, "the", None, 5), (6, None, None, 5), (7, "faith hope", ["books"], 5), (8, "faith absent", None, 5), (9, "hope", None, 2),
    ]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, sources array<string>, `limit` int")
    got = [tuple(r)[:5] for r in phrases.search_phrases(queries, positions).orderBy("query_id", "rank").collect()]
    assert got == [
        (1, 1, "scriptures", 1, 2), (1, 2, "talks", 3, 1), (1, 3, "books", 7, 1), (2, 1, "books", 4, 3), (4, 1, "scriptures", 1, 1),
        (7, 1, "books", 7, 1), (9, 1, "scriptures", 1, 2), (9, 2, "talks", 2, 2),
    ]
    talks = phrases.search_phrases(queries, positions, sources=["talks"]).filter("query_id = 1").collect()
    assert [r.source_id for r in talks] == [3]
    assert phrases.search_phrases(queries, positions.limit(0)).count() == 0 == phrases.search_phrases(queries.limit(0), positions).count()
