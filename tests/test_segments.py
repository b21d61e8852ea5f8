"""Postings in segments: equal to a full rebuild whatever was replaced, deleted, merged or left unfinished."""

import pytest

from quire.operators import keyword
from quire.operators.segments import SegmentedPostings
from tests.test_search import CORPUS, doc


def rows(df):
    return sorted((r.source_type, r.source_id, r.term, r.tf, r.doc_len) for r in df.collect())


def test_equal_to_a_rebuild(spark, tmp_path):
    make = lambda *docs: spark.createDataFrame(list(docs), CORPUS)
    kept = SegmentedPostings(spark, str(tmp_path / "p"), parts=2)
    assert kept.live().count() == 0 and kept.segments() == []
    kept.apply(make(doc("talks", 1, "faith hope faith"), doc("talks", 2, "charity"), doc("books", 1, "faith"), doc("books", 2, None)))
    # replaced, replaced by nothing, deleted, absent before, deleted without ever being there
    kept.apply(make(doc("talks", 1, "hope"), doc("books", 2, "late"), doc("manuals", 5, "new")), make(doc("talks", 2, ""), doc("talks", 9, "")))
    want = [("books", 1, "faith", 1, 1), ("books", 2, "late", 1, 1), ("manuals", 5, "new", 1, 1), ("talks", 1, "hope", 1, 1)]
    assert rows(kept.live()) == want
    old = kept.live()
    kept.compact()
    assert rows(kept.live()) == want == rows(old) and len(kept.segments()) == 1
    # a deleted document comes back, one with new text is in both tables, one loses its text
    kept.apply(make(doc("talks", 2, "charity again"), doc("books", 1, "hope"), doc("books", 2, "")), make(doc("books", 1, "")))
    want = [("books", 1, "hope", 1, 1), ("manuals", 5, "new", 1, 1), ("talks", 1, "hope", 1, 1), ("talks", 2, "charity", 1, 1)]
    assert rows(kept.live()) == want
    # a batch that died before its log entry changes nothing
    (tmp_path / "p" / "log" / "00000009").mkdir()
    (tmp_path / "p" / "segments" / "dead").mkdir()
    assert rows(kept.live()) == want
    assert "dead" in kept.drop_unused() and rows(kept.live()) == want
    hits = keyword.search_postings(spark.createDataFrame([(1, "hope")], "query_id bigint, query string"), kept.live(), parts=2)
    assert [(r.rank, r.source_type, r.source_id) for r in hits.orderBy("rank").collect()] == [(1, "talks", 1), (2, "books", 1)]
    with pytest.raises(ValueError, match="2 parts"):
        SegmentedPostings(spark, kept.root, parts=3).segments()
