import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.analysis import ENGLISH, PLAIN
from quire.functions.stem import stem
from quire.operators import fusion, keyword, semantic
from quire.plans.search import Corpus, search
from quire.schemas import CARD_COLUMNS, HIT_COLUMNS, SOURCE_TYPES
from quire.session import materialise

CORPUS = (
    "source_type string, source_id bigint, title string, reference string, content string, file_path string, "
    "speaker string, year int, month string, aid_type string, slug string"
)
QUERIES = "query_id bigint, query string"


def doc(kind, number, content, title=None, path=None):
    return (kind, number, title, None, content, path, None, None, None, None, None)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        doc("scriptures", 1, "faith hope charity faith", "unseen title"),
        doc("talks", 1, "hope and faith", "Charity"),
        doc("talks", 2, "faith faith faith hope charity"),
        doc("manuals", 3, "hope only"),
        doc("books", 4, "Café FAITH-hope, charity!"),
        doc("study_aids", 5, "faith hope charity faith"),
        doc("study_aids", 6, None, None),
    ]
    return spark.createDataFrame(rows, CORPUS)


@pytest.fixture(scope="module")
def index(corpus):
    return materialise(keyword.build_term_index(corpus), "index")


def found(hits):
    return [(r.query_id, r.rank, r.source_type, r.source_id) for r in hits.orderBy("query_id", "rank").collect()]


def test_postings_count_terms_per_row(corpus):
    rows = keyword.build_postings(corpus).collect()
    got = {(r.source_type, r.source_id, r.term): (r.tf, r.doc_len) for r in rows}
    assert got["scriptures", 1, "faith"] == (2, 4)
    assert ("scriptures", 1, "unseen") not in got
    assert got["talks", 1, "charity"] == (1, 3)  # title counts, the stop word does not
    assert got["books", 4, "café"] == (1, 4)


def test_keyword_needs_all_terms_and_ranks(frame, index):
    queries = frame([(1, "Faith, hope & charity charity"), (2, "the of"), (3, "  "), (4, "absent faith")], QUERIES)
    hits = keyword.keyword_search(queries, index)
    assert found(hits) == [
        (1, 1, "talks", 2), (1, 2, "scriptures", 1), (1, 3, "study_aids", 5), (1, 4, "talks", 1), (1, 5, "books", 4),
    ]
    best = hits.filter("rank = 1").first()
    assert best.score == round(3 + math.log(3), 6)
    # verse hits show the whole text
    assert hits.filter("source_type = 'scriptures'").first().snippet == "faith hope charity faith"


@pytest.mark.parametrize("ranker", keyword.RANKERS)
def test_shuffled_form_equals_in_row_form(frame, index, ranker):
    queries = frame([(1, "faith hope"), (2, "hope"), (3, "charity faith hope"), (4, "nothing here")], QUERIES)
    a = keyword.keyword_search(queries, index, ranker=ranker)
    b = keyword.keyword_search(queries, index, ranker=ranker, in_row_terms=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_long_documents_can_be_searched_before_the_index_is_stored(frame):
    words = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = frame([doc("talks", 1, words), doc("books", 2, words + " rare")], CORPUS)
    start = time.time()
    hits = keyword.keyword_search(frame([(1, "w17 rare w4999")], QUERIES), keyword.build_term_index(rows))
    assert found(hits) == [(1, 1, "books", 2)]
    assert time.time() - start < 60


def test_postings_form_equals_index_form(spark, frame, corpus, index, tmp_path):
    queries = frame([(1, "faith hope"), (2, "hope"), (3, "charity faith hope"), (4, "nothing here")], QUERIES)
    stored = keyword.write_postings(keyword.build_postings(corpus), str(tmp_path / "postings"), parts=8)
    a = keyword.search_postings(queries, stored, parts=8)
    b = keyword.keyword_search(queries, index).select(*a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    joined = keyword.search_postings(queries, stored, parts=8, max_terms=2)  # terms beyond the bound are joined
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.collect()))


def test_limits_and_sources_per_query(frame, index):
    schema = "query_id bigint, query string, sources array<string>, limit int"
    queries = frame(
        [(1, "hope", ["talks", "manuals"], 2), (2, "hope", None, 0), (3, "hope", [], 101), (4, "hope", ["books"], 1)],
        schema,
    )
    hits = keyword.keyword_search(queries, index)
    counts = {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()}
    assert counts == {1: 2, 2: 6, 3: 6, 4: 1}
    assert {r.source_type for r in hits.filter("query_id = 1").collect()} <= {"talks", "manuals"}
    with pytest.raises(ValueError):
        keyword.keyword_search(queries, index, sources=["talk"])
    with pytest.raises(ValueError):
        keyword.keyword_search(queries, index, ranker="other")


def test_top_k_is_a_prefix(frame, index):
    queries = frame([(1, "hope")], QUERIES)
    three = found(keyword.keyword_search(queries.withColumn("limit", F.lit(3)), index))
    four = found(keyword.keyword_search(queries.withColumn("limit", F.lit(4)), index))
    assert four[:3] == three


def test_stemming_matches_word_forms(frame, corpus):
    index = materialise(keyword.build_term_index(corpus, ENGLISH), "stemmed")
    hits = keyword.keyword_search(frame([(1, "hoping charities")], QUERIES), index, analyzer=ENGLISH)
    assert len(found(hits)) == 5
    # samples published with the algorithm
    samples = {
        "consigned": "consign", "consistency": "consist", "generously": "generous", "kneeling": "kneel",
        "knives": "knive", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "hopping": "hop",
        "hoping": "hope", "luxuriated": "luxuri", "relational": "relat", "say": "say", "cry": "cri", "by": "by",
        "skies": "sky", "succeeding": "succeed", "youth": "youth", "enjoyed": "enjoy", "controlling": "control",
    }
    assert {w: stem(w) for w in samples} == samples


def vectors(spark, n, dim=8, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype("float32")
    data[: copies] = data[0]
    rows = [
        (SOURCE_TYPES[i % 5], i, "paragraph", f"text {i}", [float(x) for x in data[i]], "m") for i in range(n)
    ]
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    return spark.createDataFrame(rows, schema), data


def brute(data, query, k, allowed=SOURCE_TYPES):
    unit = data.astype("float64")
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    q = query.astype("float64") / np.linalg.norm(query.astype("float64"))
    scores = np.round(unit @ q, 6)
    order = sorted(
        (i for i in range(len(data)) if SOURCE_TYPES[i % 5] in allowed), key=lambda i: (-scores[i], i % 5, i)
    )
    return order[:k]


@pytest.mark.parametrize("shared", [True, False])
def test_nearest_equals_brute_force_with_a_third_copies(spark, shared):
    rows, data = vectors(spark, 300, copies=100)
    asked = [(i, [float(x) for x in data[i * 7]], None if i % 2 else ["talks", "books"], 5) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<float>, sources array<string>, limit int")
    hits = semantic.nearest(queries.repartition(3), rows.repartition(5), shared=shared, block_floats=100)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.source_id)
    for i, _, sources, k in asked:
        assert got[i] == brute(data, data[i * 7], k, sources or SOURCE_TYPES)


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(semantic, "CELL_ROWS", 10)
    monkeypatch.setattr(semantic, "CELL_QUERIES", 4)
    rows, data = vectors(spark, 120, copies=60)
    queries = spark.createDataFrame(
        [(i, [float(x) for x in data[i]]) for i in range(30)], "query_id bigint, vector array<float>"
    )
    wanted = semantic._asked(queries, list(SOURCE_TYPES))
    found = semantic._rank(semantic._nearest_by_cell(semantic._vector_rows(rows, list(SOURCE_TYPES)), wanted, 16, 16))
    one = semantic.nearest(queries, rows, shared=True).select(found.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, found.collect()))


def test_bounds_keep_task_output_near_the_limit(spark):
    rows, data = vectors(spark, 2000)
    asked = semantic._asked(
        spark.createDataFrame([(i, [float(x) for x in data[i]], 5) for i in range(8)], "query_id bigint, vector array<float>, limit int"),
        list(SOURCE_TYPES),
    ).collect()
    stored = semantic._vector_rows(rows, list(SOURCE_TYPES)).repartition(16)
    free = semantic._nearest_shared(stored, asked)
    true = semantic._rank(free)
    bounds = {r.query_id: r.score for r in true.filter("rank = 5").collect()}
    bound = semantic._nearest_shared(stored, asked, bounds)
    assert sorted(map(tuple, semantic._rank(bound).collect())) == sorted(map(tuple, true.collect()))
    assert free.count() == 8 * 5 * 16 and bound.count() == 8 * 5
    assert "snippet" not in free.columns


def test_zero_and_missing_vectors_never_match(spark):
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    rows = spark.createDataFrame(
        [("talks", 1, "paragraph", "a", [0.0, 0.0], "m"), ("talks", 2, "paragraph", "b", [1.0, 0.0], "m"),
         ("talks", 3, "paragraph", "c", None, "m")], schema)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, vector array<float>")
    for shared in (True, False):
        assert [(r.query_id, r.source_id) for r in semantic.nearest(queries, rows, shared=shared).collect()] == [(1, 2)]


def test_vectors_of_another_dimension_match_nothing_and_are_counted(spark):
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    rows = spark.createDataFrame([("talks", 1, "p", "a", [1.0, 0.0, 0.0], "other")], schema)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    assert semantic.nearest(queries, rows).count() == 0
    assert semantic.nearest(queries, rows, model="m").count() == 0
    assert [tuple(r) for r in semantic.model_census(rows).collect()] == [("other", 3, 1)]
    mixed = queries.union(spark.createDataFrame([(2, [1.0, 0.0, 0.0])], queries.schema))
    with pytest.raises(ValueError, match="dimension"):
        semantic.nearest(mixed, rows)


def test_approximate_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    data = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))).astype("float32")
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    rows = spark.createDataFrame(
        [(SOURCE_TYPES[i % 5], i, "paragraph", "", [float(x) for x in data[i]], "m") for i in range(600)], schema)
    queries = spark.createDataFrame(
        [(i, [float(x) for x in data[i * 9]], 10) for i in range(60)], "query_id bigint, vector array<float>, limit int")
    cards = spark.createDataFrame([], CORPUS)
    exact = semantic.nearest(queries, rows).select("query_id", "source_id")
    close = semantic.semantic_search_approx(queries, rows, cards, probes=4).select("query_id", "source_id")
    assert exact.join(close, ["query_id", "source_id"]).count() / exact.count() > 0.8


HITS = "query_id bigint, rank int, source_type string, source_id bigint, score double, " + ", ".join(
    f"{c} {'int' if c == 'year' else 'string'}" for c in CARD_COLUMNS
)


def hit(query, rank, kind, number, score, title):
    return (query, rank, kind, number, score, title, *[None] * (len(CARD_COLUMNS) - 1))


def test_rrf_sums_duplicates_and_shows_the_first_row(frame):
    a = frame([hit(1, 1, "talks", 1, 9.0, "kw1"), hit(1, 2, "books", 2, 8.0, "kw2")], HITS)
    b = frame([hit(1, 1, "books", 2, 0.9, "sem"), hit(1, 2, "talks", 3, 0.8, "x"), hit(1, 3, "talks", 3, 0.7, "y")], HITS)
    got = fusion.rrf_merge(a, b).orderBy("rank").collect()
    assert [(r.source_type, r.source_id, r.title) for r in got] == [
        ("books", 2, "kw2"), ("talks", 3, "x"), ("talks", 1, "kw1")]
    assert got[0].score == round(1 / 62 + 1 / 61, 12)
    assert got[1].score == round(1 / 62 + 1 / 63, 12)
    swapped = fusion.rrf_merge(b, a).orderBy("rank").collect()
    assert [(r.source_type, r.source_id, r.score) for r in swapped] == [(r.source_type, r.source_id, r.score) for r in got]
    assert fusion.rrf_merge(a, b, limit=1).count() == 1
    assert fusion.rrf_merge(a, b.limit(0)).count() == 2


def test_hybrid_falls_back_per_query(frame):
    queries = frame([(1, [1.0]), (2, None)], "query_id bigint, vector array<float>")
    kw = frame([hit(1, 1, "talks", 1, 9.0, "a"), hit(2, 1, "talks", 1, 9.0, "a"), hit(2, 2, "talks", 2, 8.5, "b")], HITS)
    sem = frame([], HITS)
    got = {(r.query_id, r.source_id): r.score for r in fusion.hybrid_merge(queries, kw, sem).collect()}
    assert got == {(1, 1): round(1 / 61, 12), (2, 1): 9.0, (2, 2): 8.5}
    assert fusion.hybrid_merge(queries, kw, None) is kw


def test_search_modes_and_links(spark, frame):
    rows = frame(
        [doc("scriptures", 1, "faith", path="eng/scriptures/ot/gen/1.md"), doc("books", 4, "faith", path="books/x.md")],
        CORPUS,
    )
    index = materialise(keyword.build_term_index(rows), "i")
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    vecs = frame([("scriptures", 1, "verse", "faith", [1.0, 0.0], "m"), ("talks", 9, "paragraph", "gone", [0.5, 1.0], "m")], schema)
    corpus = Corpus(rows, index, vecs, PLAIN, "m")
    queries = frame([(1, "faith", [1.0, 0.0]), (2, " ", [1.0, 0.0])], "query_id bigint, query string, vector array<float>")
    hits = search(queries, corpus)
    assert tuple(hits.columns) == HIT_COLUMNS
    assert found(hits) == [(1, 1, "scriptures", 1), (1, 2, "talks", 9), (1, 3, "books", 4)]  # equal scores: source order
    by_id = {r.source_id: r for r in hits.collect()}
    assert by_id[1].web_url.endswith("/study/scriptures/ot/gen/1?lang=eng")
    assert (by_id[4].web_url, by_id[4].file_path) == ("", "books/x.md")
    assert by_id[9].file_path is None  # a hit whose source row is gone stays
    web = search(queries, corpus, "keyword", link_mode="web")
    assert {r.file_path for r in web.collect()} == {""}
    assert {r.web_url for r in search(queries, corpus, "semantic", link_mode="fs").collect()} == {""}
    assert found(search(queries, corpus, limit=1)) == [(1, 1, "scriptures", 1)]
    own = queries.withColumn("limit", F.lit(2))
    assert len(found(search(own, corpus, limit=1))) == 2
    with pytest.raises(ValueError):
        search(queries, corpus, "fuzzy")
    with pytest.raises(ValueError):
        search(queries.drop("vector"), corpus, "semantic")


def test_vectors_that_cannot_be_compared(frame):
    rows = frame([doc("books", 1, "faith"), doc("books", 2, "faith")], CORPUS)
    schema = "source_type string, source_id bigint, layer string, content string, embedding array<float>, model string"
    vecs = frame([("books", 1, "paragraph", "faith", [1.0, 0.0], "m"), ("books", 2, "paragraph", "faith", [1.0], "m")], schema)
    asked = "query_id bigint, query string, vector array<float>"
    one = frame([(1, "faith", [1.0, 0.0])], asked)
    assert found(semantic.semantic_search(one, vecs, rows)) == [(1, 1, "books", 1)]  # the other has one dimension
    mixed = frame([(1, "faith", [1.0, 0.0]), (2, "faith", [1.0])], asked)
    with pytest.raises(ValueError):
        semantic.semantic_search(mixed, vecs, rows)
    corpus = Corpus(rows, materialise(keyword.build_term_index(rows), "i"), vecs, PLAIN, "m")
    with pytest.warns(UserWarning):
        hits = search(mixed, corpus)
    assert len(found(hits)) == 4
    two = vecs.withColumn("model", F.concat("model", "source_id"))
    with pytest.raises(ValueError):
        semantic.semantic_search(one, two, rows)
    assert found(semantic.semantic_search(one, two, rows, model="m1")) == [(1, 1, "books", 1)]
