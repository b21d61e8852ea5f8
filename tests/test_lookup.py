import pytest
from pyspark.sql import functions as F

from quire import session
from quire.operators import catalog, lookup
from quire.plans.search import resolve
from quire.schemas import BOOK_NAMES, CHAPTERS, CROSS_REFERENCES, SCRIPTURES
from quire.sources.corpus import load_cross_references

VERSES = "id bigint, volume string, book string, chapter int, verse int, reference string, text string, file_path string"


def parsed(frame, *texts):
    rows = lookup.resolve_citations(frame(list(enumerate(texts)), "request_id bigint, citation string"))
    return [(r.book, r.chapter, r.verse, r.end_verse) if r.ok else None for r in rows.orderBy("request_id").collect()]


def test_citations(frame):
    assert parsed(frame, "1 Nephi 3:7", " D&C  93:24-30 ", "Mosiah 4", "Doctrine and Covenants 4:2", "1-ne 3:7") == [
        ("1-ne", 3, 7, None), ("dc", 93, 24, 30), ("mosiah", 4, None, None), ("dc", 4, 2, None), ("1-ne", 3, 7, None)]


def test_citation_edges(frame):
    assert parsed(
        frame, "Alma 5:7–9", "Alma 5:7-", "Alma 5:3--2", "Alma 5:7a", "Alma 5:-7", "Alma 5:0", "Alma 0:1", "Alma",
        "", "Alma :5", "Alma x:5", "Nowhere 1:1", "Alma +5:+7", "psalm 2", "Alma 5:9-3", "a b", "Alma 99999999999:1",
        "Alma 5:7-x9", "song of solomon 1:2",
    ) == [
        ("alma", 5, 7, None), ("alma", 5, 7, None), ("alma", 5, 3, None), ("alma", 5, 7, None), None, None, None, None,
        None, None, None, None, ("alma", 5, 7, None), ("ps", 2, None, None), ("alma", 5, 9, 3), None, None,
        ("alma", 5, 7, None), ("song", 1, 2, None)]


def test_display_names_that_do_not_resolve_back(frame):
    names = list(BOOK_NAMES.items())
    back = parsed(frame, *[f"{name} 1:1" for _, name in names])
    lost = [slug for (slug, _), got in zip(names, back, strict=True) if got is None]
    assert lost == ["od", "js-m", "js-h"]


def scriptures(frame):
    rows = [(i, "bofm", "alma", 5, i, f"Alma 5:{i}", f"v{i}", "f") for i in range(1, 61)]
    rows += [(100, "xx", "alma", 5, 1, "other 5:1", "w", "g")]
    return frame(rows, VERSES)


def test_passages_and_statuses(spark, frame):
    chapters = frame([(1, "bofm", "alma", 5, "T", "full", "f")],
                     "id bigint, volume string, book string, chapter int, title string, full_content string, file_path string")
    cited = frame(list(enumerate(["Alma 5:1", "Alma 5:1-50", "Alma 5:1-51", "Alma 5:9-3", "Alma 9:1", "Alma 5", "?", "Alma 5:60-70"])),
                  "request_id bigint, citation string")
    rows = lookup.get_passages(lookup.resolve_citations(cited), scriptures(frame), chapters).collect()
    status = {r.request_id: r.status for r in rows}
    assert status == {0: "ok", 1: "ok", 2: "too_long", 3: "bad_order", 4: "not_found", 5: "ok", 6: "unparseable", 7: "ok"}
    count = {k: sum(r.request_id == k for r in rows) for k in status}
    assert count == {0: 1, 1: 51, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    by_request = {r.request_id: r for r in rows}
    assert by_request[0].volume == "bofm" and by_request[5].full_content == "full"


def test_cross_references(spark, frame):
    edges = spark.createDataFrame(
        [
            ("bofm", "alma", 5, 1, "nt", "heb", 7, 11, None), ("bofm", "alma", 5, 2, "nt", "heb", 7, 11, None),
            ("bofm", "alma", 5, 2, "nt", "heb", 7, None, "tg"), ("bofm", "alma", 5, 2, "bofm", "alma", 5, 3, "a"),
            ("bofm", "alma", 5, 2, "nt", "heb", 7, None, None), ("bofm", "alma", 9, 9, "nt", "heb", 1, 1, None),
        ], CROSS_REFERENCES)
    cited = frame([(1, "Alma 5:1-2"), (2, "Alma 5:1"), (3, "Alma 5")], "request_id bigint, citation string")
    tables = {"scriptures": scriptures(frame).filter("volume = 'bofm'"), "chapters": spark.createDataFrame([], CHAPTERS),
              "cross_references": edges}
    passages, refs = resolve(cited, tables, cross_refs=True, ordered=True)
    got = [(r.request_id, r.reference, r.target_verse, r.reference_type) for r in refs.collect()]
    assert got == [
        (1, "Alma 5:3", 3, "a"), (1, "heb 7", None, "tg"), (1, "heb 7", None, None), (1, "heb 7:11", 11, None),
        (2, "heb 7:11", 11, None)]
    assert resolve(cited, tables)[1] is None
    assert passages.count() == 4


def test_edges_are_read_with_their_schema(spark, frame, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1, 2, "c", "d", 3, None, None)], CROSS_REFERENCES)
    edges.write.parquet(str(tmp_path / "p"))
    edges.write.json(str(tmp_path / "j"))
    for path, fmt in (("p", "parquet"), ("j", "json")):
        got = load_cross_references(spark, str(tmp_path / path), fmt)
        assert got.schema == CROSS_REFERENCES and got.collect() == edges.collect()


def test_get_by_id(spark, frame):
    talks = frame([(7, 2020, "04", "s", "t", "c", "f")],
                  "id bigint, year int, month string, speaker string, title string, content string, file_path string")
    manuals = frame([(7, "col", "t", "c", "f")], "id bigint, collection_id string, title string, content string, file_path string")
    asked = frame([(1, "talks", 7), (2, "manuals", 7), (3, "talks", 8), (4, "songs", 7)],
                  "request_id bigint, source_type string, source_id bigint")
    rows = {r.request_id: r for r in lookup.get_by_id(asked, {"talks": talks, "manuals": manuals}).collect()}
    assert {k: r.status for k, r in rows.items()} == {1: "ok", 2: "ok", 3: "not_found", 4: "unknown_type"}
    assert rows[2].collection == "col" and rows[1].year == 2020


def test_listings(spark, frame):
    tables = {"scriptures": scriptures(frame), "talks": frame([(y, m) for y in range(1960, 2020) for m in ("04", "10")],
                                                              "year int, month string")}
    assert [tuple(r) for r in catalog.listing(tables, "scriptures").collect()] == [("bofm", 1, 60), ("xx", 1, 1)]
    sessions = catalog.listing(tables, "talks").collect()
    assert len(sessions) == 50 and tuple(sessions[0]) == (2019, "10", 1)
    assert {r.table: r.n for r in catalog.listing(tables).collect()} == {
        "scriptures": 61, "chapters": 0, "talks": 120, "manuals": 0, "books": 0, "study_aids": 0, "embeddings": 0}
    with pytest.raises(ValueError):
        catalog.listing(tables, "songs")
    assert spark.createDataFrame([], SCRIPTURES).agg(F.count("*")).first()[0] == 0


def test_cut_points_and_spreading(spark, monkeypatch):
    rows = session.materialise(spark.range(10), "ten")
    assert rows.count() == 10 and rows.columns == ["id"]
    assert session.spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    assert session.spread(rows, "id") is rows


def test_heavy_verses_are_not_compared_pair_by_pair(spark, frame, monkeypatch):
    """Requests with one, two and no heavy verses: exact pairs, and those of a main verse are never shuffled."""
    from quire.operators import lookup

    monkeypatch.setattr(lookup, "HEAVY_PAIRS", 10_000, raising=False)
    place = lambda i: ("v", "b", 1, i)
    passages = [(r, *place(v)) for r in range(400) for v in {1, r % 5, 50 + r}] + [(1000, *place(70)), (1001, "v", "b", 1, None)]
    edges = [(*place(v), "t", "t", i, None if i % 2 else 3, "x" if i % 3 else None) for v, some in ((1, range(2000)), (2, range(1500, 2500)), (3, range(7))) for i in some]
    edges += [(*place(50 + r), "t", "t", r, None if r % 2 else 3, "x" if r % 3 else None) for r in range(1990, 2100)] + [(*place(60), "t", "t", 1999, None, "x")] * 2
    verses = frame([("t", i, 3, f"T {i}") for i in range(0, 3000, 4)], "book string, chapter int, verse int, reference string")
    reached = {}
    for e in edges:
        reached.setdefault(e[:4], set()).add(e[4:])
    show = lambda t: f"T {t[2]}" if t[3] and t[2] % 4 == 0 else f"{t[1]} {t[2]}" + (f":{t[3]}" if t[3] else "")
    want = {(r, show(t), *t) for r, *p in passages for t in reached.get(tuple(p), ())}
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = shuffled()
    got = lookup.cross_references(
        frame(passages, "request_id bigint, volume string, book string, chapter int, verse int"),
        frame(edges, "source_volume string, source_book string, source_chapter int, source_verse int, target_volume string, target_book string, target_chapter int, target_verse int, reference_type string"),
        verses,
    ).select("request_id", "reference", "target_volume", "target_book", "target_chapter", "target_verse", "reference_type").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert shuffled() - before < 3_000_000


def test_texts_of_passages_move_once(spark, frame, request):
    import random

    from quire.operators import lookup

    r = random.Random(1)
    text = lambda: "".join(chr(r.randrange(33, 127)) for _ in range(1000))
    verses = frame([(i, "v", "b", i // 50, i % 50 + 1, f"B {i}", text(), "f") for i in range(3000)],
                   "id bigint, volume string, book string, chapter int, verse int, reference string, text string, file_path string")
    chapters = frame([(i, "v", "b", i, f"C {i}", "whole", "f") for i in range(60)],
                     "id bigint, volume string, book string, chapter int, title string, full_content string, file_path string")
    asked = frame([(i, "b", i, 1, 50, True) for i in range(1, 60)] + [(99, "b", 2, None, None, True), (100, "b", 99, 1, None, True), (101, None, None, None, None, False)],
                  "request_id bigint, book string, chapter int, verse int, end_verse int, ok boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with larger tables
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = shuffled()
    got = lookup.get_passages(asked, verses, chapters).select("request_id", "status", "shape", "id", "text").collect()
    assert len(got) == 59 * 50 + 3
    assert {(x.request_id, x.status, x.shape) for x in got if x.text is None} == {(99, "ok", "chapter"), (100, "not_found", "verse"), (101, "unparseable", None)}
    assert shuffled() - before < 5_000_000
