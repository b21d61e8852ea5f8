import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import backfill_stored_speakers, embed_pending, ingest, ingest_stream
from quire.operators import embed
from quire.operators.upsert import insert_if_absent, upsert
from quire.plans import ingest as plan
from quire.sources import corpus
from quire.sources.tables import StateTables

LIBRARY = {
    "eng/scriptures/bofm/1-ne/3.md": "# Chapter 3\n**1.** One<sup>[a](#fn-1)</sup>\n**7.** I will go\n**7.** later line\n",
    "eng/scriptures/bofm/1-ne/03.md": "# Older\n**1.** Eins\n**2.** Zwei\n",
    "eng/scriptures/tg/faith.md": "No heading",
    "eng/general-conference/2020/04/a.md": "# A\n\nBy Elder A\n\nFirst.\n\nSecond.",
    "eng/general-conference/2020/10/b.md": "no title",
    "eng/manual/cfm/x/1.md": "# Lesson\n\nText",
    "eng/liahona/2020/x.md": "skipped",
    "eng/scriptures/bofm/1-ne/intro.md": "ignored",
}
BOOKS = {"lectures/1.md": "# Lecture\n\nBody", "solo.md": "alone"}


def write_tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "notes.txt").write_text("not markdown")


@pytest.fixture
def trees(tmp_path):
    write_tree(tmp_path / "library", LIBRARY)
    write_tree(tmp_path / "books", BOOKS)
    return str(tmp_path / "library"), str(tmp_path / "books"), str(tmp_path / "state")


def outcome(summary):
    return {(r.content_type, r.outcome): r.n for r in summary.collect()}


def content(state, name, *columns):
    return sorted(tuple(r) for r in state.read(name).select(*columns).collect())


def test_scan_lists_relative_paths(spark, trees):
    rows = corpus.scan_corpus(spark, trees[0]).collect()
    assert {r.rel_path: r.content for r in rows} == LIBRARY
    assert all(r.size == len(LIBRARY[r.rel_path].encode()) for r in rows)
    listed = corpus.scan_corpus(spark, trees[0], with_content=False)
    assert listed.columns == ["path", "rel_path", "mtime", "size"]


def test_ingest_then_nothing_then_changes(spark, trees):
    library, books, root = trees
    got = outcome(ingest(spark, root, library, books))
    assert got["scriptures", "indexed"] == 2 and got["none", "skipped"] == 1 and got["none", "ignored"] == 1
    assert got["scriptures", "rows"] == 5 and got["books", "rows"] == 2
    state = StateTables(spark, root)
    # both chapter files have the same key: the later path wins, and the later line inside it
    assert content(state, "scriptures", "verse", "text", "reference") == [
        (1, "One", "1 Nephi 3:1"), (2, "Zwei", "1 Nephi 3:2"), (7, "later line", "1 Nephi 3:7")]
    assert content(state, "chapters", "chapter", "title") == [(3, "Chapter 3")]
    assert content(state, "study_aids", "slug", "title") == [("faith", "faith")]
    assert content(state, "talks", "speaker", "title") == [("", ""), ("Elder A", "A")]
    assert content(state, "books", "collection", "section", "title") == [("lectures", "1", "Lecture"), ("solo.md", "solo", "solo")]
    assert state.read("speaker_quarantine").count() == 1
    manifest = {r.file_path.split("/")[-1]: r.record_count for r in state.read("index_metadata").collect()}
    assert manifest == {"3.md": 3, "03.md": 2, "faith.md": 1, "a.md": 1, "b.md": 1, "1.md": 1, "solo.md": 1}
    assert state.read("index_metadata").count() == 8

    # nothing changed: nothing is indexed
    again = outcome(ingest(spark, root, library, books))
    assert not any(kind in ("indexed", "rows") for _, kind in again)
    ids = content(state, "talks", "id", "file_path")

    # a new size, and a time moved backwards
    talk = os.path.join(library, "eng/general-conference/2020/04/a.md")
    with open(talk, "a") as f:
        f.write(" More.")
    old = time.time() - 10_000
    os.utime(os.path.join(library, "eng/manual/cfm/x/1.md"), (old, old))
    changed = outcome(ingest(spark, root, library, books))
    assert changed["talks", "indexed"] == 1 and changed["manuals", "indexed"] == 1
    assert changed["talks", "unchanged"] == 1
    assert content(state, "talks", "id", "file_path") == ids
    assert any("More." in c for (c,) in content(state, "talks", "content"))

    # forced: everything again, same rows, and rows of vanished files stay
    before = {n: content(state, n, "id", "file_path") for n in plan.CONTENT_TABLES}
    os.remove(os.path.join(books, "solo.md"))
    assert outcome(ingest(spark, root, library, books, force=True))["books", "indexed"] == 1
    assert {n: content(state, n, "id", "file_path") for n in plan.CONTENT_TABLES} == before
    # unless they are pruned
    ingest(spark, root, library, books, prune=True)
    assert state.read("books").count() == 1


def test_a_changed_file_is_read_again(spark, trees):
    library, books, root = trees
    ingest(spark, root, library, books)
    state = StateTables(spark, root)
    assert state.read("scriptures").count() == 3 and state.read("books").count() == 2
    with open(os.path.join(books, "solo.md"), "a") as f:
        f.write("!")
    assert outcome(ingest(spark, root, library, books))["books", "rows"] == 1
    assert ("alone!",) in content(state, "books", "content")


def test_carried_columns_survive_and_backfill_corrects(spark, trees):
    library, books, root = trees
    ingest(spark, root, library)
    state = StateTables(spark, root)
    spoiled = state.read("talks").withColumn("speaker", F.lit("wrong")).withColumn("titsw_mode", F.lit("kept"))
    state.replace("talks", spoiled)
    counts = {r.status: r.n for r in backfill_stored_speakers(spark, root, library).collect()}
    assert counts == {"changed": 1, "failed": 1, "total": 2}
    assert content(state, "talks", "speaker", "titsw_mode") == [("Elder A", "kept"), ("wrong", "kept")]


def test_embedding_is_incremental(spark, trees):
    library, books, root = trees
    ingest(spark, root, library, books)

    def embedder(texts):
        if any("Second" in t for t in texts):
            raise RuntimeError("no")
        return embed.hashing_embedder(8)(texts)

    first = {r.source_type: (r.embedded, r.failed) for r in embed_pending(spark, root, embedder, "m", 8).collect()}
    assert first == {"scriptures": (3, 0), "talks": (1, 1), "manuals": (2, 0), "books": (3, 0)}
    state = StateTables(spark, root)
    assert state.read("embedding_failures").first().error == "RuntimeError: no"
    # only what failed is still pending
    second = embed_pending(spark, root, embed.hashing_embedder(8), "m", 8).collect()
    assert [tuple(r) for r in second] == [("talks", 1, 0)]
    layers = state.read("embeddings").filter("source_type = 'talks'").select("layer").collect()
    assert sorted(r.layer for r in layers) == ["paragraph", "paragraph_1"]
    assert embed_pending(spark, root, embed.hashing_embedder(8), "m", 8).count() == 0


def test_embedder_failures_are_per_chunk(frame):
    chunks = frame([("talks", i, "paragraph", t) for i, t in enumerate(["ok", "short", "!!", "none"])],
                   "source_type string, source_id bigint, layer string, content string")

    def embedder(texts):
        return [None if t == "none" else np.ones(3 if t == "short" else 4) * (t != "!!") for t in texts]

    rows = embed.embed_chunks(chunks.coalesce(1), embedder, "m", 4)
    errors = {r.content: r.error for r in rows.collect()}
    assert errors == {"ok": None, "short": "dimension 3 instead of 4", "!!": "zero vector", "none": "no vector"}
    assert embed.embedded(rows).count() == 1 and embed.embedding_failures(rows).count() == 3


def test_stream_equals_batch(spark, trees, tmp_path):
    library, _, root = trees
    ingest(spark, root, library)
    streamed = str(tmp_path / "streamed")
    for _ in range(2):  # the second run finds nothing new
        query = ingest_stream(spark, streamed, str(tmp_path / "checkpoint"), library, files_per_batch=5)
        query.awaitTermination()
        assert query.exception() is None
    a, b = StateTables(spark, root), StateTables(spark, streamed)
    for name in ("chapters", "scriptures", "talks", "manuals", "study_aids"):
        assert a.read(name).exceptAll(b.read(name)).count() == 0, name
        assert b.read(name).exceptAll(a.read(name)).count() == 0, name


def test_upsert_rules(frame):
    schema = "id bigint, k string, v string, kept string"
    old = frame([(1, "a", "x", "k1"), (2, "b", "y", "k2")], schema)
    new = frame([("a", None, "p1"), ("c", "n1", "p1"), ("c", "n2", "p2")], "k string, v string, path string")
    once = upsert(old, new, ["k"], ["v"], "path")
    assert {r.k: (r.v, r.kept) for r in once.collect()} == {"a": (None, "k1"), "b": ("y", "k2"), "c": ("n2", None)}
    twice = upsert(once, new, ["k"], ["v"], "path")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.k: r.id for r in once.collect()}["a"] == 1


def test_insert_if_absent_keeps_the_first(frame):
    old = frame([("a", "x")], "k string, v string")
    new = frame([("a", "y"), ("b", "2"), ("b", "1")], "k string, v string")
    assert [tuple(r) for r in insert_if_absent(old, new, ["k"], "v").collect()] == [("b", "1")]


def test_manifest_diff_of_itself_is_empty(spark, trees):
    listing = corpus.route_files(corpus.scan_corpus(spark, trees[0], with_content=False))
    manifest = corpus.manifest_rows(listing.withColumn("record_count", F.lit(1)))
    assert corpus.changed_files(corpus.manifest_diff(listing, manifest)).count() == 0
    assert corpus.changed_files(corpus.manifest_diff(listing, manifest, force=True)).count() == listing.count()


def test_odd_file_names_are_indexed_once_each(spark, tmp_path):
    names = ["talk[1]", "talk1", "a{b,c}", "ab", "star*", "what?", "k=v", "with space"]
    talk = "# T\n\nBy Elder A\n\nBody of {}."
    write_tree(tmp_path / "l", {f"eng/general-conference/2020/04/{n}.md": talk.format(n) for n in names})
    root = str(tmp_path / "s")
    got = outcome(ingest(spark, root, str(tmp_path / "l")))
    assert got["talks", "indexed"] == got["talks", "rows"] == len(names)
    bodies = {r.content for r in StateTables(spark, root).read("talks").collect()}
    assert all(any(f"Body of {n}." in b for b in bodies) for n in names)
    assert outcome(ingest(spark, root, str(tmp_path / "l")))["talks", "unchanged"] == len(names)


def test_prune_touches_only_the_given_roots(spark, trees, tmp_path):
    library, books, root = trees
    ingest(spark, root, library, books)
    before = content(StateTables(spark, root), "books", "file_path")
    os.remove(f"{library}/eng/manual/cfm/x/1.md")
    ingest(spark, root, library, prune=True)
    state = StateTables(spark, root)
    assert content(state, "books", "file_path") == before and content(state, "manuals", "file_path") == []
    assert state.read("index_metadata").filter("content_type = 'books'").count() == len(before)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="lists no file"):
        ingest(spark, root, books_root=str(tmp_path / "empty"), prune=True)


def test_parts_are_stored_with_the_state(spark, trees):
    library, books, root = trees
    ingest(spark, root, library, books, parts=7)
    assert StateTables(spark, root).parts == 7
    with pytest.raises(ValueError, match="has 7 parts"):
        StateTables(spark, root, 8)
