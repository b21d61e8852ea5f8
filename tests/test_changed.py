"""The reader of named files: only changed files are opened, under their literal names."""

import os

import pytest

from quire import backfill_stored_speakers, ingest
from quire.session import materialise
from quire.sources import changed, corpus
from quire.sources.tables import StateTables
from quire.streaming.ingest import ingest_watch
from tests.test_ingest import write_tree

NAMES = ["talk[1]", "talk1", "a{b,c}", "ab", "star*", "what?", "k=v", "with space", "per%20cent", "ü"]
TALK = "# T\n\nBy Elder {}\n\nBody of {}."


def talk_tree(names, who="A"):
    return {f"eng/general-conference/2020/04/{n}.md": TALK.format(who, n) for n in names}


@pytest.fixture
def library(tmp_path):
    write_tree(tmp_path / "l", talk_tree(NAMES))
    return str(tmp_path / "l")


def test_reads_named_files_literally(spark, library):
    listing = materialise(corpus.scan_corpus(spark, library, with_content=False), "listing")
    opened = spark.sparkContext.accumulator(0)
    got = {r.rel_path.rsplit("/", 1)[1]: r.content for r in changed.read_contents(listing, opened, task_files=3).collect()}
    assert got == {f"{n}.md": TALK.format("A", n) for n in NAMES} and opened.value == len(NAMES)
    odd = listing.filter("rel_path like '%talk1.md' or rel_path like '%star%'")
    assert changed.read_contents(odd).count() == 2
    assert changed.read_contents(listing.limit(0)).columns[-1] == "content"
    assert changed.read_contents(listing.limit(0)).count() == 0
    os.remove(f"{library}/eng/general-conference/2020/04/ab.md")
    assert changed.read_contents(listing).count() == len(NAMES) - 1


def test_paths_of_stores():
    assert changed._split("file:/a b/c:d.md") == ("", "/a b/c:d.md")
    assert changed._split("file:///a/x//y.md") == ("", "/a/x//y.md")
    assert changed._split("s3://bucket/a/[b].md") == ("s3://bucket", "a/[b].md")
    assert changed._split("/plain/x.md") == ("", "/plain/x.md")
    assert changed.readable("file:/x") and not changed.readable("viewfs://cluster/x")


def test_a_run_opens_what_changed(spark, library, tmp_path):
    root = str(tmp_path / "s")
    first, second, third = (spark.sparkContext.accumulator(0) for _ in range(3))
    ingest(spark, root, library, opened=first)
    write_tree(tmp_path / "l", talk_tree(["new [2]", "what?"], "B"))
    summary = {(r.content_type, r.outcome): r.n for r in ingest(spark, root, library, opened=second).collect()}
    ingest(spark, root, library, opened=third)
    assert (first.value, second.value, third.value) == (len(NAMES), 2, 0)
    assert summary["talks", "indexed"] == 2 and summary["talks", "unchanged"] == len(NAMES) - 1
    speakers = {r.file_path.rsplit("/", 1)[1]: r.speaker for r in StateTables(spark, root).read("talks").collect()}
    assert speakers == {**{f"{n}.md": "Elder A" for n in NAMES}, "what?.md": "Elder B", "new [2].md": "Elder B"}


def test_backfill_opens_the_talks_only(spark, library, tmp_path):
    write_tree(tmp_path / "l", {f"eng/manual/cfm/{i}.md": "# M\n\ntext" for i in range(5)})
    root = str(tmp_path / "s")
    ingest(spark, root, library)
    opened = spark.sparkContext.accumulator(0)
    counts = {r.status: r.n for r in backfill_stored_speakers(spark, root, library, opened=opened).collect()}
    assert counts == {"unchanged": len(NAMES), "total": len(NAMES)} and opened.value == len(NAMES)
    os.remove(f"{library}/eng/general-conference/2020/04/ab.md")
    counts = {r.status: r.n for r in backfill_stored_speakers(spark, root, library).collect()}
    assert counts == {"unchanged": len(NAMES) - 1, "missing": 1, "total": len(NAMES)}


def test_a_store_that_only_spark_opens_is_scanned(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(changed, "readable", lambda root: False)
    root = str(tmp_path / "s")
    opened = spark.sparkContext.accumulator(0)
    ingest(spark, root, library, opened=opened)
    assert StateTables(spark, root).read("talks").count() == len(NAMES) and opened.value == 0


def test_watch_sees_times_that_move_backwards(spark, library, tmp_path):
    root, place = str(tmp_path / "s"), f"{library}/eng/general-conference/2020/04/ab.md"

    def tick(**more):
        query = ingest_watch(spark, root, str(tmp_path / f"c{len(os.listdir(tmp_path))}"), library, once=True, **more)
        query.awaitTermination()
        assert query.exception() is None
        return {r.file_path.rsplit("/", 1)[1]: r.speaker for r in StateTables(spark, root).read("talks").collect()}

    assert len(tick()) == len(NAMES)
    with open(place, "w") as file:
        file.write(TALK.format("B", "ab"))
    os.utime(place, (1e9, 1e9))
    assert tick()["ab.md"] == "Elder B"
    os.remove(place)
    assert "ab.md" in tick() and "ab.md" not in tick(prune=True)


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """A few tasks a core, not one for 32 files; the workload's tree comes from one pass over the documents."""
    from quire.sources import corpus
    from quire.workload import views

    for i in range(4000):
        (tmp_path / f"{i}.md").write_text(str(i))
    scan = corpus.scan_corpus(spark, str(tmp_path))
    assert scan.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r.rel_path, r.content) for r in scan.collect()} == {(f"{i}.md", str(i)) for i in range(4000)}
    plan = views.tree_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
