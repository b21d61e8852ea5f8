"""The streaming ingest: files are listed in tasks, upserts are deferred and settled."""

import os

import pytest
from pyspark.sql import functions as F

from quire import ingest, ingest_stream
from quire.sources.listing import list_tree
from quire.sources.tables import StateTables
from tests.test_ingest import LIBRARY, content, write_tree
from tests.test_listings import rows, same, talk


def run(spark, state, checkpoint, library, n):
    query = ingest_stream(spark, state, checkpoint, library, files_per_batch=n)
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_listing_is_that_of_spark(spark, tmp_path):
    write_tree(tmp_path, {**LIBRARY, ".git/x.md": "h", "_drafts/y.md": "h", "_k=v/z.md": "s", "a/.b.md": "h", "a b/[1]{2},*?.md": "s", "ü.md": "s"})
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.md")
    os.symlink(tmp_path / "eng/manual", tmp_path / "linked")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(str(tmp_path))
    want = {(r.path, r.modificationTime, r.length) for r in plain.select("path", "modificationTime", "length").collect()}
    for most in (0, 3, 20_000):  # folders are dealt out again or listed on the way
        got = list_tree(spark, f"{tmp_path}/", task_entries=most)
        assert {(r.path, r.mtime, r.size) for r in got.collect()} == want
    assert {r.rel_path for r in got.collect()} == {p.split(f"{tmp_path}/")[1] for p, _, _ in want} and len(want) == 12
    assert list_tree(spark, f"{tmp_path}/not there") is None and list_tree(spark, f"{tmp_path}/*") is None


def test_batches_are_settled_at_the_end(spark, tmp_path, monkeypatch):
    files = {f"eng/general-conference/2020/04/{i}.md": f"# T{i}\n\nBy Elder A\n\nBody." for i in range(11)}
    write_tree(tmp_path / "l", files)
    taken, rewritten, merge = [], [], StateTables._merge
    deferred = StateTables.merge

    def noted(self, name, batch, *args, **more):
        if name == "talks":
            taken.append(batch.count())
        return deferred(self, name, batch, *args, **more)

    def counted(self, name, *args):
        rewritten.append(name)
        return merge(self, name, *args)

    monkeypatch.setattr(StateTables, "merge", noted)
    monkeypatch.setattr(StateTables, "_merge", counted)
    run(spark, str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "l"), 3)
    state = StateTables(spark, str(tmp_path / "s"))
    assert taken == [3, 3, 3, 2] and rewritten.count("talks") == 1
    assert not any(state._later(name) for name in ("talks", "index_metadata"))
    assert {t for (t,) in content(state, "talks", "title")} == {f"T{i}" for i in range(11)} and state.counts("talks").first().n == 11
    # newer files only
    (tmp_path / "l/eng/general-conference/2020/04/3.md").write_text("# New\n\nBy Elder B\n\nBody.")
    os.utime(tmp_path / "l/eng/general-conference/2020/04/3.md", (2e9, 2e9))
    os.utime(tmp_path / "l/eng/general-conference/2020/04/4.md", (1e9, 1e9))
    run(spark, str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "l"), 3)
    assert taken == [3, 3, 3, 2, 1] and ("New",) in content(state, "talks", "title") and state.read("talks").count() == 11


def test_deferred_merges_read_as_merged(spark, tmp_path):
    def batch(name, values):
        return rows(spark, name, values)

    first = [talk(i) for i in range(6)]
    second = [{**talk(i, 1999, "10"), "speaker": None} for i in range(3, 9)]
    third = [{**talk(i), "title": "last"} for i in (0, 8)] + [{**talk(0), "file_path": None}]
    plain, put_off = (StateTables(spark, str(tmp_path / d), parts=4) for d in ("a", "b"))
    for state in (plain, put_off):
        state.merge("talks", batch("talks", first).withColumn("titsw_mode", F.lit("kept")).drop("id"))
    for values in (second, third, third[2:]):
        plain.merge("talks", batch("talks", values).drop("id"))
        put_off.merge("talks", batch("talks", values).drop("id"), later=True)

    def table(state):
        return sorted(map(str, state.read("talks").collect()))

    assert put_off._later("talks") == [1, 2, 3] and table(put_off) == table(plain)
    same(put_off)
    some = spark.createDataFrame([("t/0",), ("t/4",), ("t/77",)], "file_path string")
    assert sorted(r.file_path for r in put_off.read("talks", among=some).collect()) == ["t/0", "t/4"]
    # an update of other columns settles first
    for state in (plain, put_off):
        state.merge("talks", batch("talks", [{**talk(8), "speaker": "b"}]).drop("id"), update_cols=["speaker"])
    assert put_off._later("talks") == [] and table(put_off) == table(plain)
    same(put_off)


@pytest.mark.parametrize("broken", [1, 2])
def test_a_stream_that_broke_off_goes_on(spark, tmp_path, monkeypatch, broken):
    from quire.streaming import ingest as stream

    write_tree(tmp_path / "l", LIBRARY)
    calls, apply = [], stream.apply_files

    def failing(*args, **more):
        calls.append(1)
        if len(calls) == broken:
            raise RuntimeError("broken")
        return apply(*args, **more)

    monkeypatch.setattr(stream, "apply_files", failing)
    query = ingest_stream(spark, str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "l"), files_per_batch=3)
    with pytest.raises(Exception, match="broken"):
        query.awaitTermination()
    run(spark, str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "l"), 3)
    ingest(spark, str(tmp_path / "whole"), str(tmp_path / "l"))
    a, b = StateTables(spark, str(tmp_path / "whole")), StateTables(spark, str(tmp_path / "s"))
    for name in ("talks", "manuals", "study_aids"):
        assert sorted(map(str, a.read(name).collect())) == sorted(map(str, b.read(name).collect())), name
    assert a.read("index_metadata").count() == b.read("index_metadata").count() == 6
