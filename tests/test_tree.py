"""The scan of a tree holds no file names on the driver."""

from quire import ingest
from quire.sources import changed, corpus
from quire.sources.tables import StateTables
from tests.test_ingest import LIBRARY, write_tree


def test_a_scan_lists_in_tasks(spark, tmp_path):
    write_tree(tmp_path / "l", LIBRARY)
    root = str(tmp_path / "l")
    for content in (False, True):
        scan = corpus.scan_corpus(spark, root, with_content=content)
        # Spark's file source keeps a status of every file on the driver as long as the plan lives
        assert not any("/l/" in f for f in scan.inputFiles())
        assert {r.rel_path for r in scan.collect()} == set(LIBRARY)


def test_where_only_spark_lists_the_scan_is_spark_s(spark, tmp_path, monkeypatch):
    write_tree(tmp_path / "l", LIBRARY)
    mine = corpus.scan_corpus(spark, str(tmp_path / "l"))
    monkeypatch.setattr(changed, "readable", lambda root: False)
    theirs = corpus.scan_corpus(spark, str(tmp_path / "l"))
    assert any("/l/" in f for f in theirs.inputFiles())
    assert mine.dtypes == theirs.dtypes and sorted(mine.collect()) == sorted(theirs.collect())


def test_an_ingest_never_lists_a_tree_on_the_driver(spark, tmp_path, monkeypatch):
    write_tree(tmp_path / "l", LIBRARY)
    root, state = str(tmp_path / "l"), str(tmp_path / "s")

    def refused(raw):
        raise AssertionError("Spark's file source lists on the driver")

    monkeypatch.setattr(corpus, "in_shares", refused)
    ingest(spark, state, root)
    (tmp_path / "l/eng/scriptures/tg/faith.md").unlink()
    ingest(spark, state, root, prune=True)
    assert StateTables(spark, state).read("study_aids").isEmpty() and StateTables(spark, state).read("index_metadata").count() == 5
