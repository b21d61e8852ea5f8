"""Scratch of the line stage: what is stored, what is dropped, and that texts are cut once."""

from pathlib import Path

import corpus_pipeline
from quire.llm import passages
from quire.llm.common import Store, row_key
from quire.session import scratch_root

DOC = "doc_id bigint, text string"


def _rows():
    passage = " ".join(f"p{i}" for i in range(60))
    return [(i, f"head {i}\n{passage}\ntail {i} " + " ".join(f"t{i * j}" for j in range(60))) for i in range(1, 6)]


def test_tables_of_whole_lines_go_before_passages(spark, frame):
    before = set(Path(scratch_root(spark)).rglob("*.parquet"))
    kept = corpus_pipeline.line_deduplication(spark, frame(_rows(), DOC), "")
    left = {p.parent.name.split("-", 1)[-1] for p in set(Path(scratch_root(spark)).rglob("*.parquet")) - before}
    assert left and not left & {"profile", "windows"}
    assert kept.count() == 5


def test_open_runs_are_stored_and_words_cut_once(spark, frame, monkeypatch):
    names, save = [], Store.save
    monkeypatch.setattr(Store, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    docs = frame(_rows(), DOC)
    assert passages.repeated_runs(docs).count() == 4
    assert "unsettled" in names
    keyed = docs.select(row_key(docs["doc_id"], docs["text"]).alias("k"), "doc_id", "text")
    plan = passages._words(keyed, 50).select("k", "hs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(lambda") == 1
