"""Vectors that follow their texts: digests, replacement, other models, failures, older states."""

import pytest

from quire import embed_changed, embed_pending
from quire.operators import embed
from quire.session import materialise
from quire.schemas import TABLES
from quire.sources.tables import StateTables

MODEL = "hash-8"


def keep(state, docs):
    """Talks with the given texts."""
    rows = [(i, text, f"{i}.md") for i, text in docs.items()]
    given = state.spark.createDataFrame(rows, "id bigint, content string, file_path string")
    fields = TABLES["talks"].fields
    full = given.selectExpr(*[f.name if f.name in given.columns else f"cast(null as {f.dataType.simpleString()}) {f.name}" for f in fields])
    state.replace("talks", full)


def vectors(state):
    return sorted((r.source_id, r.layer, r.content, r.model) for r in state.read("embeddings").collect())


def run(state, fn=None, model=MODEL):
    did = embed_changed(state.spark, state.root, fn or embed.hashing_embedder(8), model, 8)
    return {r.outcome: r.n for r in did.collect()}


@pytest.fixture
def state(spark, tmp_path):
    return StateTables(spark, str(tmp_path / "s"), parts=4)


def test_outdated_vectors_go_and_unchanged_documents_are_left_alone(state):
    keep(state, {1: "one\n\ntwo", 2: "alike", 3: "gone later", 4: None, 5: ""})
    assert run(state) == {"new": 3, "embedded": 4}
    keep(state, {1: "one\n\nother", 2: "alike", 4: "now here"})

    def watched(texts):
        assert not {"alike", "one"} & set(texts), texts
        return embed.hashing_embedder(8)(texts)

    assert run(state, watched) == {"changed": 1, "new": 1, "vanished": 1, "kept": 1, "embedded": 2}
    assert [(i, c) for i, _, c, _ in vectors(state)] == [(1, "one"), (1, "other"), (2, "alike"), (4, "now here")]
    assert run(state, watched) == {}
    keep(state, {})
    assert run(state) == {"vanished": 3} and vectors(state) == []
    assert state.read("embedded_documents").isEmpty()


def test_another_model_replaces_every_vector(state):
    keep(state, {1: "one", 2: "two"})
    run(state)
    assert run(state, model="other") == {"changed": 2, "embedded": 2}
    assert {m for *_, m in vectors(state)} == {"other"}


def test_failed_chunks_are_tried_again(state):
    keep(state, {1: "good\n\nbad", 2: "fine"})

    def broken(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return embed.hashing_embedder(8)(texts)

    assert run(state, broken) == {"new": 2, "embedded": 2, "failed": 1}
    assert state.read("embedding_failures").count() == 1
    assert run(state) == {"new": 1, "kept": 1, "embedded": 1}
    assert [c for _, _, c, _ in vectors(state)] == ["good", "bad", "fine"]


def test_vectors_of_pending_runs_are_taken_over(spark, state):
    keep(state, {i: f"text {i}" for i in range(9)})
    embed_pending(spark, state.root, embed.hashing_embedder(8), MODEL, 8).count()
    assert run(state) == {"new": 9, "kept": 9} and len(vectors(state)) == 9


def test_vectors_stored_without_partitions(spark, state):
    keep(state, {1: "one", 2: "two"})
    old = spark.createDataFrame([("talks", 1, "paragraph", "one", [1.0] * 8, MODEL), ("books", 7, "paragraph", "b", [1.0], MODEL)], TABLES["embeddings"])
    old.write.parquet(f"{state.root}/embeddings")
    assert state.read("embeddings").count() == 2
    assert run(state) == {"new": 2, "kept": 1, "embedded": 1}
    assert [(i, c) for i, _, c, _ in vectors(state)] == [(1, "one"), (2, "two"), (7, "b")]


def test_swap_leaves_other_partitions_alone(spark, state, tmp_path):
    row = lambda i, c="x": ("talks", i, "paragraph", c, [1.0], MODEL)
    make = lambda rows: materialise(spark.createDataFrame(rows, TABLES["embeddings"]), "rows")
    state.append("embeddings", make([row(i) for i in range(40)]))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s" / "embeddings").rglob("*.parquet")}
    before = files()
    state.swap("embeddings", make([row(3)]), make([row(3, "y")]))
    after = files()
    assert sum(after.get(f) == t for f, t in before.items()) == len(before) - 1
    assert {(i, c) for i, _, c, _ in vectors(state)} == {(i, "y" if i == 3 else "x") for i in range(40)}


def test_texts_with_a_zero_vector_are_stored_and_not_tried_again(state):
    keep(state, {1: "one\n\n!!", 2: "..."})
    assert run(state) == {"new": 2, "embedded": 3}
    assert sorted((i, c) for i, _, c, _ in vectors(state)) == [(1, "!!"), (1, "one"), (2, "...")]
    assert run(state) == {}
    keep(state, {1: "one more\n\n!!", 2: "..."})
    assert run(state) == {"changed": 1, "kept": 1, "embedded": 1}
