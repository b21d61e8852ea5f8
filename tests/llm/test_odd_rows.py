"""Rows that share ids or have none, texts of very many lines, columns with the names that operators append."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, importance, jaccard, line_dedup, passages
from quire.llm.jobs import good_document

DOC = "doc_id bigint, text string"


def said(seed, n=80):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def near(words, i):
    return " ".join([*words[:i], "other", *words[i + 1 :]])


def test_representatives_are_chosen_by_row(frame):
    a, y = said(1), " ".join(said(2))
    rows = [(3, " ".join(a)), (7, near(a, 40)), (7, y), (3, " ".join(a)), (None, near(a, 1)), (9, None), (9, None), (8, ""), (None, y + " end")]
    got = jaccard.representatives(frame(rows, DOC)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(3, " ".join(a)), (7, y), (9, None), (9, None), (8, "")], key=repr)
    extra = frame([(1, " ".join(a), "x", 1), (1, " ".join(a), "y", 2), (2, y, None, 3)], DOC + ", k string, gone int").withColumn("comp", F.lit(0))
    got = jaccard.representatives(extra)
    assert got.columns == extra.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    assert jaccard.representatives(frame([], DOC)).count() == 0


def test_links_of_rows_without_id_and_of_repeated_ids(frame):
    a, b = said(3), said(4)
    rows = [(None, " ".join(a)), (5, near(a, 79)), (6, near(a, 0)), (6, " ".join(b)), (None, " ".join(said(5))), (None, None), (2, near(b, 1))]
    got = sorted((tuple(r) for r in jaccard.link(frame(rows, DOC)).collect()), key=repr)
    want = [(None, 76, 5), (5, 76, 5), (6, 76, 5), (6, 76, 2), (None, 76, None), (None, 0, None), (2, 76, 2)]
    assert got == sorted(want, key=repr)
    assert jaccard.link(frame([], DOC)).count() == 0


def test_many_lines(frame):
    """A text of 20,000 lines, its copy, and one that holds it between other lines."""
    r = random.Random(9)
    lines = [" ".join(f"w{r.randrange(100_000)}" for _ in range(3)) for _ in range(20_000)]
    text, other = "\n".join(lines), [f"own{i} line{i} here{i}" for i in range(2000)]
    rows = [(1, text), (2, text), (3, "\n".join([*other[:1000], *lines[5000:15_000], *other[1000:]])), (4, "head " + " ".join(lines[:9000]) + " tail")]
    for cut in (passages.dedup_passages(frame(rows, DOC)), line_dedup.dedup_lines(frame(rows, DOC))):
        got = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert got[1] == text and got[2] == "" and got[3] == "\n".join(other)
    assert {r["doc_id"]: r["text"] for r in passages.dedup_passages(frame(rows, DOC)).collect()}[4] == "head tail"
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.link(frame(rows, DOC)).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4}


def test_cut_keeps_line_ends(frame):
    p = [f"p{i}" for i in range(50)]
    text = " ".join(p)
    broken = " ".join(p[:10]) + "  \n\n   " + " ".join(p[10:30]) + " \n\t" + " ".join(p[30:])
    cases = [
        (text + "\n\nend", "\nend"), ("a b " + text, "a b"), ("a " + broken + " z", "a\n\n\tz"), ("  " + broken + "\n  y", "\n  y"), ("c\n  " + broken + " d", "c\n\n\td"),
        ("e " + text + "\n   \n f", "e\n   \n f"), (broken, ""), ("\n\n" + text, "\n"), ("g\n" + text + "\n", "g\n"), (text + " " + text, ""),
    ]
    rows = [(0, text), *[(i + 1, t) for i, (t, _) in enumerate(cases)]]
    got = {r["doc_id"]: r["text"] for r in passages.dedup_passages(frame(rows, DOC)).collect()}
    assert [got[i + 1] for i in range(len(cases))] == [w for _, w in cases]


NAMES = ["n_lines", "n_words_cut", "k", "runs", "cut", "N_Removed", "n_words", "spans", "items", "log_weight", "_log_weight"]
NAMES += ["_k", "_runs", "_cut", "removed", "gone", "place", "mix", "comp"]


def test_clashing_columns(frame):
    rows = [(i, " ".join(said(i % 3)), i) for i in range(6)]
    docs = frame(rows, DOC + ", own int").select("doc_id", "text", *[F.col("own").alias(n) for n in NAMES])
    bench = frame([(1, " ".join(said(1)))], "item_id bigint, text string")
    own = lambda df: all(r[i + 2] == r["doc_id"] for r in df.collect() for i in range(len(NAMES)))
    for cut, n in ((passages.dedup_passages(docs), 3), (line_dedup.dedup_lines(docs), 2), (decontaminate.find_passages(docs, bench), 3)):
        assert len(set(map(str.lower, cut.columns))) == len(docs.columns) + n and own(cut)
    labels = frame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    spark = docs.sparkSession
    for kept in (
        lambda: importance.keep(docs, labels, good_document()), lambda: decontaminate.clean(docs, bench),
        lambda: corpus_pipeline.line_deduplication(spark, docs, ""), lambda: corpus_pipeline.jaccard_join(spark, docs, ""),
    ):
        left = kept()
        assert left.columns == docs.columns and own(left)


def test_empty_tables(frame):
    docs = frame([], DOC)
    assert passages.dedup_passages(docs).count() == line_dedup.dedup_lines(docs).count() == 0
