"""The three forms of the stemmer agree: a word at a time, steps over a table, and SQL."""

import random

import duckdb

from quire.functions.stem import AFTER_PLURAL, STEP2, STEP3, STEP4, WHOLE, stem
from quire.functions.stem_steps import stems
from quire.operators import keyword
from quire.workload.stem_sql import STEMS

# A word and its stem by the published algorithm.
KNOWN = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consolation": "consol", "consolingly": "consol",
    "knackeries": "knackeri", "knightly": "knight", "generously": "generous", "communion": "communion", "arsenal": "arsenal",
    "happy": "happi", "say": "say", "ties": "tie", "cries": "cri", "gaps": "gap", "gas": "gas", "hopping": "hop", "hoping": "hope",
    "luxuriating": "luxuri", "agreed": "agre", "feed": "feed", "succeeding": "succeed", "skies": "sky", "relational": "relat",
    "geologist": "geologist", "replacement": "replac", "adoption": "adopt", "youth": "youth", "boyish": "boyish", "rolls": "roll",
}


def words():
    r = random.Random(11)
    ends = ["", "s", "es", "ed", "ing", "ly", "y", "ied", "ies", "eed", "eedly", "ingly", *STEP2, *STEP3, *STEP4]
    made = {"".join(r.choices("aeiouybcdlnrstvwxz", k=r.randint(0, 6))) + r.choice(ends) + r.choice(ends) for _ in range(6000)}
    return sorted(made | set(WHOLE) | AFTER_PLURAL | set(KNOWN) | {f"{w}s" for w in AFTER_PLURAL} | {"", "a", "yy", "ayyy", "éclairs", "übungen", "123s", "日本ing"})


def test_known_stems():
    assert {w: stem(w) for w in KNOWN} == KNOWN


def test_steps_and_sql_agree_with_the_word_form(frame):
    made = words()
    want = {w: stem(w) for w in made}
    rows = stems(frame([(w,) for w in made], "term string")).collect()
    assert {r["term"]: r["stem"] for r in rows} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE given (term VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?)", [(w,) for w in made])
    found = con.execute("WITH words AS (SELECT term FROM given)" + STEMS + " SELECT term, stem FROM stems").fetchall()
    assert dict(found) == want and len(found) == len(made)


def test_odd_vocabularies(frame):
    assert stems(frame([], "term string")).count() == 0
    assert [tuple(r) for r in stems(frame([(None,), ("ab",)], "term string")).collect()] == [(None, None), ("ab", "ab")]


def test_stemmed_postings_add_up(frame):
    rows = [("talks", 1, "hope", 2, 5), ("talks", 1, "hoping", 3, 5), ("talks", 2, "hoped", 1, 1), ("books", 1, "faith", 4, 4)]
    schema = "source_type string, source_id bigint, term string, tf int, doc_len int"
    got = {tuple(r) for r in keyword.stemmed_postings(frame(rows, schema)).collect()}
    assert got == {("talks", 1, "hope", 5, 5), ("talks", 2, "hope", 1, 1), ("books", 1, "faith", 4, 4)}
    given = frame([("hope", "x"), ("hoping", "x")], "term string, stem string")
    assert keyword.stemmed_postings(frame(rows, schema), given).collect() == [("talks", 1, "x", 5, 5)]


def test_postings_are_not_sorted_by_term_to_be_stemmed(spark, frame):
    rows = frame([("talks", 1, "hoping", 3, 5)], "source_type string, source_id bigint, term string, tf int, doc_len int")
    vocabulary = frame([("hoping", "hope")], "term string, stem string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyword.stemmed_postings(rows, vocabulary)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_large_postings_are_stemmed_and_stored_in_slices(spark, frame, tmp_path):
    """The rows are those of one pass; documents that repeat, null keys and null sources included."""
    from quire.operators.keyword import _slices, write_postings
    from quire.session import materialise

    words = ["hope", "hoped", "hoping", "faith", "faiths", "law"]
    rows = [(s, d, w, 1 + (d or 0) % 3, 9) for s in ("talks", None) for d in (*range(20), 7, None) for w in words]
    postings = materialise(frame(rows, "source_type string, source_id bigint, term string, tf int, doc_len int"), "postings")
    size = int(str(postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert _slices(postings, size) == 1 and _slices(postings, size // 3) > 2
    assert _slices(postings.groupBy("term").count(), 1) == 1 and _slices(postings.join(postings, "term"), 1) == 1
    whole = stemmed(keyword.stemmed_postings(postings))
    sliced = keyword.stemmed_postings(postings, slice_bytes=size // 3)
    assert stemmed(sliced) == whole and {r[2] for r in sliced.collect()} == {"hope", "faith", "law"}
    # no shuffle is left to whoever stores them
    assert "Exchange" not in sliced._jdf.queryExecution().executedPlan().toString()
    stored = write_postings(sliced, str(tmp_path / "p"), parts=4, slice_bytes=size // 3)
    assert stemmed(stored.drop("term_part")) == whole
    assert stemmed(write_postings(postings, str(tmp_path / "p"), parts=4).drop("term_part")) == stemmed(postings)


def stemmed(df):
    return sorted(map(str, df.collect()))
