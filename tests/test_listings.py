from pyspark.sql import functions as F

from quire.operators import catalog
from quire.schemas import TABLES
from quire.sources.tables import COUNTED, StateTables

KINDS = ("", "scriptures", "talks", "manuals", "books", "study_aids")


def rows(spark, name, values):
    """Rows of a state table from partial dictionaries."""
    frame = spark.createDataFrame([tuple(v.get(n) for n in TABLES[name].names) for v in values], TABLES[name])
    return frame


def same(state):
    tables, counts = state.all(tuple(COUNTED)), state.all_counts()
    for kind in KINDS:
        assert catalog.kept_listing(counts, kind).collect() == catalog.listing(tables, kind).collect(), kind


def talk(i, year=2001, month="04"):
    return {"id": i, "year": year, "month": month, "speaker": "a", "title": "t", "content": "c", "file_path": f"t/{i}"}


def test_counts_follow_every_write(spark, tmp_path):
    state = StateTables(spark, str(tmp_path / "state"), parts=4)
    same(state)
    state.merge("talks", rows(spark, "talks", [talk(i, 2000 + i % 3) for i in range(30)]).drop("id"))
    state.replace("manuals", rows(spark, "manuals", [{"id": i, "collection_id": "m" if i % 2 else None, "file_path": f"m/{i}"} for i in range(9)]))
    state.replace("scriptures", rows(spark, "scriptures", [
        {"id": i, "volume": "v", "book": f"b{i % 3}", "chapter": i, "verse": 1, "file_path": "s"} for i in range(12)]))
    same(state)
    # some talks move to another session: counted there and no longer in the old one
    state.merge("talks", rows(spark, "talks", [talk(i, 1999, "10") for i in range(5)]).drop("id"), update_cols=["year", "month"])
    same(state)
    assert state.counts("talks").filter("year = 1999").first().n == 5
    vectors = rows(spark, "embeddings", [{"source_type": "talks", "source_id": i, "layer": "p", "content": "", "embedding": [1.0], "model": "m"} for i in range(20)])
    state.append("embeddings", vectors)
    state.append("embeddings", vectors.limit(3).withColumn("layer", F.lit("q")))
    same(state)
    few = vectors.select("source_type", "source_id").filter("source_id < 18")
    state.swap("embeddings", few, vectors.limit(0))
    same(state)
    assert state.counts("embeddings").first().n == 2
    state.replace("scriptures", state.read("scriptures").limit(0))
    same(state)


def test_missing_counts_are_counted_when_read(spark, tmp_path):
    state = StateTables(spark, str(tmp_path / "state"), parts=4)
    state.merge("talks", rows(spark, "talks", [talk(i) for i in range(30)]).drop("id"))
    state._forget("talks", {0, 2})  # as a write leaves it that broke off
    same(state)
    state.recount("talks")
    assert state._parts_of("_counts/talks") == state._parts_of("talks")
    state._forget("talks", None)
    same(state)


def test_listings_read_no_texts(spark, tmp_path):
    state = StateTables(spark, str(tmp_path / "state"), parts=4)
    state.merge("talks", rows(spark, "talks", [talk(i) for i in range(30)]).drop("id"))
    assert all("/_counts/" in f for f in catalog.kept_listing(state.all_counts(), "talks").inputFiles())
