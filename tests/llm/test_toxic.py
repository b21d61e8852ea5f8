"""Toxic text that the models have not seen is not selected, however long its document."""

import numpy as np
from pyspark.sql import functions as F

from quire.llm import importance


def test_unseen_toxic_text_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    unseen = labels.filter("doc_id % 2 = 1 and quality = 1")
    got, ratios, cut = importance.resample(docs, labels.filter("doc_id % 2 = 0"), good)
    rows = got.join(unseen, "doc_id").groupBy("toxic").agg(F.avg(F.col("selected").cast("int")).alias("kept")).collect()
    share = {r["toxic"]: r["kept"] for r in rows}
    print("kept", share)
    assert share[0] > 0.97 and share[1] < 0.12
    # A toxic text inside a long good one weighs as much as alone.
    texts = docs.join(unseen, "doc_id").join(got.select("doc_id", "selected"), "doc_id").filter("length(text) between 300 and 1500")
    pick = lambda where, n: [r["text"] for r in texts.filter(where).orderBy("doc_id").limit(n).collect()]
    clean, toxic = pick("toxic = 0 and selected", 40), pick("toxic = 1 and not selected", 12)
    long = [(i, " ".join([*clean[:20], t, *clean[20:]])) for i, t in enumerate(toxic)] + [(99, " ".join(clean))]
    scored = importance.score(spark.createDataFrame(long, "doc_id bigint, text string"), ratios).collect()
    weight = {r["doc_id"]: r["log_weight"] for r in scored}
    assert weight[99] > cut and sum(weight[i] < cut for i in range(12)) >= 10


def test_cut_heeds_both_kinds():
    good, none = np.arange(1000.0), np.empty(0)
    low, high = np.quantile(good, [0.015, 0.025])
    cut = lambda toxic: importance.joint_cut(good, np.array(toxic))
    assert abs(cut(none) - low) < 1e-9 and abs(cut([-5.0] * 9) - low) < 1e-9 and abs(cut([500.0] * 9) - high) < 1e-9
    assert 20 < cut([20.0] * 9) < 20.1 and importance.joint_cut(none, good) is None
    assert importance.worst_passage(np.array([1.0, 0, 3, 0, 1, 0, 0, 1]), 2) == 5.0
