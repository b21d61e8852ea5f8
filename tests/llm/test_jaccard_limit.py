"""Near a hub a set keeps its difference wherever a similar set may leave its signature."""

import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard


@pytest.mark.parametrize("percent", [80, 85])
def test_differences_reach_every_similar_set(spark, percent):
    limit = jaccard._limit(F.col("id"), percent, jaccard.REACH).alias("limit")
    kept = {r["id"]: r["limit"] for r in spark.range(1, 200).select("id", limit).collect()}
    most = lambda n: (100 - percent) * n // percent
    for x in range(1, 200):
        for y in range(1, 200):
            # Sets of x and y elements differ by at most this when they are similar.
            apart = (100 - percent) * (x + y) // (100 + percent)
            if apart >= abs(x - y):
                assert jaccard.REACH * most(x) + apart - (apart - abs(x - y)) % 2 <= kept[y]
