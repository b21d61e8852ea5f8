"""The inverted multi-index against brute force."""

import numpy as np
import pytest

from quire.llm import multi_index
from quire.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, rank string, x int"


def brute(rows, every=20, k=20):
    """All neighbours in order, by id: the exact answer."""
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and not any(c is None or not np.isfinite(c) for c in v) and any(v):
            good[i] = min(good.get(i, list(v)), list(v))
    ids = sorted(good)
    x = np.array([good[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            score = (x * x[q]).sum(axis=1)
            out[i] = sorted((-s, j) for s, j in zip(score.tolist(), ids, strict=True) if j != i)[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clustered(n=900, dim=10, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dim))
    return [(int(i), [float(c) for c in np.float32(v * r.uniform(0.5, 2))], "a", 1) for i, v in enumerate(x)]


def test_exact_when_all_is_visited(frame):
    rows = clustered()
    rows += [(1000 + i, rows[3][1], "copy", 2) for i in range(300)]
    rows += [(2000, None, "", 0), (2020, [], "", 0), (2040, [0.0] * 10, "", 0), (2060, [float("nan")] * 10, "", 0), (2080, [1.0, None] * 5, "", 0)]
    rows += [(None, rows[0][1], "", 0), (0, rows[0][1], "again", 5)]
    got = answers(multi_index.nearest(frame(rows, SCHEMA), target=1.0, block_rows=64, query_rows=16))
    assert got == brute(rows)


def test_recall(frame):
    rows = clustered(3000, 16, 2)
    got, want = answers(multi_index.nearest(frame(rows, SCHEMA), block_rows=256)), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, size):
    vectors = table(spark, f"/root/testdata/sf{size}", "embeddings")
    got = answers(multi_index.nearest(vectors))
    want = brute([tuple(r)[:2] for r in vectors.collect()])
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.93 * sum(map(len, want.values()))


def test_walk_is_in_order_and_stops():
    r = np.random.default_rng(4)
    one, two, sizes = r.normal(size=9), r.normal(size=7), r.integers(0, 4, 63)
    sums = (one[:, None] + two[None, :]).ravel()
    way = [int(c) for c in np.argsort(sums) if sizes[c]]
    cells, last = multi_index.visit(one, two, sizes, 1 << 30)
    assert cells == way and last == sums.max()
    cells, last = multi_index.visit(one, two, sizes, 40)
    assert cells == way[: len(cells)] and last == sums[cells[-1]] and sizes[cells[:-1]].sum() < 40 <= sizes[cells].sum()


def test_few_rows(frame):
    assert multi_index.nearest(frame([], SCHEMA)).count() == 0
    assert multi_index.nearest(frame([(0, None, "", 1)], SCHEMA)).count() == 0
    assert multi_index.nearest(frame([(0, [1.0], "", 1)], SCHEMA)).count() == 0
    got = multi_index.nearest(frame([(0, [1.0], "", 1), (7, [2.0], "", 1), (3, [2.0], "", 1), (20, [1.0, 2.0], "", 1)], SCHEMA)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 3, 2.0), (0, 2, 7, 2.0)]
