"""Signatures from differences: the first half of a prefix probes, and every similar pair still meets."""

import random

from quire.llm import jaccard
from quire.llm.common import Store

PERCENT = 85


def test_similar_sets_meet_where_one_of_them_probes(spark, frame):
    r = random.Random(5)
    hub = set(range(100))
    sets = []
    for family in range(12):
        base = (hub - set(r.sample(range(100), 30))) | {1000 * (family + 1) + i for i in range(r.randint(15, 35))}
        for copy in range(8):
            gone = set(r.sample(sorted(base), r.randint(0, 6)))
            sets.append((base - gone) | {100_000 * (len(sets) + 1) + i for i in range(r.randint(0, 6))})
    met, labels = [], []
    for cls, x in enumerate(sets, 1):
        differ, both = len(x ^ hub), len(x & hub)
        linked = 100 * both >= PERCENT * (len(x) + 100 - both)
        met.append((-1, cls, differ, linked, (100 - PERCENT) * len(x) // PERCENT, sorted(x ^ hub)))
        labels.append((cls, cls))
    met = frame(met, "hub bigint, cls bigint, differ int, linked boolean, most int, diff array<bigint>")
    rows = jaccard._differences(met, frame(labels, "cls bigint, comp bigint"), PERCENT, Store(spark, "probes")).collect()
    of = {}
    for x in rows:
        of.setdefault(x["cls"], {})[x["sig"]] = x["probe"]
        assert x["weight"] == -len(sets[x["cls"] - 1] ^ hub)
    similar = 0
    for a in range(1, len(sets) + 1):
        for b in range(1, a):
            x, y = sets[a - 1], sets[b - 1]
            if 100 * len(x & y) >= PERCENT * len(x | y):
                similar += 1
                common = of[a].keys() & of[b].keys()
                assert any(of[a][s] or of[b][s] for s in common)
    assert similar > 50
    assert any(not x["probe"] for x in rows)
