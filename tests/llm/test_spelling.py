"""Spelling variants against a plain version over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import spelling
from quire.llm.common import Store, table

DOC = "doc_id bigint, text string, word string, n int"


def plain(rows):
    counts = Counter()
    for i, text, *_ in rows:
        said = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", said):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    near = {w: set() for w in words}
    gaps = {}
    for w in words:  # one edit: equal length and one place blanked, or one place deleted
        for i in range(len(w)):
            gaps.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, vs in near.items():
        if vs:
            v = min(vs, key=lambda v: (-words[v], v))
            if words[v] >= 5 * words[w]:
                form[w] = v
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want and any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_chains_ties_and_odd_rows(frame):
    said = ["reading"] * 130 + ["readings"] * 26 + ["readinks"] * 5 + ["étéété"] * 25 + ["étéétÉ"] * 5
    said += ["abcdefg"] * 25 + ["abcdefh"] * 25 + ["abcdefi"] * 5 + ["short"] * 9 + ["Reading"]
    rows = [(1, " ".join(said), "x", 1), (None, "reading, " * 5, "y", None), (2, None, None, None), (3, "", "z", 0), (1, "reading", "", 2), (1, "reading", "", 2)]
    got = {r["word"]: r for r in spelling.variants(frame(rows, DOC)).collect()}
    assert sorted(tuple(r) for r in got.values()) == plain(rows)
    assert (got["readinks"]["form"], got["readinks"]["root"]) == ("readings", "reading")
    assert got["abcdefi"]["form"] == "abcdefg" and got["reading"]["form"] is None and "short" not in got
    assert spelling.variants(frame([], DOC)).count() == 0


def test_long_runs_and_symbols(spark, frame):
    rows = [(i, "x" * 3000 + " " + "x" * 2999 + " abcdefgh abcdefgi", "", 1) for i in range(6)]
    for symbols in (2, 32):
        assert sorted(tuple(r) for r in spelling.variants(frame(rows, DOC), symbols=symbols).collect()) == plain(rows)
    long = "ab" * 100_000
    rows = [(i, f"{long} {long} {long}b", "", 1) for i in range(6)]
    assert {(len(r["word"]), r["n"], r["n_near"]) for r in spelling.variants(frame(rows, DOC), drop_every=1 << 40).collect()} == {(200_000, 12, 1), (200_001, 6, 1)}


def test_neighbourhood(spark):
    def full(r, symbols):
        out = {r} | {r[:i] + r[i + 1 :] for i in range(len(r))}
        out |= {r[:i] + s + r[i + 1 :] for i in range(len(r)) for s in symbols}
        return out | {r[:i] + s + r[i:] for i in range(len(r) + 1) for s in symbols}

    coded = lambda w: np.array([[int(c) + 1 for c in w]], np.uint64)
    for word in ("0", "012", "3333", "10210", "2222210"):
        _, names = spelling.neighbourhood(coded(word), 4)
        want = {x for x in full(word, "0123") if (len(x), x) <= (len(word), word)}
        assert len(names) == len(set(names.tolist())) == len(want)
        assert set(names.tolist()) == {spelling.names_of(coded(x))[0] for x in want}
    base, pairs = "x" * 70 + "é" + "y" * 70, []
    for a, b, near in ((base, base[:-1], 1), (base, "a" + base, 1), (base, base[:70] + "e" + base[71:], 1), (base, base[:70] + base[71:], 1), (base, base[:70] + base[72:], 0), (base, base[:69] + "ee" + base[71:], 0), (base, base[1:] + "z", 0), (base, base + "zz", 0), ("ab", "ba", 0)):
        pairs += [(a, b, bool(near)), (b, a, bool(near))]
    told = spark.createDataFrame(pairs, "a string, b string, near boolean")
    assert told.filter(spelling.one_edit(F.col("a"), F.col("b")) != F.col("near")).isEmpty()
    store = Store(spark, "spelling-test")
    pairs = spelling.near_pairs(spark.createDataFrame([("ab", 1), ("ac", 1), ("abc", 2), ("xyz", 3)], "word string, n bigint"), store)
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == {frozenset(x) for x in (("ab", "ac"), ("ab", "abc"), ("ac", "abc"))}
