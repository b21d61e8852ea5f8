"""Alignment of two tokenizers against a plain version that walks single tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import alignment, packing
from quire.llm.common import table
from quire.llm.jobs import pieces, vocabulary

DOC = "doc_id bigint, text string, keys string, row int"


def plain(rows):
    tok = alignment.Tokenizers.of(public_tokenizers.path("byte_bpe_50k.json"), pieces())
    said, counts = [], Counter()
    for doc_id, text, *_ in rows:
        groups = []
        if text:
            a, b = tok.encode_a(" " + text), tok.b.encode(text)
            whole = (" " + text).encode()
            if b"".join(tok.a_bytes[i] for i in a) == whole == b"".join(tok.b_bytes[i] for i in b):
                i = j = end_a = end_b = 0
                mine, theirs = [], []
                while i < len(a) or j < len(b):
                    if end_a <= end_b and i < len(a):
                        mine.append(a[i])
                        end_a += len(tok.a_bytes[a[i]])
                        i += 1
                    else:
                        theirs.append(b[j])
                        end_b += len(tok.b_bytes[b[j]])
                        j += 1
                    if end_a == end_b and mine and theirs:
                        groups.append((mine, theirs))
                        mine, theirs = [], []
                assert not mine and not theirs
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        said.append((doc_id, groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, groups, links in said:
        digest = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(m for p, m in links.items() if counts[p] == top[p[0]])
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), best,
            sum(m * counts[p] for p, m in links.items()), hashlib.sha256(digest.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def odd(seed=3):
    r = random.Random(seed)
    rows = [(i, "".join(r.choices("ab \n\té世\U0001f600.,'1", k=r.randint(1, 120))), "k", 1) for i in range(60)]
    rows += [(100, None, "", 1), (101, "", "", 1), (102, "▁x", "", 1), (103, "<unk> <s> <|endoftext|> <0x41>", "", 1), (None, "some words", "", None)]
    rows += [(104, " lead  and  trail ", "", 1), (105, "\x00\x01", "", 1), (1, rows[1][1], "", 2), (1, rows[1][1], "", 2), (106, "word " * 3000, "", 1)]
    return rows


def test_against_plain_version(frame):
    rows = odd()
    want = plain(rows)
    for args in ({}, {"slice_bytes": 40, "slice_links": 5, "sent_pairs": 20}, {"sent_pairs": 0}):
        got = alignment.report(frame(rows, DOC), vocabulary(), pieces(), **args)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert alignment.report(frame([], DOC), vocabulary(), pieces()).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((tuple(r) for r in alignment.report(docs, vocabulary(), pieces()).collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_both_forms_of_the_vocabulary_agree(spark):
    """The ranks give the ids of the named file on every document, and the same bytes an id."""
    plainly = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plainly.encode_special_tokens = True
    texts = [" " + (r["text"] or "") for r in table(spark, "/root/testdata/sf0.1", "documents").limit(100_000).collect()]
    fast = packing.encoder(vocabulary())
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        assert [e.ids for e in plainly.encode_batch(some, add_special_tokens=False)] == [list(fast(t)) for t in some]
    named, ranked = (alignment._byte_level(p) for p in (public_tokenizers.path("byte_bpe_50k.json"), vocabulary()))
    assert named[: len(ranked)] == ranked


def test_gallop():
    r = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (1, 1), (3, 1000), (700, 800), (64, 65), (2000, 40)):
        short, long = np.unique(r.integers(0, 3000, n)), np.unique(r.integers(0, 3000, m))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()
        i, j = alignment.shared_ends(short, long)
        both, want_i, want_j = np.intersect1d(short, long, return_indices=True)
        assert (i == want_i).all() and (j == want_j).all()


def test_pairs_of_one_long_group():
    """A group of many tokens on both sides comes in parts, whole."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 50, 400), r.integers(0, 60, 500)
    na, nb, doc = np.array([3, 390, 7]), np.array([5, 490, 5]), np.array([0, 1, 1])
    want = Counter()
    for g in range(3):
        for x in a[sum(na[:g]) : sum(na[: g + 1])]:
            for y in b[sum(nb[:g]) : sum(nb[: g + 1])]:
                want[(int(doc[g]), int(x) * 100 + int(y))] += 1
    for most in (1, 100, 1000, 1 << 20):
        got = Counter()
        for d, key, times in alignment._pairs(a, b, na, nb, doc, 100, most):
            for row in zip(d.tolist(), key.tolist(), times.tolist(), strict=True):
                assert row[:2] not in got
                got[row[:2]] = row[2]
        assert got == want
