"""Each operator against its plain version, and its defined results for odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import check
from quire.llm import chat, decontaminate, fingerprint, importance, jaccard, line_dedup, packing, sharding, url_trust, warc
from quire.llm.jobs import JOBS, RULES, vocabulary
from quire.llm.oracle import SQL
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def corpus(seed=1, rows=120):
    """Prose with repeats, near copies, shared passages, benchmark text, nulls, empties and a repeated row."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(400)]
    line = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, out = line(60), []
    for i in range(rows):
        text = "\n".join(line(r.randint(1, 40)) for _ in range(r.randint(1, 6)))
        if i % 5 == 1:
            text = out[r.randrange(len(out))][1] or ""
        if i % 5 == 2:
            words = (out[r.randrange(len(out))][1] or "x").split(" ")
            words[r.randrange(len(words))] = "zz"
            text = " ".join(words)
        if i % 7 == 3:
            text += "\n" + passage + "\n" + line(4)
        out.append((i, text))
    return [*out, (rows, None), (rows + 1, ""), (rows + 2, " \n\t "), (rows + 3, "Only three words"), (rows + 4, "only THREE words"), out[0]]


@pytest.mark.parametrize("name", [n for n in JOBS if n in SQL])
def test_query_matches_its_sql(spark, name):
    assert check.compare(spark, SF_DIR, name).startswith("match")


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_links(frame, width, percent):
    rows = corpus()
    got = sorted(tuple(r) for r in jaccard.link(frame(rows, DOC), width, percent).collect())
    assert got == brute.jaccard_components(rows, width, percent)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for n, extra in ((1, 0), (30, 5), (100, 40), (900, 300), (900, 1200)):
        pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        x = np.sort(rng.choice(pool, n, replace=False))
        y = np.sort(np.union1d(x[extra // 8 :], rng.choice(pool, extra, replace=False)))
        least, true = jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(y)), len(np.setxor1d(x, y))
        assert 0.6 * true <= least <= true and (true - least) % 2 == 0


def test_jaccard_variants_of_one_text(frame):
    """A star of variants that link through some of each other only."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(120)] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(x) for x in jaccard.link(frame(rows, DOC), 4, 85).collect())
    assert got == brute.jaccard_components(rows, 4, 85)


def test_line_dedup(frame):
    rows = corpus(2)
    distinct = list(dict.fromkeys(rows))
    gone = brute.repeated_runs(distinct, 50)
    for r in line_dedup.dedup_lines(frame(distinct, DOC)).collect():
        i = next(k for k, (d, _) in enumerate(distinct) if d == r["doc_id"])
        before = (distinct[i][1] or "").split("\n")
        kept = [x for k, x in enumerate(before) if k not in gone.get(i, ())]
        left = Counter(x for x in (r["text"] or "").split("\n") if x.strip())
        assert not left - Counter(kept), "a repeated line is still there"
    lines = lambda rs: {x.strip() for _, t in rs for x in (t or "").split("\n")}
    after = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame(distinct, DOC)).collect()]
    assert lines(after) | {""} == lines(distinct) | {""}, "every line stays somewhere"
    twice = line_dedup.dedup_lines(frame([rows[0], rows[0]], DOC)).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


def test_decontamination(frame):
    rows = corpus(3)
    items = [(1, rows[0][1]), (2, "Only three WORDS"), (3, None), (4, ""), (1, rows[0][1]), (None, rows[4][1])]
    bench = frame(items, "item_id bigint, text string")
    for block_bytes in (1 << 20, 64):
        got = decontaminate.find_passages(frame(rows, DOC), bench, block_bytes=block_bytes)
        for r in got.withColumn("hit", decontaminate.n_hit()).collect():
            assert (r["n_words"], r["hit"], set(r["items"])) == brute.contaminated(r["text"], items)
    clean = decontaminate.clean(frame(rows, DOC).withColumn("spans", F.lit(1)), bench, max_coverage=0.0)
    assert clean.columns == ["doc_id", "text", "spans"]
    assert all(brute.contaminated(r["text"], items)[1] == 0 for r in clean.collect())
    assert decontaminate.cut_spans("a b, c d", [(1, 3)]) == "a  d"
    assert decontaminate.find_passages(frame([], DOC), frame([], "item_id bigint, text string")).count() == 0


def test_packing(spark, frame):
    rows = [(i, t) for i, t in dict(corpus(4)).items()] + [(900, "word " * 5000), (901, "x" * 3000), (902, "<|endoftext|> a")]
    pieces = [r.asDict() for r in packing.pack(frame(rows, DOC), vocabulary(), group_docs=16).collect()]
    plain = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*plain(t or ""), 0]) for d, t in rows}
    padding = brute.check_packing(pieces, ids)
    assert padding <= 0.01 * sum(map(len, ids.values()))
    fast = packing.encoder(vocabulary())
    for _, text in rows:
        assert packing.encode_whole(fast, text or "", chunk=50).tolist() == [*plain(text or ""), 0]
    assert packing.pack(frame([], DOC), vocabulary()).count() == 0
    assert packing.pack(frame([(None, None), (None, None)], DOC), vocabulary()).count() == 2


def test_sharding(frame):
    rows = [(i, f"t{i}") for i in range(300)] + [(1000 + i, f"g{i // 4}") for i in range(80)] + [(2000 + i, "hot") for i in range(200)]
    rows += [(5000, None), (5001, "")]
    got = sharding.shard_documents(frame(rows, DOC), 6).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert {len(v) for v in by.values()} <= {len(rows) // 6, len(rows) // 6 + 1} and len(by) == 6
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(rows)
    places = defaultdict(set)
    for r in got:
        places[text[r["doc_id"]]].add(r["shard"])
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")
    assert all(len(s) == 1 for t, s in places.items() if t != "hot") and len(places["hot"]) <= 3
    assert sharding.shard_documents(frame([], DOC)).count() == 0


def test_resampling_keeps_target_text_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    got, _, _ = importance.resample(docs, labels.filter("doc_id % 2 = 0"), good)
    held = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("selected").cast("int")).alias("kept"))
    share = {(r["quality"], r["toxic"]): r["kept"] for r in held.collect()}
    assert share[1, 0] > 0.96 and share[0, 0] < 0.05 and share[1, 1] < 0.35


def test_resampling_odd_rows(frame):
    labels = frame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = [(1, "a b"), (2, "c"), (3, None), (4, " "), (1, "a b")]
    got = importance.resample(frame(rows, DOC), labels, good)[0].collect()
    assert len(got) == 5 and not any(r["selected"] for r in got if r["doc_id"] in (3, 4))
    top = importance.resample(frame([(i, f"w{i} x") for i in range(50)], DOC), labels, good, k=7)[0]
    assert top.filter("selected").count() == 7
    assert importance.keep(frame([], DOC), labels, good).count() == 0


def test_kth_largest(spark):
    values = spark.range(5000).select(F.expr("cast(pmod(xxhash64(id), 1000) as double) / 7").alias("v"))
    ordered = sorted((r["v"] for r in values.collect()), reverse=True)
    for k in (1, 17, 2500, 5000):
        assert importance.kth_largest(values, "v", k, buckets=8, most=20) == ordered[k - 1]


def test_fingerprints(spark, frame):
    rows = frame([(1, "a\nb. c"), (2, "c\nb.\na"), (3, "a\nb."), (4, "c"), (5, None), (6, "")], DOC)
    v = {r["doc_id"]: r["v"] for r in rows.select("doc_id", fingerprint.vector(F.col("text")).alias("v")).collect()}
    assert v[1] == v[2] != v[3] and v[5] == v[6] == [0] * len(v[1])
    pair = spark.createDataFrame([(v[3], v[4], v[1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = pair.select(fingerprint.combine(F.col("a"), F.col("b")), fingerprint.combine(F.col("c"), F.col("b"), -1)).first()
    assert r[0] == v[1] and r[1] == v[3]
    assert fingerprint.edit_probe(frame([], DOC)).count() == 0
    alone = fingerprint.edit_probe(frame([(None, "abcdefgh")], DOC)).first()
    assert (alone["n_chars"], alone["near_next"]) == (8, 1.0)


def test_fingerprint_blocks_do_not_matter(frame):
    rows = frame(list(dict(corpus(6)).items()), DOC)
    one = sorted(map(tuple, fingerprint.edit_probe(rows).collect()))
    assert one == sorted(map(tuple, fingerprint.edit_probe(rows, rows_per_block=7).collect()))


def test_url_rules(frame):
    urls = ["http://example.com/en/1", "https://www.example.com/en/", "http://a.EXAMPLE.com/de/?x", "x://b.net/es/1", "y://b.net/en/", None, "no"]
    rows = frame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_trust.judge(rows, RULES, rounds=3).collect()}
    assert got[0] == ("example.com/en/", "block") and got[1] == ("www.example.com/en/", "allow") and got[2] == ("com/", "allow")
    assert got[3] == ("net/es/", "block") and got[4] == (None, "block") and got[5] == got[6] == (None, "allow")
    assert url_trust.judge(rows.limit(0), RULES, rounds=1).count() == 0


def test_links_carry_distrust(frame):
    pages = [(1, "http://bad.net/es/x", ""), (2, "http://friend.org/a", '<a href="http://bad.net/es/y">'), (3, "http://far.org/a", '<a href="/in">')]
    got = {r["page_id"]: r["verdict"] for r in url_trust.judge(frame(pages, "page_id bigint, url string, html string"), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_loser_tree_sorts():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(r.choices(range(50), k=r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_warc_round_trip(frame):
    body = "é" * 60 + "\r\n\r\nWARC/1.0\r\nContent-Length: 3"
    pages = [(3, "http://b.org/x", body), (1, "http://a.org/", body), (2, None, None), (4, "http://b.org/x", "short"), (5, "u\r\nv", "short"), (None, "q", body)]
    df = frame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in warc.merge_index(warc.captures(df).drop("position", "url_key"), rows_per_part=2).collect()}
    assert all(r["intact"] for r in got.values()) and sorted(r["position"] for r in got.values()) == list(range(6))
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload_bytes"]) == ("revisit", 1, len(body.encode()))
    assert got[1]["record_type"] == got[4]["record_type"] == got[5]["record_type"] == "response" and got[2]["payload_bytes"] == 0
    assert got[None]["refers_to"] == 1
    assert warc.captures(frame([], "page_id bigint, url string, html string")).count() == 0


def test_chat_parts_make_the_whole(frame):
    rows = [(1, t, ("user", "assistant", None)[t % 3], f"m{t} <|im_end|>") for t in range(200)]
    rows += [(2, None, "user", None), (2, 0, "system", "s"), (3, 0, "system", "alone"), (1, 5, "user", "again"), (1, 5, "user", "again")]
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.rotate(df, part_turns=16, slice_rows=8).orderBy("conv_id", "perspective", "part", "slice").collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "user"), (1, "assistant"), (1, "unknown"), (2, "user")}
    at = Counter()
    for r in got:
        key = (r["conv_id"], r["perspective"])
        assert r["start_char"] == at[key] and r["n_chars"] == len(r["text"])
        at[key] += len(r["text"])
        for m in r["mask"]:
            assert r["text"][m["start"] : m["end"]].endswith(chat.END) and r["text"][: m["start"]].endswith("assistant\n")
        assert r["text"].count("<|im_start|>assistant\n") == len(r["mask"])
    assert sum(r["n_messages"] for r in got if r["perspective"] == "user") == 204
    assert chat.rotate(df.limit(0)).count() == 0
