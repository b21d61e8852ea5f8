"""The pipeline stage by stage, each against a plain version on its own input."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from quire.llm import importance, line_dedup, packing
from quire.llm.common import table
from quire.llm.jobs import good_document
from tests.llm import brute
from tests.llm.test_passages import plain as plain_passages

SF_DIR = "/root/testdata/sf0.001"


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, 11)}, words


def test_stages(spark, tmp_path):
    docs = before = table(spark, SF_DIR, "documents")
    results = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        results.append([r.asDict() for r in docs.collect()])
        assert i == 4 or docs.columns == before.columns
    quality, lines, joined, clean, packed = results

    picked, _, _ = importance.resample(before, table(spark, SF_DIR, "labels"), good_document())
    assert sorted(r["doc_id"] for r in quality) == sorted(r["doc_id"] for r in picked.filter("selected").collect())

    was = {r["doc_id"]: r["text"] or "" for r in quality}
    whole = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/0")).collect()]
    assert {x for _, t in whole for x in t.split("\n") if x.strip()} == {x for t in was.values() for x in t.split("\n") if x.strip()}
    gone = plain_passages(whole, 50)
    left = {d: [w for i, w in enumerate((t or "").split()) if i not in gone[d]] for d, t in whole}
    assert {r["doc_id"]: r["text"].split() for r in lines} == {d: w for d, w in left.items() if w or not (was[d].split())}
    assert not brute.repeated_runs([(r["doc_id"], r["text"]) for r in lines], 50)
    assert all(r["n_chars"] == len(r["text"]) for r in lines if r["text"] != was[r["doc_id"]])

    linked = brute.jaccard_components([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert sorted(r["doc_id"] for r in joined) == [d for d, _, c in linked if d == c]

    items = [windows(r["text"])[1] for r in table(spark, SF_DIR, "benchmark").collect()]
    bad = {(min(10, len(w)), tuple(w[i : i + 10])) for w in items if w for i in range(max(1, len(w) - 9))}
    hit = {r["doc_id"] for r in joined for seen in [windows(r["text"])[0]] if any(w in seen[n] for n, w in bad)}
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in joined if r["doc_id"] not in hit)

    plain = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert brute.check_packing(packed, {r["doc_id"]: np.array([*plain(r["text"] or ""), 0]) for r in clean}) == 0
