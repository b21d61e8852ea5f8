"""Alignment of two tokenizers over the same bytes: shared token ends by galloping intersection, id links, corpus counts."""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import types
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Store
from quire.llm.packing import encode_whole, encoder

#: UTF-8 bytes of text, and links between tokens, that are worked on at once (one document may hold more bytes).
SLICE_BYTES, SLICE_LINKS = 1 << 19, 1 << 21
#: Most id pairs whose counts are sent to every task, 13 bytes each; rarer pairs are joined.
SENT_PAIRS = 1 << 20
_STRIDE = 16


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending ``short`` the first place in the ascending ``long`` that is not less.

    Every ``_STRIDE``-th value gallops from the place of the one before: steps double until they
    overshoot, then a binary search goes back. The values between gallop from the place of their
    head in the same way, all in step.
    """
    n = len(long)
    heads, at = [], 0
    for value in short[::_STRIDE].tolist():
        step = 1
        while at + step <= n and long[at + step - 1] < value:
            step *= 2
        at = bisect_left(long, value, at + step // 2, min(at + step, n))
        heads.append(at)
    low = np.repeat(np.array(heads, np.int64), _STRIDE)[: len(short)]  # all before ``low`` is less
    high = low.copy()
    open_, step = np.arange(len(short)), 1
    while len(open_):
        ahead = low[open_] + step
        less = ahead <= n
        less[less] = long[ahead[less] - 1] < short[open_[less]]
        high[open_[~less]] = np.minimum(ahead[~less] - 1, n)
        open_, step = open_[less], step * 2
        low[open_] = ahead[less]
    open_ = np.nonzero(low < high)[0]
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b``, both ascending, of the values they share; the shorter list drives."""
    if len(a) > len(b):
        at_b, at_a = shared_ends(b, a)
        return at_a, at_b
    place = gallop(a, b)
    inside = place < len(b)
    hit = np.nonzero(inside)[0][b[place[inside]] == a[inside]]
    return hit, place[hit]


class Tokenizers:
    """The byte-level tokenizer A and the piece tokenizer B of two vocabulary files, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.encode_a = encoder(a_path)
        self.a_bytes = _byte_level(a_path)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # digits and what follows them: in A a comma or, at a group's end, a bar; in B a comma, a semicolon or nothing
        self.written = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.written += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in (",", ";", "")]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Tokenizers:
        """Loaded once a process."""
        cache = sys.modules.setdefault("_quire_aligned", types.ModuleType("_quire_aligned")).__dict__
        if (key := f"{a_path}|{b_path}") not in cache:
            cache[key] = cls(a_path, b_path)
        return cache[key]

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text; none where joined bytes differ from the text with a space before it."""
        none = np.empty(0, np.int64)
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        found = []
        for text, b_ids in zip(texts, b, strict=True):
            whole = f" {text}".encode() if text else b""
            if not text or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
                found.append((none, none))
                continue
            a_ids = encode_whole(self.encode_a, f" {text}")[:-1].astype(np.int64)  # without the end id
            same = b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) == whole
            found.append((a_ids, np.array(b_ids, np.int64)) if same else (none, none))
        return [x for x, _ in found], [x for _, x in found]


def _byte_level(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in lines)}
        return [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    shown = {chr(b): b for b in plain}
    shown |= {chr(0x100 + i): b for i, b in enumerate(x for x in range(0x100) if x not in set(plain))}
    named = {i: bytes(shown[c] for c in entry) for entry, i in entries.items() if all(c in shown for c in entry)}
    return [named.get(i, b"") for i in range(max(entries.values()) + 1)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray, n_b: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, key, times) of the distinct id pairs that share a group, key = a * ``n_b`` + b; a few at a time.

    Groups are given by their sizes ``na`` and ``nb`` and ``doc``. Ids repeated in a group are counted
    first; then come A ids in order of (document, id), so many that their pairs are at most ``most``, or one,
    whose pairs are at most the document's tokens.
    """
    group = np.arange(len(na))
    base = int(max(a.max(initial=0), b.max(initial=0))) + 1
    ua, ca = np.unique(np.repeat(group, na) * base + a, return_counts=True)
    ub, cb = np.unique(np.repeat(group, nb) * base + b, return_counts=True)
    first = np.searchsorted(ub, group * base)
    size = np.searchsorted(ub, (group + 1) * base) - first
    g = ua // base
    name = doc[g] * base + ua % base
    order = np.argsort(name, kind="stable")
    ua, ca, g, name = ua[order], ca[order], g[order], name[order]
    edge = np.nonzero(np.concatenate([name[1:] != name[:-1], [True]]))[0] + 1  # ends of the rows of one (document, id)
    held = np.cumsum(size[g])[edge - 1]
    lo = 0
    while lo < len(ua):
        before = held[np.searchsorted(edge, lo, side="right") - 1] if lo else 0
        hi = int(edge[max(np.searchsorted(held, before + most, side="right") - 1, np.searchsorted(edge, lo, side="right"))])
        reps = size[g[lo:hi]]
        inner = np.arange(reps.sum()) - np.repeat(_starts(reps)[:-1], reps) + np.repeat(first[g[lo:hi]], reps)
        key = np.repeat(ua[lo:hi] % base, reps) * n_b + ub[inner] % base
        docs = np.repeat(doc[g[lo:hi]], reps)
        times = np.repeat(ca[lo:hi], reps) * cb[inner]
        way = np.argsort((docs - docs[0]) * (base * n_b) + key, kind="stable")  # documents are a slice's: few enough
        docs, key, times = docs[way], key[way], times[way]
        new = np.nonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])]))[0]
        yield docs[new], key[new], np.add.reduceat(times, new)
        lo = hi


def _slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ALIGNED = "row bigint, part int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys array<bigint>, times array<bigint>"


def _lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int64()))


def align(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES, slice_links: int = SLICE_LINKS) -> DataFrame:
    """One row per row of ``docs`` (part 0): token counts, groups, links, the groups' digest, and its id pairs.

    ``keys`` are the distinct pairs a * (size of B's vocabulary) + b whose byte ranges share a group, ``times`` how
    many links each has; of a document with more than ``slice_links`` pairs they go on in further parts,
    which bear no counts. A text that is null, empty or not restored by both
    tokenizers has no tokens, and '' as its digest.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), "text")
    names = [f.split(" ")[0] for f in _ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.of(a_path, b_path)
        shift = 2 * len(tok.a_bytes)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in _slices(texts, slice_bytes):
                a_lists, b_lists = tok.ids(texts[lo:hi])
                a, b = np.concatenate(a_lists), np.concatenate(b_lists)
                doc_a, doc_b = _starts(np.array([len(x) for x in a_lists])), _starts(np.array([len(x) for x in b_lists]))
                at_a, at_b = shared_ends(np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b]))
                na, nb = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
                doc = np.searchsorted(doc_a, at_a, side="right") - 1
                n = hi - lo
                groups = np.bincount(doc, minlength=n)
                links = np.diff(_starts(na * nb)[_starts(groups)])
                # the digest's text: A's ids of a group, then B's, in one list of written ids
                code = np.empty(len(a) + len(b), np.int64)
                code[np.arange(len(a)) + np.repeat(_starts(nb)[:-1], na)] = 2 * a
                code[np.arange(len(b)) + np.repeat(_starts(na)[1:], nb)] = shift + 3 * b
                code[at_a + _starts(nb)[:-1]] += 1
                code[at_b + _starts(na)[1:]] += 1
                last = np.nonzero(np.diff(doc, append=-1))[0]
                code[at_b[last] + _starts(na)[1:][last]] += 1
                ends = doc_a + doc_b
                digests = [
                    hashlib.sha256("".join(map(tok.written.__getitem__, code[s:e].tolist())).encode()).hexdigest() if e > s else ""
                    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                ]
                zeros, part = np.zeros(n, np.int64), np.zeros(n, np.int32)
                told = [np.diff(doc_a), np.diff(doc_b), groups, links]
                done = 0  # documents before have been written
                for docs_of, key, times in _pairs(a, b, na, nb, doc, len(tok.b_bytes), slice_links):
                    until = int(docs_of[-1]) + 1
                    begin = min(done, int(docs_of[0]))
                    counts = np.bincount(docs_of - begin, minlength=until - begin)
                    here = slice(begin, until)
                    first = part[here] == 0
                    columns = [
                        batch.column(0)[lo + begin : lo + until], pa.array(part[here]), batch.column(1)[lo + begin : lo + until],
                        *[pa.array(np.where(first, x[here], zeros[here])) for x in told],
                        pa.array(digests[begin:until], pa.string()), _lists(key, _starts(counts)), _lists(times, _starts(counts)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    part[here] += 1
                    done = until
                if done < n:
                    empty = _lists(np.empty(0, np.int64), np.zeros(n - done + 1, np.int64))
                    columns = [
                        batch.column(0)[lo + done : hi], pa.array(part[done:]), batch.column(1)[lo + done : hi],
                        *[pa.array(x[done:]) for x in told], pa.array(digests[done:], pa.string()), empty, empty,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(key, n, best): how many documents hold an id pair linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("key") / n_b))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def report(
    docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES, slice_links: int = SLICE_LINKS,
    sent_pairs: int = SENT_PAIRS, store: Store | None = None,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Every row is a document, repeated ones too; a null doc_id stays null. Counts of the most frequent id pairs, at most
    ``sent_pairs`` of them, go to every task; a document's other pairs are joined with the
    count table, so that neither its size nor a frequent pair matters.
    """
    store = store or Store(docs.sparkSession, "alignment")
    n_b = len(Tokenizers.of(a_path, b_path).b_bytes)
    aligned = store.save(align(docs, a_path, b_path, slice_bytes, slice_links), "aligned")
    counts = store.save(pair_counts(aligned, n_b), "counts")
    store.release()
    scale = counts.groupBy(F.floor(F.log2("n")).alias("scale")).count().orderBy(F.desc("scale")).collect()  # 64 rows at most
    floor, sent = 1 << 62, 0
    for r in scale:
        if sent + r["count"] > sent_pairs:
            break
        sent, floor = sent + r["count"], 1 << int(r["scale"])
    hot = counts.filter(F.col("n") >= floor).toArrow().sort_by("key")
    table = docs.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("key", "n", "best")))
    told = ["n_a", "n_b", "n_groups", "n_links"]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            lists = batch.column("keys")
            sizes = np.diff(lists.offsets.to_numpy())
            key, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            place = np.searchsorted(known, key)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == key[hit]
            place = np.where(hit, place, 0)
            ends = _starts(sizes)
            totals = lambda x: np.diff(_starts(x)[ends])
            sums = totals(np.where(hit, times * n[place], 0)) if len(known) else np.zeros(len(sizes), np.int64)
            bests = totals(np.where(hit & best[place], times, 0)) if len(known) else np.zeros(len(sizes), np.int64)
            left = _starts(totals(~hit))
            columns = [*[batch.column(c) for c in ["row", "part", "doc_id", *told, "groups_sha256"]], pa.array(bests), pa.array(sums)]
            columns += [_lists(key[~hit], left), _lists(times[~hit], left)]
            yield pa.RecordBatch.from_arrays(columns, out)

    kinds = ["row bigint", "part int", "doc_id bigint", *[f"{c} bigint" for c in told], "groups_sha256 string"]
    kinds += ["n_best bigint", "count_sum bigint", "keys array<bigint>", "times array<bigint>"]
    out = [k.split(" ")[0] for k in kinds]
    summed = store.save(aligned.mapInArrow(sum_up, ", ".join(kinds)), "summed")
    rare = summed.filter(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", "p.keys", "p.times")
    rare = rare.join(counts.filter(F.col("n") < floor), rare["keys"] == counts["key"])
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    more = rare.unionByName(summed.filter("part > 0").select("row", "n_best", "count_sum"))
    more = more.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    whole = summed.filter("part = 0").join(more, "row", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c)
    return whole.select("doc_id", *told, plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
