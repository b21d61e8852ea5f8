"""Sequence packing: documents cut into pieces and placed by a dot-product rule under several limits."""

from __future__ import annotations

import base64
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LENGTH = 1024
#: Tokens, segments and loss-bearing tokens that a sequence may hold. The first
#: id of a piece is predicted from nothing and bears no loss.
LIMITS = (LENGTH, 64, LENGTH)
END_ID = 0
GROUP_DOCS = 1024
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_DEALT = "bucket bigint, doc_id bigint, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary"
#: Before an ASCII blank that follows a visible ASCII character no token of the vocabulary's split pattern runs on.
_CUT = re.compile(r"(?<=[!-~])[ \n]")


def encoder(path: str):
    """The byte-level BPE of a vocabulary file, loaded once a process.

    ``path`` is a ``.json`` of the tokenizers library, or the same vocabulary
    as ranks (``.tiktoken``), which gives the same ids about three times as fast.
    """
    cache = sys.modules.setdefault("_quire_encoders", types.ModuleType("_quire_encoders")).__dict__
    if path not in cache:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.encode_special_tokens = True
            cache[path] = lambda text: plain.encode(text, add_special_tokens=False).ids
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            cache[path] = encoding.encode_ordinary
    return cache[path]


def encode_whole(encode, text: str, chunk: int = 1 << 18) -> np.ndarray:
    """Ids of the whole text and the end id; a very long text goes through in chunks cut where tokens end."""
    parts, at = [], 0
    while len(text) - at > chunk:
        cut = _CUT.search(text, at + chunk)
        if cut is None:
            break
        parts.append(np.array(encode(text[at : cut.start()]), dtype="<u4"))
        at = cut.start()
    parts.append(np.array([*encode(text[at:]), END_ID], dtype="<u4"))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _spread(doc_id: int | None, start: int, buckets: int) -> int:
    return zlib.crc32(f"{doc_id}:{start}".encode()) % buckets


def place(demand: np.ndarray, limits: tuple[int, ...] = LIMITS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) from ``demand``: a row (tokens, segments, loss) for each item.

    Items go to the open sequence one after another: of those that fit all its
    limits, the one with the greatest dot product of its demand and the room
    left, both in units of the limits. When none fits but tokens and a segment are
    free, the best of them is cut to fill the rest. What remains for the last
    sequence is cut at powers of two, which need no padding.
    """
    demand = demand.astype(np.int64).copy()
    limit = np.array(limits, dtype=np.int64)
    begun = np.zeros(len(demand), dtype=np.int64)
    alive = np.ones(len(demand), dtype=bool)
    done: list[list[tuple[int, int, int]]] = []
    while alive.any():
        room, now = limit.copy(), []
        while alive.any():
            score = (demand / limit) @ (room / limit)
            fits = alive & (demand <= room).all(axis=1)
            if fits.any():
                best = int(np.argmax(np.where(fits, score, -1.0)))
                now.append((best, int(begun[best]), int(demand[best, 0])))
                room -= demand[best]
                alive[best] = False
                continue
            free = min(int(room[0]), int(room[2]) + 1)
            if free < 1 or room[1] < 1:
                break
            best = int(np.argmax(np.where(alive & (demand[:, 0] > free), score, -1.0)))
            if not alive[best] or demand[best, 0] <= free:
                break
            now.append((best, int(begun[best]), free))
            begun[best] += free
            demand[best, 0] -= free
            demand[best, 2] = demand[best, 0] - 1
            room -= (free, 1, free - 1)
        done.append(now)
    last = done.pop() if done else []
    used = sum(n for _, _, n in last)
    while used:
        size = limits[0] if used >= limits[0] else 1 << (used.bit_length() - 1)
        now, need = [], size
        while need:
            item, start, n = last.pop(0)
            now.append((item, start, min(n, need)))
            if n > need:
                last.insert(0, (item, start + need, n - need))
            need -= min(n, need)
        done.append(now)
        used -= size
    return done


def pack(
    docs: DataFrame, vocabulary: str, text: str = "text", limits: tuple[int, int, int] = LIMITS, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence.

    Every full slice of a document's ids is a sequence of its own. The
    remainders are dealt by hash into buckets of about ``group_docs`` documents
    and packed there, so the work of a task is bounded; a bucket leaves no
    padding unless the segment limit closes a sequence early. A null text is
    empty (the end id alone); repeated rows are packed each for itself. Given
    the same rows the result is the same, whatever tasks are run again.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))
    buckets = max(1, -(-rows.count() // group_docs))
    full = limits[0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode_whole(encode, value or "")
                total = len(ids)
                for start in range(0, total - total % full, full):
                    crc = zlib.crc32(ids[start : start + full].tobytes())
                    out.append((_spread(doc_id, start, buckets), doc_id, start, full, crc, total, None))
                if (start := total - total % full) < total:
                    out.append((_spread(doc_id, start, buckets), doc_id, start, total - start, None, total, ids[start:].tobytes()))
            if out:
                yield _batch(out, _DEALT)

    def settle(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[6] or b""))
        if not rows:
            return pa.Table.from_batches([_batch([], PIECE)])
        sequence, out = rows[0][0] << 32, []
        for _, doc_id, start, length, crc, total, ids in rows:
            if ids is None:
                out.append((doc_id, start, length, crc, total, sequence, 0))
                sequence += 1
        tails = [r for r in rows if r[6] is not None]
        ids = [np.frombuffer(r[6], dtype="<u4") for r in tails]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        for chosen in place(np.stack([sizes, np.ones_like(sizes), sizes - 1], axis=1), limits) if tails else []:
            offset = 0
            for item, start, n in chosen:
                r = tails[item]
                out.append((r[1], r[2] + start, n, zlib.crc32(ids[item][start : start + n].tobytes()), r[5], sequence, offset))
                offset += n
            sequence += 1
        return pa.Table.from_batches([_batch(out, PIECE)])

    return rows.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(settle, PIECE)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    kinds = [pa.binary() if kind == "binary" else pa.int64() for _, kind in fields]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [name for name, _ in fields])
