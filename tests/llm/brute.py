"""Plain versions of the operators, one row after the other, to hold results against."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict


def repeated_runs(rows: list[tuple], least: int) -> dict[int, set[int]]:
    """By row number: lines inside a run of ``least`` words that occurred before, in order of id and place."""
    docs = []
    for r, (doc_id, text) in enumerate(rows):
        lines = [(i, x.strip(" ")) for i, x in enumerate((text or "").split("\n")) if x.split()]
        docs.append((doc_id, r, lines))
    seen: set[tuple[str, ...]] = set()
    gone: dict[int, set[int]] = defaultdict(set)
    for _, r, lines in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for start in range(len(lines)):
            words, end = 0, start
            while end < len(lines) and words < least:
                words += len(lines[end][1].split())
                end += 1
            if words < least:
                break
            run = tuple(x for _, x in lines[start:end])
            if run in seen:
                gone[r] |= {i for i, _ in lines[start:end]}
            seen.add(run)
    return gone


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard_components(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(text, width) for _, text in rows]
    at = list(range(len(rows)))

    def root(x: int) -> int:
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                at[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = doc_id if r not in least else min(least[r], doc_id)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def contaminated(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, int, set[str]]:
    """Words, hit words and names of the items that have a window there."""

    def words(t: str | None) -> list[str]:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    said, hit, names = words(text), set(), set()
    for name, item in items:
        item = words(item)
        n = min(window, len(item))
        for w in {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set():
            for i in range(len(said) - n + 1):
                if tuple(said[i : i + n]) == w:
                    hit |= set(range(i, i + n))
                    names.add("" if name is None else str(name))
    return len(said), len(hit), names


def check_packing(pieces: list[dict], ids: dict, length: int = 1024, segments: int = 64) -> int:
    """Assert that ``pieces`` hold every id of ``ids`` (doc_id to array) once and sequences keep the limits; padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc_id])
            assert p["ids_crc32"] == zlib.crc32(ids[doc_id][at : at + p["length"]].astype("<u4").tobytes())
            at += p["length"]
        assert at == len(ids[doc_id])
    padding = 0
    for own in by_sequence.values():
        at = 0
        assert len(own) <= segments
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding
