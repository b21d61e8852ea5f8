"""Benchmark passages in training text, found by a generalised suffix automaton over test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns, fresh

#: In lower-cased bytes: digits, a-z and everything beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []


class Automaton:
    """All word sequences of the items, with the items that hold each window.

    States are numbered; 0 is the empty sequence. ``step[s]`` maps a word to
    the next state, ``link[s]`` is the state of the longest suffix that occurs
    elsewhere too, ``longest[s]`` the length of the longest sequence in ``s``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [0], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self._name_windows(items)

    def _state(self, longest: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, parent: int, word: bytes, target: int) -> int:
        """A state for the sequences of ``target`` that are one word longer than ``parent``."""
        copy = self._state(self.longest[parent] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while self.step[parent].get(word) == target:
            self.step[parent][word] = copy
            if parent == 0:
                break
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._state(self.longest[last] + 1, {}, 0)
        p = last
        while word not in self.step[p]:
            self.step[p][word] = new
            if p == 0:
                return new
            p = self.link[p]
        target = self.step[p][word]
        self.link[new] = target if self.longest[target] == self.longest[p] + 1 else self._split(p, word, target)
        return new

    def _name_windows(self, items: list[tuple[str, list[bytes]]]) -> None:
        size = len(self.link)
        self.full = [-1] * size  # the state of the last ``window`` words
        self.holders: list[set[str]] = [set() for _ in range(size)]
        self.short: list[tuple[tuple[int, str], ...]] = [()] * size  # whole items below the window, as suffixes
        own: dict[int, set[tuple[int, str]]] = {}
        for name, item in items:
            if 0 < len(item) < self.window:
                state = 0
                for word in item:
                    state = self.step[state][word]
                own.setdefault(state, set()).add((len(item), name))
        for s in sorted(range(1, size), key=self.longest.__getitem__):
            up = self.link[s]
            if self.longest[s] >= self.window:
                self.full[s] = s if self.longest[up] < self.window else self.full[up]
            self.short[s] = self.short[up] + tuple(own.get(s, ()))
        for name, item in items:
            state = 0
            for i, word in enumerate(item):
                state = self.step[state][word]
                if i + 1 >= self.window:
                    self.holders[self.full[state]].add(name)

    def scan(self, text: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans of words inside any window, and the names of the items that have one there."""
        step, link, longest, full, short, window = self.step, self.link, self.longest, self.full, self.short, self.window
        spans: list[list[int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        state = length = 0
        for i, word in enumerate(text):
            after = step[state].get(word)
            while after is None and state:
                state = link[state]
                length = longest[state]
                after = step[state].get(word)
            if after is None:
                continue
            state = after
            length += 1
            reach = 0
            if length >= window:
                reach = window
                seen.add(full[state])
            if short[state]:
                for k, name in short[state]:
                    if k <= length:
                        names.add(name)
                        reach = max(reach, k)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        for s in seen:
            names |= self.holders[s]
        return spans, names


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def find_passages(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, block_bytes: int = 512 * 1024
) -> DataFrame:
    """Append ``n_words``, ``spans`` (merged word ranges inside item windows) and ``items`` (their ids).

    ``items`` has (item_id, text). Its rows are dealt into blocks of about
    ``block_bytes`` of text by hash; every block is an automaton that each task
    builds from the block's own rows, and the documents stream through one
    Arrow pass per block. So whatever the size of the benchmark, the driver and
    a task hold blocks, never the whole of it. Nulls have no words; repeated
    items and items without words change nothing; an item without id is ``""``. A column of ``docs`` that has
    the name of an appended one is renamed, with underscores behind it.
    """
    taken = [c for c in docs.columns if c.lower() in {f.name for f in FOUND}]
    docs = docs.withColumnsRenamed(dict(zip(taken, fresh(docs, *taken), strict=True)))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    marked = docs
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = [(r["id"], words(r["text"].encode())) for r in part.distinct().collect()]
        marked = _pass(marked, rows, text, window, b == 0)
    return marked


def _pass(docs: DataFrame, rows: list[tuple[str, list[bytes]]], text: str, window: int, first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, window)
        for batch in batches:
            before = [[], []] if first else [batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()]
            counts, spans, names = [], [], []
            for i, value in enumerate(_binary(batch, text)):
                said = words(value)
                found, ids = automaton.scan(said)
                if not first:
                    found = merge(found + [[s["start"], s["end"]] for s in before[0][i]])
                    ids |= set(before[1][i])
                counts.append(len(said))
                spans.append([{"start": a, "end": b} for a, b in found])
                names.append(sorted(ids))
            kept = batch.columns if first else batch.columns[:-3]
            labels = batch.schema.names if first else batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(spans, kinds), pa.array(names, pa.list_(pa.string()))],
                [*labels, "n_words", "spans", "items"],
            )

    return add_columns(docs, FOUND, run) if first else docs.mapInArrow(run, docs.schema)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def report(marked: DataFrame) -> DataFrame:
    """Digest of each document's hits: counts, the sorted item ids' SHA-256 and the verdict."""
    return marked.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between those words."""
    raw = text.encode()
    places = [m.span() for m in WORDS.finditer(raw.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, min_span: int = 10, max_coverage: float = 0.2
) -> DataFrame:
    """Documents without benchmark passages, in the columns of ``docs``.

    Spans of at least ``min_span`` words (or that are a whole item) are cut out
    of the text; a document with a greater share of hit words than
    ``max_coverage`` goes altogether. With 0 every hit document goes.
    """
    marked = find_passages(docs, items, text, window)
    plain = marked.columns[: len(docs.columns)]  # the columns of ``docs``, renamed where they clash
    kept = marked.filter((n_hit() == 0) | (n_hit() <= F.col("n_words") * max_coverage))
    if max_coverage > 0:
        shortest = items.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1))).alias("n"))
        least = min(min_span, shortest.filter("n > 0").agg(F.min("n")).first()[0] or min_span)
        fields = kept.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.schema.get_field_index(text)
                values = batch.column(k).to_pylist()
                for i, spans in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                    if long := [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= least]:
                        values[i] = cut_spans(values[i], long)
                columns = list(batch.columns)
                columns[k] = pa.array(values, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        kept = kept.mapInArrow(run, fields)
    return kept.select([F.col(f"`{c}`").alias(own) for c, own in zip(plain, docs.columns, strict=True)])
