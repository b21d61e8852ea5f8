"""Spelling variants by a reduced alphabet: letters hashed to a few symbols, one-edit neighbourhoods joined, originals verified.

If two words are one edit apart, so are their reduced forms, or these are
equal. The neighbourhood of a reduced word has a few dozen members whatever
the script, and finds all its partners by equality joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Store, ascii_lower

#: Lower-case runs of letters, Latin-1 included.
RUN = "[a-z\\u00C0-\\u00FF]+"
SYMBOLS = 8
DROP_EVERY, LEAST_LENGTH, LEAST_TIMES, RATIO = 199, 6, 5, 5
#: Numbers of a neighbourhood's names that are made at once.
_AT_ONCE = 1 << 21
_BASE = np.uint64(0xD1342543DE82EF95)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): how often each word of at least ``least_length`` code points occurs in all of ``docs``.

    A run of letters loses one code point where ``drop_every`` divides the unsigned crc32 of ``<doc_id>:<run>``
    (a null doc_id is written as nothing). Null texts have no runs; repeated rows count each.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    rows = rows.filter(F.char_length("w") >= least_length)
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = F.pmod("h", F.char_length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    word = F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("w"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.char_length("word") >= least_length)


def symbols_of(word: str, symbols: int = SYMBOLS) -> np.ndarray:
    """The reduced word: each letter as the symbol, from 1, that its code point hashes to, its remainder."""
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) % np.uint64(symbols) + np.uint64(1)


def _powers(length: int) -> tuple[np.ndarray, np.uint64]:
    base = np.full(length + 1, _BASE, np.uint64)
    base[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.uint64(pow(int(_BASE), -1, 1 << 64))


def _named(sums: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of reduced words from their sums of symbol times power of place."""
    x = (sums + np.uint64(length * 0xA0761D6478BD642F % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def names_of(reduced: np.ndarray) -> np.ndarray:
    """Names of reduced words of one length, a row each."""
    length = reduced.shape[1]
    return _named((reduced * _powers(length)[0][:length]).sum(axis=1, dtype=np.uint64), length)


def neighbourhood(reduced: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of the distinct words at most one edit from each row's that are not greater, by length, then in order.

    This is the whole one-edit neighbourhood in effect: what is greater has the word in
    its own, so that a join on it meets each pair once instead of twice. That leaves the
    word itself, all deletions and the replacements by smaller symbols; insertions are longer.
    Each name follows from the word's sums in one step, however long the word is.
    """
    n, length = reduced.shape
    powers, inverse = _powers(length)
    parts = reduced * powers[:length]
    upto = np.cumsum(parts, axis=1, dtype=np.uint64)
    whole = upto[:, -1:]
    own = np.arange(n)
    rows, found = [own], [_named(whole[:, 0], length)]
    gone = upto - parts + (whole - upto) * inverse
    new = np.ones((n, length), bool)
    new[:, 1:] = reduced[:, 1:] != reduced[:, :-1]  # deleting either of two equal neighbours gives the same
    rows.append(np.nonzero(new)[0])
    found.append(_named(gone[new], length - 1))
    for symbol in range(1, symbols):
        swapped = whole + (np.uint64(symbol) - reduced) * powers[:length]
        lower = reduced > symbol
        rows.append(np.nonzero(lower)[0])
        found.append(_named(swapped[lower], length))
    return np.concatenate(rows), np.concatenate(found)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers and reduced forms of words of equal length, so many that their neighbourhoods stay small."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    for length, rows in groups.items():
        step = max(1, _AT_ONCE // (length * symbols))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, np.stack([symbols_of(words[i], symbols) for i in some])


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different strings differ by one inserted, deleted or replaced code point.

    Long strings are compared behind their common prefix, which is found by halving: the
    edit distance takes time quadratic in their length.
    """
    size_a, size_b = F.char_length(a), F.char_length(b)
    steps = F.lit([1 << i for i in reversed(range(30))])
    same = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    shorter = F.least(size_a, size_b)
    prefix = F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step <= shorter) & same(p + step), p + step).otherwise(p))
    rest = lambda c, n, other, p: F.substring(c, p + 1 + (n >= other).cast("int"), n)
    behind = F.transform(F.array(prefix), lambda p: rest(a, size_a, size_b, p) == rest(b, size_b, size_a, p))[0]
    close = F.abs(size_a - size_b) <= 1
    return close & F.when(shorter <= 64, F.levenshtein(a, b, 1) == 1).otherwise(behind)


def near_pairs(words: DataFrame, store: Store, symbols: int = SYMBOLS) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of ``words`` (word, n), once each, that one edit of a code point turns into each other.

    Reduced words are made distinct before their neighbourhoods are generated and
    joined with the reduced vocabulary; only then do words come in, and a pair
    leaves the join only if the original strings are one edit apart.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(0).to_pylist()
            names = np.zeros(len(said), np.int64)
            for rows, reduced in _by_length(said, symbols):
                names[rows] = names_of(reduced)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], ["word", "n", "r"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for rows, reduced in _by_length(batch.column(1).to_pylist(), symbols):
                at, names = neighbourhood(reduced, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(own[rows][at]), pa.array(names)], ["r", "s"])

    coded = store.save(words.select("word", "n").mapInArrow(code, "word string, n bigint, r bigint"), "coded")
    kinds = store.save(coded.groupBy("r").agg(F.min("word").alias("word")), "kinds")
    known = kinds.select(F.col("r").alias("s"))
    close = store.save(kinds.mapInArrow(reach, "r bigint, s bigint").join(known, "s"), "close")
    left = coded.select("r", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = coded.select(F.col("r").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    mine = close.join(left, "r")
    once = (F.col("r") != F.col("s")) | (F.col("a") < F.col("b"))
    return mine.join(right, (F.col("s") == F.col("other")) & once & one_edit(F.col("a"), F.col("b"))).select("a", "a_n", "b", "b_n")


def variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, ratio: int = RATIO,
    drop_every: int = DROP_EVERY, symbols: int = SYMBOLS, store: Store | None = None,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``least_times`` occurrences.

    ``form`` is the most frequent near word (the smallest in code-point order on
    ties), if it is ``ratio`` times as frequent; ``root`` is where forms lead in the
    end. Forms grow by ``ratio`` at each step, so chains are short and end; they
    are followed by pointer doubling. Columns of ``docs`` besides doc_id and text are not
    read, and an empty table has no words.
    """
    store = store or Store(docs.sparkSession, "spelling")
    words = store.save(word_counts(docs, least_length, drop_every).filter(F.col("n") >= least_times), "words")
    pairs = store.save(near_pairs(words, store, symbols), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    joined = words.join(best, "word", "left")
    strong = -F.col("top.less") >= ratio * F.col("n")
    named = joined.select(
        "word", F.when(strong, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("top.less")).alias("form_n"),
    )
    named = store.save(named, "named")
    steps = store.save(named.filter("form is not null").select("word", F.col("form").alias("root")), "steps")
    turn = 0
    while True:
        turn += 1
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = store.save(steps.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), "last"), f"steps{turn}")
        steps = moved.select("word", "root")
        if moved.filter("last is not null").isEmpty():
            break
    ended = named.join(steps, "word", "left")
    return ended.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
