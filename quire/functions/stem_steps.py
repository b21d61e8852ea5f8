"""English stemming of a whole vocabulary: each rule of the algorithm is one step over a table of words.

The same published algorithm as ``stem``, in column expressions only. A corpus
has few distinct words beside its text, so the steps run once a word, and the
stems are joined back to postings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.stem import AFTER_PLURAL, DOUBLES, STEP2, STEP3, STEP4, WHOLE

VOWEL = "[aeiouy]"
#: The part of a word up to its first suffix region; three beginnings have their own.
FIRST_REGION = r"\A(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])"
SECOND_REGION = r"\A.*?[aeiouy][^aeiouy]"
SHORT_END = r"(?:(?:\A|[^aeiouy])[aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\z"


def longest_of(suffixes: Iterable[str]) -> str:
    """Pattern of the longest of ``suffixes`` that ends a word: the leftmost match is the longest."""
    return f"(?:{'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})\\z"


def _end(w: Column, suffixes: Iterable[str]) -> Column:
    return F.regexp_extract(w, longest_of(suffixes), 0)


def _without(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.char_length(w) - n)


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def _plural(w: Column) -> Column:
    end, size = _end(w, ("sses", "ied", "ies", "us", "ss", "s")), F.char_length(w)
    return (
        F.when(end == "sses", _without(w, 2))
        .when(end.isin("ied", "ies"), F.when(size > 4, _without(w, 2)).otherwise(_without(w, 1)))
        .when((end == "s") & _without(w, 2).rlike(VOWEL), _without(w, 1))
        .otherwise(w)
    )


def _past(w: Column, r1: Column) -> Column:
    end = _end(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = _without(w, F.char_length(end))
    mended = (
        F.when(base.rlike(r"(?:at|bl|iz)\z"), F.concat(base, F.lit("e")))
        .when(base.rlike(longest_of(DOUBLES)), _without(base, 1))
        .when((r1 >= F.char_length(base)) & base.rlike(SHORT_END), F.concat(base, F.lit("e")))
        .otherwise(base)
    )
    return (
        F.when(end.isin("eed", "eedly"), F.when(F.char_length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w))
        .when((end != "") & base.rlike(VOWEL), mended)
        .otherwise(w)
    )


def _last_y(w: Column) -> Column:
    return F.when(w.rlike(r".[^aeiouy][yY]\z"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)


def _derived(w: Column, r1: Column) -> Column:
    end = _end(w, STEP2)
    base = _without(w, F.char_length(end))
    allowed = F.when(end == "ogi", base.endswith("l")).when(end == "li", base.rlike(r"[cdeghkmnrt]\z")).otherwise(True)
    return F.when((end != "") & (F.char_length(base) >= r1) & allowed, F.concat(base, _map(STEP2, end))).otherwise(w)


def _derived_further(w: Column, r1: Column, r2: Column) -> Column:
    end = _end(w, STEP3)
    at = F.char_length(w) - F.char_length(end)
    inside = (end != "") & (at >= r1) & ((end != "ative") | (at >= r2))
    return F.when(inside, F.concat(_without(w, F.char_length(end)), _map(STEP3, end))).otherwise(w)


def _residual(w: Column, r2: Column) -> Column:
    end = _end(w, STEP4)
    base = _without(w, F.char_length(end))
    inside = (end != "") & (F.char_length(base) >= r2) & ((end != "ion") | base.rlike(r"[st]\z"))
    return F.when(inside, base).otherwise(w)


def _final(w: Column, r1: Column, r2: Column) -> Column:
    base, at = _without(w, 1), F.char_length(w) - 1
    silent = (at >= r2) | ((at >= r1) & ~base.rlike(SHORT_END))
    return F.when(w.endswith("e"), F.when(silent, base).otherwise(w)).when(w.endswith("ll") & (at >= r2), base).otherwise(w)


def stems(vocabulary: DataFrame, word: str = "term") -> DataFrame:
    """(``word``, stem) of each row of ``vocabulary``, whose words are in lower case; null and short words stay.

    Every step reads the column that the one before it wrote, so the plan is one narrow
    projection a step, without Python.
    """
    w, r1, r2 = F.col("w"), F.col("r1"), F.col("r2")
    size = F.char_length(w)
    whole = _map(WHOLE, F.col(word))
    left = vocabulary.select(word, F.when(F.char_length(word) <= 2, F.col(word)).otherwise(whole).alias("fixed"))
    # y is a consonant at the start and after a vowel
    left = left.withColumn("w", F.regexp_replace(word, r"\Ay|(?<=[aeiouy])y", "Y"))
    first = F.char_length(F.regexp_extract(w, FIRST_REGION, 0))
    left = left.withColumn("r1", F.when(first > 0, first).otherwise(size))
    second = F.char_length(F.regexp_extract(F.substring(w, r1 + 1, size), SECOND_REGION, 0))
    left = left.withColumn("r2", F.when(second > 0, r1 + second).otherwise(size))
    left = left.withColumn("w", _plural(w))
    left = left.withColumn("fixed", F.coalesce("fixed", F.when(w.isin(*AFTER_PLURAL), w)))
    steps = (_past(w, r1), _last_y(w), _derived(w, r1), _derived_further(w, r1, r2), _residual(w, r2), _final(w, r1, r2))
    for step in steps:
        left = left.withColumn("w", step)
    return left.select(word, F.coalesce("fixed", F.replace("w", F.lit("Y"), F.lit("y"))).alias("stem"))
