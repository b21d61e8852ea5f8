"""Repeated runs of lines: winnowed fingerprints, joined positions, matches grown both ways.

A window is the shortest run of lines from some line on that holds at least
``least`` words. Its minimum (most words, then lowest hash) is a fingerprint
position. Whatever run of ``least`` words two documents share, they share its
windows and so the windows' minima: no such run goes without a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, fresh, row_key

LEAST = 50


def _profile(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): number, hash and word count of each line that is not blank."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("line")))
    lines = F.transform(
        split,
        lambda x: F.struct(
            x["no"].alias("no"), F.unhex(F.md5(x["line"])).alias("h"), F.regexp_count(x["line"], F.lit(r"\S+")).alias("w")
        ),
    )
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
    rows = rows.filter(F.size("lines") > 0)
    repeats = rows.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"))
    return repeats.select(
        "k", "doc_id", F.col("lines.no").alias("no"), F.col("lines.h").alias("hs"), F.col("lines.w").alias("ws"),
    )


def _windows(profile: DataFrame, least: int) -> DataFrame:
    """(k, doc_id, start, n, anchor, fingerprint, content): every window with its minimum and a hash of all its lines."""
    lines = profile.select("k", "doc_id", F.posexplode(F.arrays_zip("hs", "ws")).alias("i", "line"))
    lines = lines.select("k", "doc_id", "i", F.col("line.hs").alias("h"), F.col("line.ws").alias("w"))
    so_far = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("w").over(so_far), F.lit(0)))
    ahead = Window.partitionBy("k").orderBy("before").rangeBetween(0, least - 1)
    seen = lines.select(
        "k", "doc_id", F.col("i").alias("start"),
        F.min(F.struct((-F.col("w")).alias("w"), "h", "i")).over(ahead).alias("low"),
        F.sum("w").over(ahead).alias("words"), F.count("*").over(ahead).alias("n"),
        F.collect_list("h").over(ahead).alias("all"),
    ).filter(F.col("words") >= least)
    content = F.unhex(F.md5(F.aggregate("all", F.lit("").cast("binary"), lambda s, h: F.concat(s, h))))
    return seen.select(
        "k", "doc_id", "start", "n", F.col("low.i").alias("anchor"), F.col("low.h").alias("fingerprint"), content.alias("content"),
    )


def _first_places(places: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first): the first place, by document and position, of every key that occurs more than once."""
    first = F.min(F.struct("doc_id", "k", F.col(at).alias("at"))).alias("first")
    return places.groupBy(key).agg(first, F.count("*").alias("times")).filter("times > 1").drop("times")


def _alignments(places: DataFrame, firsts: DataFrame, key: str, at: str) -> DataFrame:
    """(k, other, shift): line i of ``k`` lies beside line i - shift of the earlier document ``other``."""
    met = places.join(firsts, key).select(
        "k", F.col("first.k").alias("other"), (F.col(at) - F.col("first.at")).alias("shift"),
    )
    return met.filter("not (k = other and shift = 0)").distinct()


def _grow(alignments: DataFrame, profile: DataFrame, least: int) -> DataFrame:
    """(k, i): lines of maximal equal runs of at least ``least`` words under some alignment."""
    mine = profile.select("k", "hs", "ws")
    theirs = profile.select(F.col("k").alias("other"), F.col("hs").alias("their_hs"))
    beside = alignments.join(mine, "k").join(theirs, "other")
    low = F.greatest(F.lit(0), F.col("shift"))
    high = F.least(F.size("hs"), F.size("their_hs") + F.col("shift")) - 1
    spots = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(spots, lambda i: F.get("hs", i) == F.get("their_hs", i - F.col("shift")))
    rows = beside.select("k", "other", "shift", "ws", F.posexplode(equal).alias("rank", "i"))
    rows = rows.select("k", "other", "shift", "i", (F.col("i") - F.col("rank")).alias("run"), F.get("ws", F.col("i")).alias("w"))
    runs = Window.partitionBy("k", "other", "shift", "run")
    return rows.withColumn("words", F.sum("w").over(runs)).filter(F.col("words") >= least).select("k", "i").distinct()


def repeated_lines(docs: DataFrame, least: int = LEAST, store: Store | None = None) -> DataFrame:
    """(k, removed): numbers of the lines to delete, for the documents that lose any.

    Documents are in order of doc_id (nulls first), then row key. Fingerprint positions are
    joined with the first position of the same fingerprint, and the match is
    grown both ways as far as the lines agree; runs of ``least`` words and more
    are deleted from the later place. A window with lines that this leaves,
    because its minimum first stood in some other run, is joined a second
    time by the hash of its whole content. So every run of ``least`` words that
    occurred before goes, and the first occurrence of every line stays: a line
    is only deleted beside an equal one earlier in the order.
    """
    store = store or Store(docs.sparkSession, "line-dedup")
    profile = store.save(_profile(docs), "profile")
    windows = store.save(_windows(profile, least), "windows")
    anchors = windows.groupBy("k", "anchor").agg(F.first("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"))
    firsts = _first_places(anchors, "fingerprint", "anchor")
    found = store.save(_grow(_alignments(anchors, firsts, "fingerprint", "anchor"), profile, least), "found")

    # Windows that hold a line which is still there, and whose content occurred before.
    repeats = store.save(windows.join(_first_places(windows, "content", "start"), "content"), "repeats")
    store.drop(windows)
    lines = repeats.select("k", "start", F.explode(F.sequence("start", (F.col("start") + F.col("n") - 1).cast("int"))).alias("i"))
    open_windows = lines.join(found, ["k", "i"], "left_anti").select("k", "start").distinct()
    left = repeats.join(open_windows, ["k", "start"], "left_semi").select(
        "k", F.col("first.k").alias("other"), (F.col("start") - F.col("first.at")).alias("shift"),
    )
    more = _grow(left.filter("not (k = other and shift = 0)").distinct(), profile, least)
    gone = found.unionByName(more).distinct().groupBy("k").agg(F.collect_list("i").alias("at"))
    numbers = gone.join(profile.select("k", "no"), "k")
    return numbers.select("k", F.array_sort(F.transform("at", lambda i: F.get("no", i))).alias("removed"))


def dedup_lines(docs: DataFrame, least: int = LEAST, store: Store | None = None) -> DataFrame:
    """``docs`` with the text cut and ``n_lines``, ``n_removed`` appended, as the last two columns.

    A null text stays null with no lines; blank lines are never deleted; rows
    that repeat an id and a text are one document and lose the same lines. Where ``docs`` has a
    column of an appended name, it stays, and underscores are added to the appended one. An empty table stays empty.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), least, store)
    key, removed = fresh(docs, "k", "removed")
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    keyed = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    joined = keyed.join(gone.withColumnsRenamed({"k": key, "removed": removed}), key, "left")
    lines = F.split("text", "\n")
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(removed))
    cut = F.transform(F.array(lines), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))[0]
    return joined.select(
        *[F.when(F.col(removed).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias(n_removed),
    )
