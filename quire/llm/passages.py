"""Repeated passages: winnowed words as anchors, joined with first places, matches grown word by word.

Every run of ``least`` words has an anchor: of its first places that half as many
words follow, the one whose word has the lowest hash (the leftmost on ties). The
words from there on are its fingerprint. Two documents that share a run share
its anchor and fingerprint, wherever its lines begin and end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, fresh, range_blocks, ranked, row_key

LEAST = 50
_PLACE = (1 << 31) - 1


def _words(docs: DataFrame, least: int) -> DataFrame:
    """(k, doc_id, n, a, b, hs) of each row: the hash of each word, and two of all words; ``hs`` is null below ``least`` words.

    ``docs`` is (k, doc_id, text). Rows are not filtered here: the filter would cut the text a second time.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")
    rows = docs.select("k", "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("hs"))
    rows = rows.select("k", "doc_id", F.size("hs").alias("n"), F.when(F.size("hs") >= least, F.col("hs")).alias("hs"))
    return rows.select("k", "doc_id", "n", F.xxhash64("hs").alias("a"), F.xxhash64(F.lit(1), "hs").alias("b"), "hs")


def _placed(spots: Column, key: Callable[[Column], Column]) -> Column:
    """Rows (key, at, before) of ``spots``; ``before`` is the last spot before with the same key in the document."""
    keyed = F.sort_array(F.transform(spots, lambda p: F.struct(key(p).alias("key"), p.alias("at"))))

    def earlier(s: Column) -> Column:
        def row(x: Column, j: Column) -> Column:
            last = F.get(s, j - 1)
            return F.struct(x["key"].alias("key"), x["at"].alias("at"), F.when(last["key"] == x["key"], last["at"]).alias("before"))

        return F.transform(s, row)

    return F.explode(F.transform(F.array(keyed), earlier)[0]).alias("p")


def _run(start: Column, n: int) -> Column:
    return F.slice("hs", start + 1, n)


def _number(r: Column, at: Column) -> Column:
    return F.shiftleft(r.cast("long"), 31) + at


def _document(place: Column) -> Column:
    return F.shiftright(place, 31)


def _at(place: Column) -> Column:
    return place.bitwiseAND(F.lit(_PLACE)).cast("int")


def _anchors(profile: DataFrame, least: int) -> DataFrame:
    """(key, place, before): the anchors of all runs of ``least`` words, with their fingerprints."""
    follow = least // 2
    width = least - follow + 1
    spots = F.slice("hs", F.lit(1), F.size("hs") - (follow - 1))
    rows = profile.withColumn("low", F.transform(spots, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)) + i))
    seen = 1
    while seen < width:
        step = min(seen, width - seen)
        left = F.size("low") - step
        rows = rows.withColumn(
            "low", F.zip_with(F.slice("low", F.lit(1), left), F.slice("low", F.lit(1 + step), left), lambda a, b: F.least(a, b))
        )
        seen += step
    rows = rows.withColumn("low", F.array_distinct("low"))
    placed = _placed(F.transform("low", _at), lambda p: F.xxhash64(_run(p, follow)))
    return rows.select("r", placed).select("p.key", _number(F.col("r"), F.col("p.at")).alias("place"), "p.before")


def _repeats(places: DataFrame) -> DataFrame:
    """Places whose key occurs more than once, with the first of them."""
    firsts = places.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("times")).filter("times > 1")
    return places.join(firsts, "key")


def _alignments(repeats: DataFrame) -> DataFrame:
    """(r, other, shifts): word i of document ``r`` lies beside word i - shift of ``other``.

    The first place of a key in a document is laid beside the first one of all, a later
    place beside the one before it, so a text that repeats itself has few alignments.
    """
    alone = F.col("before").isNull()
    laid = repeats.filter(~alone | (F.col("place") != F.col("first"))).select(
        _document(F.col("place")).alias("r"), _document(F.when(alone, F.col("first")).otherwise(F.col("place"))).alias("other"),
        (_at(F.col("place")) - F.when(alone, _at(F.col("first"))).otherwise(F.col("before"))).alias("shift"),
    )
    return laid.groupBy("r", "other").agg(F.collect_set("shift").alias("shifts"))


def _grow(pairs: DataFrame, names: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(r, k, start, stop): maximal runs of at least ``least`` equal words under some alignment."""
    others = names.select(F.col("r").alias("other"), F.col("k").alias("other_k"))
    named = pairs.join(names.select("r", "k"), "r").join(others, "other")
    mine = named.join(words, "k")
    alone = mine.filter("r = other").select("r", "k", "shifts", "hs", F.col("hs").alias("their_hs"))
    theirs = words.select(F.col("k").alias("other_k"), F.col("hs").alias("their_hs"))
    beside = mine.filter("r <> other").join(theirs, "other_k").select("r", "k", "shifts", "hs", "their_hs").unionByName(alone)

    def runs(shift: Column) -> Column:
        low = F.greatest(F.lit(0), shift)
        high = F.least(F.size("hs"), F.size("their_hs") + shift) - 1
        spots = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        equal = F.filter(spots, lambda i: F.get("hs", i) == F.get("their_hs", i - shift))
        starts = lambda e: F.filter(e, lambda x, j: F.coalesce(F.get(e, j - 1) != x - 1, F.lit(True)))
        stops = lambda e: F.filter(e, lambda x, j: F.coalesce(F.get(e, j + 1) != x + 1, F.lit(True)))
        ends = F.transform(F.array(equal), lambda e: F.zip_with(
            starts(e), stops(e), lambda x, y: F.struct(x.alias("start"), (y + 1).alias("stop"))
        ))[0]
        return F.filter(ends, lambda x: x["stop"] - x["start"] >= least)

    found = beside.select("r", "k", F.explode(F.flatten(F.transform("shifts", runs))).alias("x"))
    return found.select("r", "k", "x.start", "x.stop").distinct()


def _unsettled(repeats: DataFrame, found: DataFrame, names: DataFrame, words: DataFrame, least: int, store: Store | None = None) -> DataFrame:
    """(key, place, before): runs of ``least`` words, outside ``found``, round anchors that a third place shares.

    A fingerprint may first stand in another context than the run round it: only
    then can a repeated run be missed by laying it beside the first place.
    """
    follow = least // 2
    settled = found.groupBy("r").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    # one row a document meets its runs, not one a place
    held = repeats.filter("times > 2").groupBy(_document(F.col("place")).alias("r"))
    wanted = held.agg(F.collect_list(F.struct("key", "place", "first")).alias("held"))
    wanted = wanted.join(names.select("r", "n"), "r").join(settled, "r", "left")
    def left(p: Column) -> Column:
        at = _at(p["place"])
        spots = F.sequence(F.greatest(F.lit(0), at - (least - follow)), F.least(at, F.col("n") - least))
        # the runs that can hold a spot, found once a place
        near = F.coalesce(F.filter("runs", lambda x: (x["start"] <= at) & (x["stop"] >= at + follow)), F.array())
        inside = lambda near, s: F.exists(near, lambda x: (x["start"] <= s) & (s + least <= x["stop"]))
        outside = F.transform(F.array(near), lambda n: F.filter(spots, lambda s: ~inside(n, s)))[0]
        return F.struct(p["key"], p["place"], p["first"], outside.alias("spots"))

    unsettled = F.filter(F.transform("held", left), lambda p: F.size(p["spots"]) > 0)
    wanted = wanted.select("r", F.explode(unsettled).alias("p")).select("r", "p.*")
    if store is not None:  # it is read twice
        wanted = store.save(wanted, "unsettled")
    later = wanted.filter("place <> first").select("key").distinct()
    spots = wanted.join(later, "key", "left_semi").select("r", F.explode("spots").alias("s"))
    spots = spots.groupBy("r").agg(F.collect_set("s").alias("spots")).join(names.select("r", "k"), "r").join(words, "k")
    two = lambda w: F.transform(F.array(w), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))[0]
    placed = _placed(F.col("spots"), lambda p: two(_run(p, least)))
    return spots.select("r", placed).select("p.key", _number(F.col("r"), F.col("p.at")).alias("place"), "p.before")


def repeated_runs(docs: DataFrame, least: int = LEAST, store: Store | None = None) -> DataFrame:
    """(k, runs): the spans of words (start, stop) to delete, for the documents that lose any.

    Documents are in order of doc_id (nulls first), then row key. Every run of ``least``
    words that occurred before goes, whatever its line ends; the first occurrence of
    each word of it stays, since a word is only deleted beside an equal one earlier
    in the order. Of documents with the same words all but the first go whole and
    are not laid beside others.
    """
    store = store or Store(docs.sparkSession, "passages")
    # texts are dealt, not the hashes of their words, which take up more and cannot be packed
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    rows = store.save_buckets(keyed, "words", "k", lambda dealt: _words(dealt, least)).filter(F.col("n") >= least)
    store.release()
    kinds = store.save(rows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "k", "n")).alias("first")), "kinds")
    copies = rows.select("k", "n", "a", "b").join(kinds, ["a", "b"]).filter("k <> first.k")
    copies = store.save(copies.select("k", F.lit(0).alias("start"), F.col("n").alias("stop")).distinct(), "copies")
    firsts = kinds.select("first.*")
    block = range_blocks(firsts, "doc_id", 2000, firsts.count())
    names = store.save(ranked(firsts, [], ["doc_id", "k"], block, "r", store).drop("doc_id"), "names")
    words = rows.select("k", "hs").dropDuplicates(["k"])
    places = store.save(_anchors(words.join(names.select("k", "r"), "k"), least), "places")
    repeats = store.save(_repeats(places), "repeats")
    store.drop(places)
    store.release()
    pairs = store.save(_alignments(repeats), "pairs")
    found = store.save(_grow(pairs, names, words, least), "found")
    store.release()
    windows = store.save(_unsettled(repeats, found, names, words, least, store), "windows")
    store.drop(repeats)
    again = store.save(_alignments(_repeats(windows)), "again")
    store.drop(windows)
    store.release()
    more = _grow(again, names, words, least)
    every = found.unionByName(more).select("k", "start", "stop").unionByName(copies)
    gone = store.save(_merged(every.distinct()), "gone")
    store.drop_buckets()
    store.release()
    return gone


def _cut(text: Column, runs: Column) -> Column:
    """``text`` without the words of ``runs`` (ascending, apart): lines left without words go, blank lines and the ends of cut lines stay.

    The result is put together from the spans of words that are kept and what each gap leaves:
    where lines end in a gap, the blanks before it go, one line end stays for them unless a line begins there,
    and so do blank lines inside and the blanks before the next word.
    """
    lead = F.regexp_extract(text, r"^\s*", 0)
    words = F.split(F.substring(text, F.length(lead) + 1, F.length(text)), r"(?<=\s)(?=\S)")
    strip = lambda c: F.regexp_replace(c, r"[^\S\n]+\z", "")
    span = lambda w, start, stop: F.slice(w, start + 1, F.greatest(stop - start, F.lit(0)))

    def gap(w: Column, r: Column) -> Column:
        ends = F.filter(span(w, r["start"], r["stop"]), lambda x: x.contains("\n"))
        return F.transform(ends, lambda x: F.regexp_extract(x, r"\n[\s\S]*\z", 0))

    def piece(w: Column, start: Column, r: Column, first: Column) -> Column:
        """What stays of the words from ``start`` to the end of the gap ``r``."""
        before, ends = span(w, start, r["start"] - 1), gap(w, r)
        last = F.when(r["start"] > start, F.get(w, r["start"] - 1)).otherwise(first)
        head = F.array_join(before, "")
        blank = F.array_join(F.transform(ends, lambda x: F.regexp_extract(x, r"\A\n([\s\S]*\n)", 1)), "")
        begins = (strip(last) == "") | strip(last).endswith("\n")
        left = F.concat(strip(last), F.when(begins, "").otherwise("\n"), blank, F.regexp_extract(F.element_at(ends, -1), r"([^\n]*)\z", 1))
        return F.concat(head, F.when(F.size(ends) == 0, last).otherwise(left))

    def whole(w: Column) -> Column:
        start = lambda i: F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0))
        opening = F.get(runs, F.lit(0))["start"] == 0
        first = lambda i: F.when((i == 0) & opening, lead).otherwise("")
        pieces = F.array_join(F.transform(runs, lambda r, i: piece(w, start(i), r, first(i))), "")
        ended = F.element_at(runs, -1)["stop"]
        left = F.concat(F.when(opening, "").otherwise(lead), pieces, F.array_join(span(w, ended, F.size(w)), ""))
        last = (ended >= F.size(w)) & ~F.element_at(w, -1).contains("\n")
        return F.when(last, F.regexp_replace(left, r"\n?[^\S\n]*\z", "")).otherwise(left)

    return F.transform(F.array(words), whole)[0]


def _merged(runs: DataFrame) -> DataFrame:
    """(k, runs) of rows (k, start, stop): overlapping and adjoining spans made one, in order."""
    before = Window.partitionBy("k").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k").orderBy("start", "stop")
    new = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    islands = runs.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("k", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def dedup_passages(docs: DataFrame, least: int = LEAST, store: Store | None = None) -> DataFrame:
    """``docs`` with the text cut and ``n_lines``, ``n_removed`` (lines that went), ``n_words_cut`` appended, as the last three columns.

    A null text stays null with no lines; rows that repeat an id and a text are one
    document and lose the same words. Where ``docs`` has a column of an appended name, it stays, and
    underscores are added to the appended one. An empty table stays empty.
    """
    gone = repeated_runs(docs.select("doc_id", "text"), least, store)
    key, runs, cut = fresh(docs, "k", "runs", "cut")
    n_lines, n_removed, n_cut = fresh(docs, "n_lines", "n_removed", "n_words_cut")
    keyed = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    joined = keyed.join(gone.withColumnsRenamed({"k": key, "runs": runs}), key, "left")
    joined = joined.withColumn(cut, F.when(F.col(runs).isNotNull(), _cut(F.col("text"), F.col(runs))))
    count = lambda c: F.coalesce(F.size(F.split(c, "\n")), F.lit(0)).cast("long")
    kept = F.when(F.col(cut) == "", F.lit(0)).otherwise(count(cut))
    lost = F.aggregate(runs, F.lit(0), lambda s, r: s + r["stop"] - r["start"])
    return joined.select(
        *[F.coalesce(cut, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        count("text").alias(n_lines),
        F.when(F.col(cut).isNull(), F.lit(0)).otherwise(count("text") - kept).cast("long").alias(n_removed),
        F.when(F.col(cut).isNull(), F.lit(0)).otherwise(lost).cast("long").alias(n_cut),
    )
