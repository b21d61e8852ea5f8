"""Extraction jobs: from a table of files to tables of verses, talks, chunks and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_inline, first_heading, lines, path_stem, trimmed
from quire.schemas import (
    CHUNK_CHARS,
    PARAGRAPH_LAYER,
    STUDY_AID_TYPES,
    VERSE_LAYER,
    book_names,
)

# A verse line; a heading line; the lines between title and speaker
# that are neither (blank, audio link, wholly in parentheses, heading again).
VERSE_LINE = r"(?d)^\*\*(\d+)\.\*\*\s*(.+)"
HEADING_LINE = r"(?Ud)^\s*# .*\S"
NOISE_LINE = r"(?Ud)^\s*(?:\z|🎧|\[Listen to Audio|# .*\S|\(.*\)\s*\z)"
AUDIO_REMNANT = "Listen to Audio"
LONGEST_SPEAKER_BYTES = 200


def compose_reference(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add ``reference``: display name of the book, chapter and verse."""
    if names is None:
        # the built-in list has a fixed number of rows, so this broadcast cannot grow
        names = F.broadcast(book_names(rows.sparkSession))
    named = rows.join(names, "book", "left")
    return named.withColumn(
        "reference",
        F.format_string(
            "%s %d:%d", F.coalesce("display_name", "book"), F.col("chapter"), F.col("verse")
        ),
    ).drop("display_name")


def extract_verses(routed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per verse line of each scripture file; needs volume, book, chapter, path, content."""
    marked = F.filter(lines(F.col("content")), lambda line: line.startswith("**"))
    # parsed and filtered inside the array: a filter on top would run the patterns twice
    parsed = F.filter(
        F.transform(
            marked,
            lambda line, i: F.struct(
                i.alias("line_no"),
                F.regexp_extract(line, VERSE_LINE, 1).try_cast("int").alias("verse"),
                clean_inline(F.regexp_extract(line, VERSE_LINE, 2)).alias("text"),
            ),
        ),
        lambda v: v.getField("verse").isNotNull() & (v.getField("text") != ""),
    )
    found = routed.select(
        "volume", "book", "chapter", F.col("path").alias("file_path"), F.inline_outer(parsed)
    ).filter(F.col("line_no").isNotNull())
    return compose_reference(found, names).select(
        "volume", "book", "chapter", "verse", "reference", "text", "file_path", "line_no"
    )


def extract_chapters(routed: DataFrame) -> DataFrame:
    """One row per scripture file, with its first heading as title ('' when it has none)."""
    return routed.select(
        "volume", "book", "chapter",
        first_heading(F.col("content")).alias("title"),
        F.col("content").alias("full_content"),
        F.col("path").alias("file_path"),
    )


def extract_manuals(routed: DataFrame) -> DataFrame:
    return routed.select(
        F.lit("manual").alias("content_type"),
        F.col("collection").alias("collection_id"),
        first_heading(F.col("content"), path_stem(F.col("path"))).alias("title"),
        "content",
        F.col("path").alias("file_path"),
    )


def extract_books(routed: DataFrame) -> DataFrame:
    return routed.select(
        "collection", "section",
        first_heading(F.col("content"), F.col("section")).alias("title"),
        "content",
        F.col("path").alias("file_path"),
    )


def extract_study_aids(routed: DataFrame) -> DataFrame:
    """Study aids with a type outside the known four are refused, as the table's domain demands."""
    return routed.filter(F.col("aid_type").isin(*STUDY_AID_TYPES)).select(
        "aid_type", "slug",
        first_heading(F.col("content"), F.col("slug")).alias("title"),
        "content",
        F.col("path").alias("file_path"),
    )


def _first_line(rows: Column, wanted) -> Column:
    """0-based index of the first line that ``wanted(line, index)`` accepts; null if none."""
    return F.array_min(F.transform(rows, lambda line, i: F.when(wanted(line, i), i)))


def suspicious_speaker(speaker: Column) -> Column:
    """Empty, still holding audio-link text, or longer than 200 bytes."""
    return (
        (speaker == "") | speaker.contains(AUDIO_REMNANT) | (F.octet_length(speaker) > LONGEST_SPEAKER_BYTES)
    )


def parse_talk_header(files: DataFrame) -> DataFrame:
    """Replace ``content`` by title, speaker and body, and flag suspicious speakers.

    Adds ``raw_first_line``, the first non-blank line after the title, for the
    quarantine table. A text without a heading has all three fields empty.
    """
    cut = files.withColumn("_lines", lines(F.col("content")))
    cut = cut.withColumn(
        "_title_at",
        _first_line(F.col("_lines"), lambda line, i: line.contains("# ") & line.rlike(HEADING_LINE)),
    )
    cut = cut.withColumn(
        "_speaker_at",
        _first_line(
            F.col("_lines"),
            lambda line, i: (i > F.col("_title_at")) & ~line.rlike(NOISE_LINE),
        ),
    ).withColumn(
        "_raw_at",
        _first_line(
            F.col("_lines"), lambda line, i: (i > F.col("_title_at")) & (trimmed(line) != "")
        ),
    )
    title_line = trimmed(F.get("_lines", F.col("_title_at")))
    cut = cut.withColumn(
        "title", F.coalesce(trimmed(title_line.substr(F.lit(3), F.length(title_line))), F.lit(""))
    ).withColumn(
        "_candidate", F.coalesce(clean_inline(F.get("_lines", F.col("_speaker_at"))), F.lit(""))
    )
    by = F.lower("_candidate").startswith("by ") & (F.octet_length("_candidate") > 3)
    cut = cut.withColumn(
        "speaker",
        F.when(by, F.trim(F.col("_candidate").substr(F.lit(4), F.length("_candidate")))).otherwise(
            F.col("_candidate")
        ),
    )
    body_at = F.when(F.col("speaker") != "", F.col("_speaker_at")).otherwise(F.col("_title_at"))
    body = F.array_join(
        F.slice("_lines", body_at + 2, F.greatest(F.size("_lines") - body_at - 1, F.lit(0))), "\n"
    )
    return (
        cut.withColumn("content", F.coalesce(body, F.lit("")))
        .withColumn("raw_first_line", F.coalesce(trimmed(F.get("_lines", F.col("_raw_at"))), F.lit("")))
        .withColumn("suspicious", suspicious_speaker(F.col("speaker")))
        .drop("_lines", "_title_at", "_speaker_at", "_raw_at", "_candidate")
    )


def extract_talks(routed: DataFrame) -> DataFrame:
    return parse_talk_header(
        routed.select("year", "month", "content", "rel_path", F.col("path").alias("file_path"))
    )


def quarantine_speakers(talks: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows for the quarantine table: talks whose speaker looks wrong. They are indexed all the same."""
    return talks.filter("suspicious").select(
        (F.current_timestamp() if now is None else now).alias("logged_at"),
        "rel_path",
        "raw_first_line",
        F.col("speaker").alias("fallback_value"),
    )


def backfill_speakers(talks: DataFrame, files: DataFrame) -> DataFrame:
    """Parse the header of every stored talk's file again and say what that changes.

    One row per talk with ``status`` missing, failed, unchanged or changed.
    """
    parsed = parse_talk_header(
        files.select(F.col("path").alias("file_path"), "rel_path", "content")
    ).select("file_path", "rel_path", "raw_first_line", "suspicious", F.col("speaker").alias("new_speaker"))
    return talks.select("id", "file_path", "speaker").join(parsed, "file_path", "left").withColumn(
        "status",
        F.when(F.col("suspicious").isNull(), "missing")
        .when(F.col("suspicious"), "failed")
        .when(F.col("new_speaker").eqNullSafe(F.col("speaker")), "unchanged")
        .otherwise("changed"),
    )


def backfill_updates(backfill: DataFrame) -> DataFrame:
    return backfill.filter(F.col("status") == "changed").select(
        "id", "file_path", F.col("new_speaker").alias("speaker")
    )


def backfill_summary(backfill: DataFrame) -> DataFrame:
    """Talks per status, and the total."""
    counts = backfill.groupBy("status").agg(F.count("*").alias("n"))
    return counts.unionByName(
        counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n")
    )


def chunk_paragraphs(rows: DataFrame) -> DataFrame:
    """Blank-line separated paragraphs of (source_type, source_id, content), cleaned.

    ``layer`` is ``paragraph`` for the first survivor, ``paragraph_N`` for later ones. A paragraph of
    more than ``CHUNK_CHARS`` code points goes on in further chunks, with ``+1``, ``+2`` after its layer.
    """
    cleaned = F.transform(F.split("content", "\n\n"), clean_inline)
    kept = F.filter(cleaned, lambda p: p != "")
    # the outer form keeps Spark from cleaning twice, once to test for emptiness
    cut = rows.select("source_type", "source_id", F.posexplode_outer(kept).alias("_at", "_text"))
    last = F.floor((F.length("_text") - 1) / CHUNK_CHARS).cast("int")
    pieces = cut.filter(F.col("_at").isNotNull()).withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.when(F.col("_at") == 0, PARAGRAPH_LAYER).otherwise(F.concat(F.lit(PARAGRAPH_LAYER + "_"), F.col("_at")))
    return pieces.select(
        "source_type",
        "source_id",
        F.when(F.col("_piece") == 0, first).otherwise(F.concat(first, F.lit("+"), F.col("_piece"))).alias("layer"),
        F.col("_text").substr(F.col("_piece") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("content"),
    )


def verse_chunks(scriptures: DataFrame) -> DataFrame:
    """Verses are embedded whole, one chunk each."""
    return scriptures.filter(F.length("text") > 0).select(
        F.lit("scriptures").alias("source_type"),
        F.col("id").alias("source_id"),
        F.lit(VERSE_LAYER).alias("layer"),
        F.col("text").alias("content"),
    )
