"""The driver's tables seen as a text corpus; every view covers a whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.schemas import SOURCE_TYPES
from quire.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source_no() -> Column:
    return F.expr("cast(substring(source, 4) as int)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``no``, the number in its source name."""
    return table(spark, sf_dir, "documents").withColumn("no", _source_no())


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for jobs that work through the whole text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").withColumn("no", _source_no())


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a row of one of the five source types, chosen by its source."""
    kind = F.col("source_type")
    doc = F.col("doc_id").cast("string")
    month = F.when(F.col("n_chars") % 2 == 0, "04").otherwise("10")
    typed = texts(spark, sf_dir).withColumn(
        "source_type", F.get(F.array(*[F.lit(s) for s in SOURCE_TYPES]), F.col("no") % 5)
    )
    return typed.select(
        "source_type",
        F.col("doc_id").alias("source_id"),
        F.when(kind != "scriptures", F.concat_ws(" ", "source", doc)).alias("title"),
        F.when(kind == "scriptures", F.concat(F.col("source"), F.lit(" "), doc, F.lit(":1"))).alias("reference"),
        F.col("text").alias("content"),
        F.when(kind == "scriptures", F.concat(F.lit("eng/scriptures/bofm/"), "source", F.lit("/"), doc, F.lit(".md")))
        .when(
            kind == "talks",
            F.concat(F.lit("eng/general-conference/"), F.col("no") + 2000, F.lit("/"), month, F.lit("/"), doc, F.lit(".md")),
        )
        .when(kind == "manuals", F.concat(F.lit("eng/manual/"), "source", F.lit("/"), doc, F.lit(".md")))
        .when(kind == "books", F.concat(F.lit("/data/books/"), "source", F.lit("/"), doc, F.lit(".md")))
        .otherwise(F.concat(F.lit("/data/gospel-library/eng/scriptures/tg/"), doc, F.lit(".md")))
        .alias("file_path"),
        F.when(kind == "talks", F.concat(F.lit("Speaker "), "source")).alias("speaker"),
        F.when(kind == "talks", F.col("no") + 2000).alias("year"),
        F.when(kind == "talks", month).alias("month"),
        F.when(kind == "study_aids", "tg").alias("aid_type"),
        F.when(kind == "study_aids", doc).alias("slug"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a search query."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


# --- vectors ---------------------------------------------------------------


def hot_queries(postings: DataFrame) -> DataFrame:
    """Queries of the 60 most frequent terms, alone or in twos, with limits in and out of range and some source lists."""
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    hot = counts.orderBy(F.col("df").desc(), "term").limit(60)
    place = Window.orderBy(F.col("df").desc(), "term")
    numbered = hot.select(F.row_number().over(place).alias("i"), "term")
    step = F.when(F.col("i") % 3 == 1, 1).when(F.col("i") % 3 == 2, 7)
    other = numbered.select((F.col("i")).alias("_i"), F.col("term").alias("other"))
    limits = F.array(*[F.lit(n).cast("int") for n in (3, 20, 100, 0, 101, None)])
    return numbered.join(other, F.col("_i") == F.col("i") + step, "left").select(
        F.col("i").cast("long").alias("query_id"),
        F.concat_ws(" ", "term", "other").alias("query"),
        F.get(limits, F.col("i") % 6).alias("limit"),
        F.when(F.col("i") % 5 == 4, F.array(F.lit("talks"), F.lit("books"))).alias("sources"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector, attached to the document with the same number."""
    docs = library(spark, sf_dir).select(F.col("source_id").alias("vec_id"), "source_type", "content")
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(
        F.coalesce("source_type", F.lit("scriptures")).alias("source_type"),
        F.col("vec_id").alias("source_id"),
        F.lit("paragraph").alias("layer"),
        F.coalesce("content", F.lit("")).alias("content"),
        "embedding",
        F.lit("driver").alias("model"),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of all its vectors. Odd labels search two sources only."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg("x").alias("mean"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("parts"))
    )
    return means.select(
        F.col("label").cast("bigint").alias("query_id"),
        F.col("parts.mean").cast("array<float>").alias("vector"),
        F.when(F.col("label") % 2 == 1, F.array(F.lit("talks"), F.lit("books"))).alias("sources"),
        F.lit(10).alias("limit"),
    )


def every_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(10).alias("limit")
    )


# --- text with paragraphs ----------------------------------------------------


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines turned into paragraphs."""
    return library(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verse per line of every document."""
    at = F.col("at") + 1
    return texts(spark, sf_dir).select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "line")
    ).select(
        (F.col("doc_id") * 1_000_000 + at).alias("id"),
        F.col("lang").alias("volume"),
        F.col("source").alias("book"),
        F.col("doc_id").cast("int").alias("chapter"),
        at.cast("int").alias("verse"),
        F.concat("source", F.lit(" "), "doc_id", F.lit(":"), at).alias("reference"),
        F.col("line").alias("text"),
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("volume"),
        F.col("source").alias("book"),
        F.col("doc_id").cast("int").alias("chapter"),
        F.concat(F.lit("Chapter "), "doc_id").alias("title"),
        F.col("text").alias("full_content"),
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
    )


# --- citations ---------------------------------------------------------------

# One citation of each form per document; {b} is the book, {c} the chapter.
CITATION_FORMS = (
    "{b} {c}:1", "{b} {c}:2-6", "{b} {c}", "{b} {c}:5-2", "{b} {c}:1-51", "{b}  {c}:7a", "nowhere {c}:1",
    "{b}", "{b} {c}:3–4", "{b} {c}:2-", "{b} {c}:3--2", "{b} {c}:0", " {b} {c}:1-50 ",
)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(f) for f in CITATION_FORMS])
    return documents(spark, sf_dir).select(
        "doc_id", "source", F.posexplode(forms).alias("k", "form")
    ).select(
        (F.col("doc_id") * len(CITATION_FORMS) + F.col("k")).alias("request_id"),
        F.replace(
            F.replace("form", F.lit("{b}"), F.upper("source")), F.lit("{c}"), F.col("doc_id").cast("string")
        ).alias("citation"),
    )


def source_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select("source").distinct()
    return source.select(F.col("source").alias("alias"), F.col("source").alias("book"))


def order_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a request for its seven possible lines."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.lit("orders").alias("volume"),
        F.lit("order").alias("book"),
        F.col("o_orderkey").cast("int").alias("chapter"),
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("verse"),
    )


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as an edge from its order line to its part; filled orders cite whole chapters."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("orders").alias("source_volume"),
        F.lit("order").alias("source_book"),
        F.col("l_orderkey").cast("int").alias("source_chapter"),
        F.col("l_linenumber").alias("source_verse"),
        F.lit("parts").alias("target_volume"),
        F.lit("part").alias("target_book"),
        F.col("l_partkey").cast("int").alias("target_chapter"),
        F.when(F.col("l_linestatus") != "F", F.col("l_linenumber")).alias("target_verse"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("reference_type"),
    )


def hot_line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the lineitems, those of every third order from verse 1 of chapter 0."""
    moved = F.col("source_chapter") % 3 == 0
    return line_edges(spark, sf_dir).withColumns({
        "source_verse": F.when(moved, 1).otherwise(F.col("source_verse")),
        "source_chapter": F.when(moved, 0).otherwise(F.col("source_chapter")),
    })


def hot_order_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of the orders; every 1500th order asks for verse 1 of chapter 0 besides."""
    asked = order_verses(spark, sf_dir)
    more = asked.filter("verse = 1 AND request_id % 1500 = 1").withColumn("chapter", F.lit(0))
    return asked.unionByName(more)


def part_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("part").alias("book"),
        F.col("p_partkey").cast("int").alias("chapter"),
        (F.col("p_size") % 7 + 1).alias("verse"),
        F.col("p_name").alias("reference"),
    )


# --- files -------------------------------------------------------------------

MTIME = "2024-05-01 00:00:00"


def _file(path: Column, content: Column) -> list[Column]:
    return [
        path.alias("path"), path.alias("rel_path"), F.lit(MTIME).cast("timestamp").alias("mtime"),
        F.octet_length(content).cast("bigint").alias("size"), content.alias("content"),
    ]


def _chapter_text() -> Column:
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("**"), i + 1, F.lit(".** "), line,
            F.lit("<sup>[a](#fn-1)</sup>  [see  here](../x.md)<sup>b</sup>"),
        ),
    )
    return F.concat(F.lit("# Chapter "), "doc_id", F.lit("\n\n"), F.array_join(numbered, "\n"))


def scripture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a scripture chapter: numbered verses with a footnote and a link each."""
    path = F.concat(F.lit("eng/scriptures/bofm/"), "source", F.lit("/"), "doc_id", F.lit(".md"))
    return texts(spark, sf_dir).select("doc_id", *_file(path, _chapter_text()))


def _talk_text() -> Column:
    doc = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("# Talk "), doc, F.lit("\n\n🎧 [Listen to Audio](https://a/"), doc, F.lit(".mp3)\n\n# Talk "), doc,
        F.lit("\n\n(See "), doc, F.lit(".)\n\n"),
    )
    speaker = F.when(F.col("n_chars") % 9 == 0, "").otherwise(
        F.concat(F.lit("By *Elder* ["), "source", F.lit("](../s.md)\n\n"))
    )
    return F.concat(head, speaker, F.replace("text", F.lit("\n"), F.lit("\n\n")))


def talk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a talk: title, audio link, title again, mostly a speaker, then the text."""
    path = F.concat(
        F.lit("eng/general-conference/"), F.col("no") + 2000,
        F.when(F.col("n_chars") % 2 == 0, "/04/").otherwise("/10/"), F.col("doc_id").cast("string"), F.lit(".md"),
    )
    return texts(spark, sf_dir).select("doc_id", *_file(path, _talk_text()))


# Path shapes of the mixed tree, by source number; {s} is the source, {d} the document.
PATH_SHAPES = (
    "eng/scriptures/bofm/{s}/{d}.md", "eng/general-conference/2001/04/{d}.md", "eng/manual/{s}/a/{d}.md",
    "eng/scriptures/tg/{d}.md", "eng/scriptures/jst/{s}/{d}.md", "eng/liahona/2020/{d}.md",
    "eng/scriptures/ot/{s}/intro{d}.md", "eng/general-conference/later/04/{d}.md", "eng/{d}.md",
    "eng/scriptures/maps/{s}/{d}.md",
)


def _mixed_path() -> Column:
    shape = F.get(F.array(*[F.lit(s) for s in PATH_SHAPES]), F.col("no") % len(PATH_SHAPES))
    return F.replace(
        F.replace(shape, F.lit("{s}"), F.col("source")), F.lit("{d}"), F.col("doc_id").cast("string")
    )


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a tree that mixes all path shapes."""
    return texts(spark, sf_dir).select("doc_id", *_file(_mixed_path(), F.col("text")))


def old_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was indexed before: the labelled documents; toxic ones had another size, good ones another time."""
    files = mixed_files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return files.select(
        F.col("path").alias("file_path"),
        F.lit("old").alias("content_type"),
        F.lit(MTIME).cast("timestamp").alias("indexed_at"),
        F.when(F.col("quality") == 1, F.lit("2024-06-01 00:00:00")).otherwise(F.lit(MTIME)).cast("timestamp").alias("file_mtime"),
        (F.col("size") + F.col("toxic")).alias("file_size"),
        F.lit(1).alias("record_count"),
    )


def old_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talks stored before: the labelled documents, with a carried column and sometimes the right speaker."""
    stored = talk_files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").join(
        documents(spark, sf_dir).select("doc_id", "source"), "doc_id"
    )
    return stored.select(
        F.col("doc_id").alias("id"),
        F.lit(1999).alias("year"),
        F.lit("04").alias("month"),
        F.when(F.col("quality") == 1, F.concat(F.lit("*Elder* "), "source")).otherwise(F.lit("nobody")).alias("speaker"),
        F.lit("old").alias("title"),
        F.lit("old").alias("content"),
        F.col("path").alias("file_path"),
        F.concat(F.lit("q"), "quality").alias("titsw_dominant"),
    )


# --- stored documents that change ------------------------------------------------


def draft_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library before its last revision: poor documents read differently and have a copy that is gone later,
    toxic ones are not there yet."""
    labels = table(spark, sf_dir, "labels")
    poor = labels.filter("quality = 0").select(F.col("doc_id").alias("source_id"), F.lit(True).alias("poor"))
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("source_id"))
    known = library(spark, sf_dir).join(poor, "source_id", "left")
    draft = F.when(F.col("poor"), F.concat(F.lit("Draft "), "content")).otherwise(F.col("content"))
    early = known.join(toxic, "source_id", "left_anti").withColumn("content", draft)
    copies = known.filter("poor").withColumn("source_id", -F.col("source_id") - 1)
    return early.unionByName(copies).drop("poor")


# --- a tree on disk --------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, rel_path, content) of the mixed tree, from one pass over the documents."""
    rows = texts(spark, sf_dir).withColumn("rel_path", _mixed_path())
    content = F.when(F.col("rel_path").contains("/scriptures/"), _chapter_text()).otherwise(_talk_text())
    return rows.select("doc_id", "lang", "rel_path", content.alias("content"))


def tree_files(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """The mixed tree with contents that fit the paths: chapters hold verses, the rest reads like talks."""
    return _tree(spark, sf_dir).select(*["doc_id"] * with_id, "rel_path", "content")


def first_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as it was before: without the documents of one language."""
    return _tree(spark, sf_dir).filter("lang <> 'de'").select("rel_path", "content")


def later_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came to the tree since: the documents of that language, and the poor ones of the others with a line more."""
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    files = _tree(spark, sf_dir).join(poor, "doc_id", "left").filter("lang = 'de' OR poor")
    more = F.when(F.col("lang") == "de", F.col("content")).when(F.col("poor"), F.concat("content", F.lit("\n**9999.** More")))
    return files.select("rel_path", more.alias("content")).filter("content is not null")


def remove_files(files: DataFrame, root: str) -> None:
    """Delete the files of (rel_path) below ``root``, each task its own share."""

    def remove(frames):
        from pyarrow.fs import FileSystem, FileType

        system, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for frame in frames:
            for path in frame["rel_path"]:
                if system.get_file_info(f"{base}/{path}").type == FileType.File:
                    system.delete_file(f"{base}/{path}")
            yield pd.DataFrame({"n": [len(frame)]})

    files.select("rel_path").mapInPandas(remove, "n bigint").agg(F.sum("n")).collect()


def write_tree(files: DataFrame, root: str) -> str:
    """Write (rel_path, content) as files below ``root``, each task its own share."""

    def write(frames):
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made = set()
        for frame in frames:
            for path, content in zip(frame["rel_path"], frame["content"], strict=True):
                if (folder := f"{base}/{path}".rsplit("/", 1)[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    files.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return root
