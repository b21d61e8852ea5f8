"""The document tree as a table of files: listing, routing, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import path_stem
from quire.schemas import CROSS_REFERENCES, SCRIPTURE_VOLUMES, STUDY_AID_TYPES
from quire.sources.changed import read_contents
from quire.sources.listing import list_tree


def file_columns(raw: DataFrame, root: str, with_content: bool = True) -> DataFrame:
    """Rename the columns of a binaryFile source and derive the path below ``root``."""
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    below = F.instr("path", base) + len(base)
    columns = [
        F.col("path"),
        F.col("path").substr(below, F.length("path")).alias("rel_path"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    ]
    if with_content:
        columns.append(F.col("content").cast("string").alias("content"))
    return raw.select(*columns)


def scan_corpus(
    spark: SparkSession, root: str, glob: str = "*.md", with_content: bool = True
) -> DataFrame:
    """One row per matching file below ``root``.

    Tasks list the tree, so the driver holds no file names. Without ``content`` the scan never opens a
    file; with it, files that cannot be read are left out. Spark's own scan, which lists on the driver, stands in where only Spark can list.
    """
    listed = list_tree(spark, root, glob)
    if listed is not None:
        return read_contents(listed) if with_content else listed
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .load(root)
    )
    return file_columns(in_shares(raw), root, with_content)


#: Bytes of files that a task reads, where there are more than a few tasks a core.
TASK_BYTES = 64 << 20


def in_shares(raw: DataFrame) -> DataFrame:
    """A scan of files in a few tasks a core, or tasks of ``TASK_BYTES``: Spark counts 4 MB a file, so small ones would take a task for 32."""
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return raw.coalesce(max(4 * raw.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def _whole_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))


def route_files(files: DataFrame) -> DataFrame:
    """Say from its path what each library file is, and take the key columns from the path.

    ``outcome`` is ``routed``, ``skipped`` (a section nobody indexes) or ``ignored``
    (a known section, but the path has the wrong shape).
    """
    parts = F.split("rel_path", "/")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    depth = F.size(parts)
    section = part(1)
    in_scriptures = (section == "scriptures") & (depth >= 4)
    chapter = _whole_number(F.regexp_replace(part(4), r"\.md\z", ""))
    year = _whole_number(part(2))
    slug = F.regexp_replace(
        F.array_join(F.slice(parts, 4, F.greatest(depth - 3, F.lit(0))), "/"), r"\.md\z", ""
    )
    content_type = (
        F.when(in_scriptures & part(2).isin(*STUDY_AID_TYPES) & (slug != ""), "study_aids")
        .when(
            in_scriptures & part(2).isin(*SCRIPTURE_VOLUMES) & (depth >= 5) & chapter.isNotNull(),
            "scriptures",
        )
        .when((section == "general-conference") & (depth >= 5) & year.isNotNull(), "talks")
        .when((section == "manual") & (depth >= 4), "manuals")
    )
    known = section.isin("scriptures", "general-conference", "manual") | (depth < 3)
    typed = files.withColumn("content_type", content_type)

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("content_type") == kind, value)

    return typed.select(
        "*",
        of("scriptures", part(2)).alias("volume"),
        of("scriptures", part(3)).alias("book"),
        of("scriptures", chapter).alias("chapter"),
        of("talks", year).alias("year"),
        of("talks", part(3)).alias("month"),
        of("manuals", part(2)).alias("collection"),
        F.lit(None).cast("string").alias("section"),
        of("study_aids", part(2)).alias("aid_type"),
        of("study_aids", slug).alias("slug"),
        F.when(F.col("content_type").isNotNull(), "routed")
        .when(known, "ignored")
        .otherwise("skipped")
        .alias("outcome"),
    )


def route_books(files: DataFrame) -> DataFrame:
    """The same columns for files of the book tree: first folder is the collection."""
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    return files.select(
        "*",
        F.lit("books").alias("content_type"),
        text.alias("volume"),
        text.alias("book"),
        number.alias("chapter"),
        number.alias("year"),
        text.alias("month"),
        F.get(F.split("rel_path", "/"), F.lit(0)).alias("collection"),
        path_stem(F.col("rel_path")).alias("section"),
        text.alias("aid_type"),
        text.alias("slug"),
        F.lit("routed").alias("outcome"),
    )


def manifest_diff(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Compare the present listing with what was indexed.

    ``outcome`` is ``new``, ``modified`` (time moved either way, or the size
    differs), ``forced`` or ``unchanged``.
    """
    seen = manifest.select(
        F.col("file_path").alias("path"), "file_mtime", "file_size", F.lit(True).alias("seen")
    )
    same = F.col("mtime").eqNullSafe(F.col("file_mtime")) & F.col("size").eqNullSafe(F.col("file_size"))
    return listing.join(seen, "path", "left").select(
        "path",
        "content_type",
        "mtime",
        "size",
        F.when(F.col("seen").isNull(), "new")
        .when(~same, "modified")
        .otherwise("forced" if force else "unchanged")
        .alias("outcome"),
    )


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("outcome") != "unchanged")


def manifest_rows(indexed: DataFrame, now: Column | None = None) -> DataFrame:
    """Manifest rows for files that were indexed; needs path, content_type, mtime, size, record_count."""
    return indexed.select(
        F.col("path").alias("file_path"),
        "content_type",
        (F.current_timestamp() if now is None else now).alias("indexed_at"),
        F.col("mtime").alias("file_mtime"),
        F.col("size").alias("file_size"),
        F.col("record_count").cast("int").alias("record_count"),
    )


def qualified(spark: SparkSession, root: str) -> str:
    """A root as the paths below it begin in a listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def index_run_summary(routed: DataFrame, diff: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Files per content type and outcome: indexed, error (in ``unread``), unchanged, ignored or skipped."""
    compared = diff.select("path", F.col("outcome").alias("change"))
    if unread is not None:
        lost = unread.select("path", F.lit("error").alias("lost"))
        compared = compared.join(lost, "path", "left").withColumn("change", F.coalesce("lost", "change")).drop("lost")
    return (
        routed.select("path", "content_type", "outcome")
        .join(compared, "path", "left")
        .select(
            F.coalesce("content_type", F.lit("none")).alias("content_type"),
            F.when(F.col("outcome") != "routed", F.col("outcome"))
            .when(F.col("change").isin("unchanged", "error"), F.col("change"))
            .otherwise("indexed")
            .alias("outcome"),
        )
        .groupBy("content_type", "outcome")
        .agg(F.count("*").alias("n"))
    )


def load_cross_references(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The edge table is made elsewhere; read it with its fixed schema."""
    return spark.read.schema(CROSS_REFERENCES).format(fmt).load(path)
