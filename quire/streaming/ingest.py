"""Low-latency ingest: new files of the trees, in micro-batches."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.plans.ingest import apply_files, ingest
from quire.session import materialise, passing
from quire.sources import corpus
from quire.sources.changed import contents_of
from quire.sources.listing import list_tree
from quire.sources.tables import StateTables


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Files below ``root`` as a stream: new ones, and known ones with a newer time; for stores that only Spark lists."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return corpus.file_columns(raw, root)


_LISTED = "path string, rel_path string, mtime timestamp, size bigint, after bigint"


def listed_files(spark: SparkSession, root: str, place: str, files_per_batch: int = 1000) -> bool:
    """Put the new files below ``root``, and known ones with a newer time, down in ``place``; False where only Spark can list.

    Older files come first. Each batch of them is one file of rows (path, rel_path, mtime, size, after), ``after`` being
    the number of batches that follow it, so a stream over ``place`` takes one file at a time and plans by no file names.
    """
    listing = list_tree(spark, root)
    if listing is None:
        return False
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    known = spark.read.schema(_LISTED).option("recursiveFileLookup", True).parquet(place)
    seen = known.groupBy("path").agg(F.max("mtime").alias("seen"))
    new = listing.join(seen, "path", "left").filter("seen is null or mtime > seen").drop("seen")
    # numbered in order: ranges of rows, and how many stand before each
    ranges = new.repartitionByRange("mtime", "path").sortWithinPartitions("mtime", "path")
    placed = materialise(ranges.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "new-files")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")  # one row a range
    n = placed.count()
    if not n:
        return True
    batches = -(-n // files_per_batch)
    numbered = placed.join(F.broadcast(before), "range").withColumn("after", F.lit(batches - 1) - F.floor((F.col("at") + F.col("before")) / files_per_batch))
    run = f"{place}/run-{uuid.uuid4().hex}"
    tasks = min(batches, 4 * spark.sparkContext.defaultParallelism)
    columns = ["path", "rel_path", "mtime", "size", "after"]
    numbered.select(*columns, F.col("after").alias("batch")).repartition(tasks, "batch").write.partitionBy("batch").parquet(run)
    # the stream takes files by their time; where a store keeps its own, only the order of the batches is lost
    now = int(time.time() * 1000)
    for i in range(batches):
        for status in store.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{run}/batch={batches - 1 - i}")):
            store.setTimes(status.getPath(), now + i, -1)
    return True


def ingest_stream(
    spark: SparkSession,
    state_root: str,
    checkpoint: str,
    library_root: str,
    books: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Run the batch extraction and upserts on every micro-batch until the tree is read.

    The tree is listed once, in tasks, and a micro-batch opens its own files. All batches but the last of a listing defer
    their upserts (``StateTables.merge``): the state reads right after each, and stored rows are rewritten once.
    A file whose time moved backwards does not appear in this stream; ``ingest_watch`` sees it. A repeated
    micro-batch changes nothing, because all upserts are idempotent.
    """
    route = corpus.route_books if books else corpus.route_files

    def changed(state: StateTables, files: DataFrame) -> DataFrame:
        routed = files.filter(F.col("outcome") == "routed")
        known = state.read("index_metadata", among=routed.select(F.col("path").alias("file_path")))
        return files.join(corpus.changed_files(corpus.manifest_diff(routed, known)).select("path"), "path", "left_semi")

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = StateTables(batch.sparkSession, state_root)
        # the files of a batch in a few tasks a core, not one for every 32
        apply_files(state, changed(state, route(batch.coalesce(4 * batch.sparkSession.sparkContext.defaultParallelism))))

    def apply_listed(batch: DataFrame, batch_id: int) -> None:
        with passing(batch.sparkSession):
            one_batch(batch)
        batch.sparkSession._jvm.System.gc()  # Spark drops the shuffle files of what is not referred to any more

    def one_batch(batch: DataFrame) -> None:
        state = StateTables(batch.sparkSession, state_root)
        last = batch.agg(F.min("after")).first()[0] == 0
        files = materialise(changed(state, route(batch.drop("after"))), "changed")
        apply_files(state, contents_of(batch.sparkSession, files, library_root), later=not last)
        if last:
            state.settle()

    place = f"{checkpoint.rstrip('/')}/listed"
    if listed_files(spark, library_root, place, files_per_batch):
        source = spark.readStream.schema(_LISTED).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(place)
        apply = apply_listed
    else:
        source = file_stream(spark, library_root, files_per_batch)
    return (
        source.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_watch(
    spark: SparkSession,
    state_root: str,
    checkpoint: str,
    library_root: str | None = None,
    books_root: str | None = None,
    every: str = "1 minute",
    prune: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Keep the state up to date with the trees: an incremental ingest at every tick of the stream's clock.

    The manifest, not the files' times, says what is new: files that came back from a backup with an
    older time, files of another size, and with ``prune`` vanished ones, are all seen, and only changed files
    are opened. With ``once`` a single tick runs. A tick that is repeated after a failure changes nothing.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def tick(_: DataFrame, batch_id: int) -> None:
        ingest(spark, state_root, library_root, books_root, prune=prune)

    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
