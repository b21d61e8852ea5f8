"""Listing of a tree in tasks: no list of its files ever lies on the driver.

Spark's file sources list a tree into the driver's memory, some hundred bytes and more a file.
Here a task lists the folders it is given and goes on into those it finds, until it
has seen its share of entries; the folders left over are dealt out in a next round.
"""

from __future__ import annotations

import errno
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialise
from quire.sources import changed

#: Entries after which a task leaves the folders it found to the next round.
TASK_ENTRIES = 20_000
#: Rows that leave a task in one batch.
BATCH_ROWS = 10_000

_FOUND = "path string, micros bigint, size bigint"
_BATCH = pa.schema([("path", pa.string()), ("micros", pa.int64()), ("size", pa.int64())])


def hidden(name: str) -> bool:
    """Files and folders that Spark's own listing leaves out."""
    out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _local(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    try:
        entries = os.scandir(folder)
    except (FileNotFoundError, NotADirectoryError):  # gone meanwhile
        return
    with entries:
        for entry in entries:
            try:
                is_folder, stat = entry.is_dir(), entry.stat()
            except OSError as error:  # gone meanwhile, or a link to nothing
                if error.errno not in (errno.ENOENT, errno.ELOOP):
                    raise
                continue
            # as Spark's listing, in milliseconds
            yield os.fsencode(entry.name).decode("utf-8", "replace"), is_folder, stat.st_size, stat.st_mtime_ns // 1_000_000 * 1000


def _entries(opener: changed.Opener, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is folder, size, time in microseconds) of what lies in a folder."""
    from pyarrow.fs import FileSelector, FileType

    address, name = changed._split(folder)
    if not address:
        yield from _local(name)
        return
    system, base = opener.store(address)
    for info in system.get_file_info(FileSelector(f"{base.rstrip('/')}/{name}", allow_not_found=True)):
        yield info.base_name, info.type == FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000


def _round(folders: DataFrame, n: int, names: re.Pattern, task_entries: int) -> DataFrame:
    """(path, micros, size) of the files below ``folders`` as far as their tasks came; folders left over have no size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, seen, rows, found = changed.Opener(), 0, [], deque()

        def listed(folder: str) -> Iterator[pa.RecordBatch]:
            nonlocal seen, rows
            seen += 1
            for name, is_folder, size, micros in _entries(opener, folder):
                seen += 1
                if hidden(name):
                    continue
                if is_folder:
                    found.append(f"{folder}/{name}")
                elif names.fullmatch(name):
                    rows.append((f"{folder}/{name}", micros, size))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield from listed(folder)
        while found and seen < task_entries:
            yield from listed(found.popleft())
        yield _batch([*rows, *((folder, None, None) for folder in found)])

    tasks = min(n, 4 * folders.sparkSession.sparkContext.defaultParallelism)
    return folders.repartition(tasks).mapInArrow(run, _FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BATCH.types, strict=True)], schema=_BATCH)


def list_tree(spark: SparkSession, root: str, glob: str = "*.md", task_entries: int = TASK_ENTRIES) -> DataFrame | None:
    """(path, rel_path, mtime, size) of the files below the folder ``root``, as a stored table.

    None where only Spark can list: a store that Arrow does not know, a root that is no folder or is a pattern, a
    name pattern of more than stars and question marks.
    """
    from quire.sources import corpus

    if re.search(r"[\[\]{}\\]", glob) or re.search(r"[*?\[\]{}\\]", root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    top = corpus.qualified(spark, root)
    if not (store.exists(path) and store.getFileStatus(path).isDirectory() and changed.readable(top)):
        return None
    names = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), re.DOTALL)
    folders, n, rounds = spark.createDataFrame([(top,)], "path string"), 1, []
    while n:
        rounds.append(materialise(_round(folders, n, names, task_entries), "listed"))
        folders = rounds[-1].filter("size is null").select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, rounds).filter("size is not null").select(
        "path",
        F.col("path").substr(F.lit(len(top) + 2), F.length("path")).alias("rel_path"),
        F.timestamp_micros("micros").alias("mtime"),
        "size",
    )
