"""Contents of named files: the reader for an incremental run.

A folder scan prunes by time and length only, so it opens a whole tree to read a
few files of it. Here a table of paths is what is planned: Spark deals its rows to
tasks, a share of bytes each, and a task opens exactly its own files, by their
literal names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_BYTES, TASK_FILES = 64 << 20, 2000
#: Contents that leave a task in one batch (a single file may be longer).
BATCH_BYTES = 8 << 20


def _split(path: str) -> tuple[str, str]:
    """A qualified path as a store's address and the name inside it."""
    if found := re.match(r"file:(?://)?(/.*)", path, re.DOTALL):
        return "", found[1]
    if found := re.match(r"([a-z0-9+.-]+://[^/]*)/(.*)", path, re.DOTALL | re.IGNORECASE):
        return found[1], found[2]
    return "", path


class Opener:
    """Opens files of any store that Arrow knows; a store is connected to once a task."""

    def __init__(self):
        self.stores: dict[str, tuple] = {}

    def store(self, address: str) -> tuple:
        from pyarrow.fs import FileSystem, LocalFileSystem

        if address not in self.stores:
            self.stores[address] = FileSystem.from_uri(f"{address}/") if address else (LocalFileSystem(), "")
        return self.stores[address]

    def read(self, path: str) -> bytes | None:
        """The file's bytes; None when it cannot be read (any more)."""
        address, name = _split(path)
        system, base = self.store(address)
        try:
            with system.open_input_stream(f"{base.rstrip('/')}/{name}" if address else name) as file:
                return file.read()
        except OSError:
            return None


def readable(root: str) -> bool:
    """Whether Arrow knows the kind of store that a qualified ``root`` lies in."""
    try:
        Opener().store(_split(root)[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError, OSError):
        return False
    return True


def read_contents(files: DataFrame, opened: Accumulator | None = None, task_bytes: int = TASK_BYTES, task_files: int = TASK_FILES) -> DataFrame:
    """``files`` (path, size, ...) with ``content`` appended; rows whose file cannot be read are left out.

    ``files`` should be a stored table: its size is measured first, to give every task about
    ``task_bytes`` and at most about ``task_files`` files. ``opened`` counts the files that were tried.
    """
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(1, -(-total.n // task_files), -(-int(total.size) // task_bytes))
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = Opener()
        for batch in batches:
            rows, contents, held = [], [], 0
            for row, path in enumerate(batch.column(names.index("path")).to_pylist()):
                if opened is not None:
                    opened.add(1)
                found = opener.read(path)
                if found is not None:
                    rows.append(row)
                    contents.append(found)
                    held += len(found)
                if rows and (held >= BATCH_BYTES or row + 1 == batch.num_rows):
                    yield _with(batch, rows, contents)
                    rows, contents, held = [], [], 0
            if rows:
                yield _with(batch, rows, contents)

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    dealt = files.repartition(tasks, "path").mapInArrow(run, schema)
    return dealt.withColumn("content", F.col("content").cast("string"))


def _with(batch: pa.RecordBatch, rows: list[int], contents: list[bytes]) -> pa.RecordBatch:
    taken = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"])


def contents_of(spark: SparkSession, files: DataFrame, root: str, opened: Accumulator | None = None) -> DataFrame:
    """``read_contents`` of files below ``root``; in a store that only Spark's readers open, a scan of the tree cut down to them."""
    from quire.sources import corpus

    if readable(corpus.qualified(spark, root)):
        return read_contents(files, opened)
    whole = corpus.scan_corpus(spark, root).select("path", "content")
    return files.join(whole, "path")
