"""A postings table kept up to date: segments of changed documents beside a base, merged when read.

A batch writes one segment: the postings of its documents, and the keys of all
documents it replaces or deletes. A posting is alive unless a later segment
names its document, so reading needs one anti join with the keys of the
segments alone, which are few beside the base. Compaction writes the live
postings as a new base.

Each step ends with a log entry that lists the segments in use. A step that dies
before it leaves the table as it was; what it wrote is never listed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.analysis import PLAIN, Analyzer
from quire.operators.keyword import KEYS, TERM_PARTS, build_postings, write_postings

_POSTING = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("doc_len", T.IntegerType()),
        T.StructField("term_part", T.IntegerType()),
    ]
)
_KEY = T.StructType(_POSTING.fields[:2])
_LOG = "parts int, segments array<string>"


@dataclass(frozen=True)
class SegmentedPostings:
    """Postings below ``root``; ``parts`` and ``analyzer`` are those of the first batch."""

    spark: SparkSession
    root: str
    parts: int = TERM_PARTS
    analyzer: Analyzer = PLAIN

    def _entries(self) -> list[str]:
        """Complete log entries, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        entry = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in store.listStatus(path)]
        return sorted(n for n in names if store.exists(entry(f"{self.root}/log/{n}/_SUCCESS")))

    def segments(self) -> list[str]:
        """Segments in use, oldest first."""
        entries = self._entries()
        if not entries:
            return []
        last = self.spark.read.schema(_LOG).json(f"{self.root}/log/{entries[-1]}").first()
        if last.parts != self.parts:
            raise ValueError(f"{self.root} has {last.parts} parts, not {self.parts}")
        return list(last.segments)

    def _enter(self, segments: list[str]) -> None:
        entries = self._entries()
        number = int(entries[-1]) + 1 if entries else 0
        line = self.spark.createDataFrame([(self.parts, segments)], _LOG).coalesce(1)
        line.write.mode("overwrite").json(f"{self.root}/log/{number:08d}")

    def apply(self, documents: DataFrame, deleted: DataFrame | None = None) -> None:
        """Insert or replace ``documents`` (a corpus as for :func:`build_postings`) and take out the keys in ``deleted``.

        A document that is in both stays, with its new text. One without terms is in no posting.
        """
        segments = self.segments()
        name = f"{len(self._entries()):08d}-{uuid.uuid4().hex}"
        place = f"{self.root}/segments/{name}"
        write_postings(build_postings(documents, self.analyzer), f"{place}/postings", self.parts)
        keys = documents.select(*KEYS)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(*KEYS))
        keys.distinct().write.parquet(f"{place}/keys")
        self._enter([*segments, name])

    def _postings_of(self, segment: str, number: int) -> DataFrame:
        rows = self.spark.read.schema(_POSTING).parquet(f"{self.root}/segments/{segment}/postings")
        return rows.withColumn("_segment", F.lit(number))

    def live(self) -> DataFrame:
        """Current postings with ``term_part``, as :func:`quire.operators.keyword.search_postings` takes them.

        Filters on terms reach the scans, because every posting meets the keys of later segments at most once.
        """
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], _POSTING)
        rows = reduce(DataFrame.unionByName, [self._postings_of(s, i) for i, s in enumerate(segments)])
        if len(segments) == 1:
            return rows.drop("_segment")
        # the first segment replaces nothing, so its keys are not read
        later = [
            self.spark.read.schema(_KEY).parquet(f"{self.root}/segments/{s}/keys").withColumn("_later", F.lit(i))
            for i, s in enumerate(segments)
            if i
        ]
        newest = reduce(DataFrame.unionByName, later).groupBy(*KEYS).agg(F.max("_later").alias("_later"))
        same = [rows[k] == newest[k] for k in KEYS] + [rows["_segment"] < newest["_later"]]
        return rows.join(newest, reduce(lambda a, b: a & b, same), "left_anti").drop("_segment")

    def compact(self) -> None:
        """Write the live postings as one segment; older ones stay on disk for readers that have them open."""
        segments = self.segments()
        if len(segments) < 2:
            return
        name = f"{len(self._entries()):08d}-{uuid.uuid4().hex}"
        place = f"{self.root}/segments/{name}"
        write_postings(self.live().drop("term_part"), f"{place}/postings", self.parts)
        self.spark.createDataFrame([], _KEY).write.parquet(f"{place}/keys")
        self._enter([name])

    def drop_unused(self) -> list[str]:
        """Delete segments that the newest log entry does not list; returns their names."""
        used = set(self.segments())
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.root}/segments")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in store.listStatus(root) if f.getPath().getName() not in used]
        for place in old:
            store.delete(place, True)
        return sorted(p.getName() for p in old)
