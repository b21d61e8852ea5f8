"""What the training-data operators share: stored steps, exact ranks, Arrow passes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Store:
    """Tables of one operator run, in the folder that ``spark.checkpoint.dir`` names.

    A stored table cuts the lineage, outlives lost executors and is computed
    once. ``drop`` removes single tables, or all, when nothing reads them.
    """

    opened: dict[str, list[Store]] = {}

    def __init__(self, spark: SparkSession, label: str, owner: str | None = None):
        self.spark, self.path, self.count = spark, scratch_path(spark, label), 0
        self.buckets: list[tuple[str, str]] = []
        if owner is not None:
            Store.opened.setdefault(owner, []).append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_buckets(self, df: DataFrame, name: str, key: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """A stored table in buckets of ``key``, which joins on it read without a shuffle; ``then`` is applied to the dealt rows."""
        self.count += 1
        path, label = f"{self.path}/{self.count}-{name}", f"quire_{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartition(n, key)
        (then(dealt) if then else dealt).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(label)
        self.buckets.append((label, path))
        return self.spark.table(label)

    def drop_buckets(self) -> None:
        while self.buckets:
            label, path = self.buckets.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS {label}")
            self._delete(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, *tables: DataFrame) -> None:
        for path in [f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()[:1]] or [self.path] * (not tables):
            self._delete(path)

    def release(self) -> None:
        """Let Spark remove shuffle files of finished steps now: its cleaner waits for the driver's garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    @classmethod
    def drop_owned(cls, owner: str) -> None:
        for store in cls.opened.pop(owner, []):
            store.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def row_key(*columns: Column) -> Column:
    """A 16-byte name of a row from its id and text; nulls differ from empty strings."""
    parts = [x for c in columns for x in (c.isNull().cast("string"), F.coalesce(c.cast("string"), F.lit("")))]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts).cast("binary")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as no column of ``df`` (nor an earlier one) has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(
    df: DataFrame, fields: list[T.StructField], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """One Arrow pass that keeps every column of ``df`` and appends ``fields``."""
    return df.mapInArrow(fn, T.StructType([*df.schema.fields, *fields]))


def range_blocks(df: DataFrame, column: str, rows_per_block: int, rows: int, most: int = 20_000) -> Column:
    """Number of the block of ``column`` in ascending order; nulls are in block 0.

    The bounds are approximate quantiles, so a block holds about
    ``rows_per_block`` rows (more when that takes over ``most`` blocks)
    whatever the spacing of the values. Equal values share a block.
    """
    n = min(most, max(1, -(-rows // rows_per_block)))
    bounds = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    edges = F.lit([int(x) for x in bounds]).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])

    def halve(low: Column, step: Column) -> Column:
        middle = low + step
        return F.when(F.try_element_at(edges, middle) <= F.col(column), middle).otherwise(low)

    return F.coalesce(F.aggregate(steps, F.lit(0), halve), F.lit(0))


def ranked(df: DataFrame, groups: list[str], order: list[str], block: Column, name: str, store: Store) -> DataFrame:
    """Add ``name``: position from 0 within ``groups``, ordered by block, then ``order``.

    A window over a whole group would put a hot group into one task. Rows are
    numbered within (group, block) instead, and the small table of block sizes
    gives each block its start. ``df`` should be a stored table: it is read
    twice.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*groups, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.save(sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size"), "starts")
    inside = Window.partitionBy(*groups, "_block").orderBy(*order)
    numbered = blocked.withColumn("_inside", F.row_number().over(inside) - 1)
    same = [numbered[c].eqNullSafe(starts[c]) for c in [*groups, "_block"]]
    joined = numbered.join(starts, same, "left")
    return joined.select(*[numbered[c] for c in df.columns], (starts["_start"] + numbered["_inside"]).cast("long").alias(name))
