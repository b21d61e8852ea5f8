"""State tables: partitioned Parquet folders below one root.

Rows lie in hash partitions of their key, so a merge reads and rewrites only
the partitions its batch touches. The merged rows are stored in the shared
scratch folder first: a table cannot be overwritten while it is read, and the
stored copy is what the final write, or a repeat of it, starts from.

Beside each table lie its row counts by listed column and partition. A write takes
out the counts of the partitions it touches, and puts in new ones when it is done;
partitions without counts, as a broken write leaves them, are counted when read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.upsert import UPSERTS, applied, incoming_rows
from quire.schemas import TABLES
from quire.session import materialise, passing

PARTS = 64

# The columns whose hash places a row; tables not listed are appended to and never rewritten.
PLACED = {
    **{name: keys for name, (keys, _) in UPSERTS.items()},
    "embeddings": ["source_type", "source_id"],
    "embedded_documents": ["source_type", "source_id"],
}

# The columns that listings group by.
COUNTED = {
    "scriptures": ["volume", "book"],
    "chapters": [],
    "talks": ["year", "month"],
    "manuals": ["collection_id"],
    "books": ["collection"],
    "study_aids": ["aid_type"],
    "embeddings": [],
}


class StateTables:
    """Read, merge into and append to the tables of one corpus.

    ``parts`` is fixed when a corpus is first built and stored beside its tables;
    large ones want thousands. Another number for a stored corpus is an error.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        stored = self._stored_parts()
        if stored is not None and parts not in (None, stored):
            raise ValueError(f"{self.root} has {stored} parts, not {parts}")
        self.parts = stored or parts or PARTS

    def _stored_parts(self) -> int | None:
        if self.exists("_parts"):
            return self.spark.read.schema("parts int").json(f"{self.root}/_parts/data").first().parts
        return PARTS if any(self.exists(name) for name in UPSERTS) else None  # stored before the number was

    def begin(self) -> None:
        """Store the number of parts, before the first write."""
        if not self.exists("_parts"):
            one = self.spark.createDataFrame([(self.parts,)], "parts int").coalesce(1)
            one.write.mode("overwrite").json(f"{self.root}/_parts/data")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _in_parts(self, name: str) -> bool:
        return bool(self._parts_of(name))

    def _parts_of(self, name: str) -> set[int]:
        """Partitions that a table has, at most ``parts``."""
        path, store = self._path(name)
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        return {int(n.removeprefix("part=")) for n in names if n.startswith("part=")}

    def _delete(self, name: str) -> None:
        path, store = self._path(name)
        store.delete(path, True)

    def _stored(self, name: str) -> DataFrame:
        if name in PLACED and self.exists(name) and not self._in_parts(name):
            # stored before the table had partitions, or without any row
            plain = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
            return plain.withColumn("part", self._part(name))
        part = [T.StructField("part", T.IntegerType())] if name in PLACED else []
        schema = T.StructType([*TABLES[name].fields, *part])
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def read(self, name: str, among: DataFrame | None = None) -> DataFrame:
        """The table, or an empty one with its schema; with ``among`` (key columns) only its rows of these keys."""
        rows, later = self._stored(name).select(*TABLES[name].names), self._later(name)
        if among is not None:
            rows = rows.join(among, UPSERTS[name][0], "left_semi")
        if not later:
            return rows
        keys, columns = UPSERTS[name]
        return applied(rows, self._deferred(name, among), keys, columns)

    def _later(self, name: str) -> list[int]:
        """Numbers of the deferred merges of a table."""
        if name not in UPSERTS:
            return []
        path, store = self._path(f"_later/{name}")
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n.removeprefix("seq=")) for n in names if n.startswith("seq="))

    def _deferred(self, name: str, among: DataFrame | None = None) -> DataFrame:
        """What the deferred merges come to, one row a key: updated columns as the last has them, others as the first."""
        keys, columns = UPSERTS[name]
        schema = T.StructType([*TABLES[name].fields, T.StructField("seq", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/_later/{name}")
        if among is not None:
            rows = rows.join(among, keys, "left_semi")
        # rows with a null in their key match none, so each merge adds its own
        apart = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.col("seq"))
        of_key = Window.partitionBy(*keys, apart).orderBy(F.col("seq").desc())
        whole = of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = [n for n in TABLES[name].names if n not in keys and n not in columns]
        ranked = rows.select("*", F.row_number().over(of_key).alias("_n"), F.last(F.struct(*carried)).over(whole).alias("_first") if carried else F.lit(None).alias("_first"))
        return ranked.filter("_n = 1").select(*[F.col(f"_first.{n}").alias(n) if n in carried else F.col(n) for n in TABLES[name].names])

    def settle(self, *names: str) -> None:
        """Merge what was deferred, of all tables or those named; repeating it changes nothing."""
        for name in names or UPSERTS:
            if self._later(name):
                keys, columns = UPSERTS[name]
                with passing(self.spark):
                    fresh = self._deferred(name)
                    # read several times where rows are stored already
                    self._merge(name, materialise(fresh, f"{name}-deferred") if self.exists(name) else fresh, keys, columns)
                self._delete(f"_later/{name}")

    def _part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*PLACED[name]), F.lit(self.parts)).cast("int")

    def _group_counts(self, name: str, parts: set[int]) -> DataFrame:
        """(part, listed columns, n) of some partitions, from the table; only these columns are read."""
        rows = self._stored(name).filter(F.col("part").isin(*parts))
        return rows.groupBy("part", *COUNTED[name]).agg(F.count("*").alias("n"))

    def _forget(self, name: str, parts: set[int] | None) -> None:
        """Take out the counts of partitions that are about to change, or of all."""
        if name in COUNTED:
            for part in [""] if parts is None else [f"/part={p}" for p in parts]:
                self._delete(f"_counts/{name}{part}")

    def recount(self, name: str, parts: set[int] | None = None) -> None:
        """Store the counts of some partitions, or of all that have none."""
        if name not in COUNTED:
            return
        parts = self._parts_of(name) - self._parts_of(f"_counts/{name}") if parts is None else parts & self._parts_of(name)
        if parts:
            counts = self._group_counts(name, parts).hint("rebalance", "part")
            writer = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("part").parquet(f"{self.root}/_counts/{name}")

    def counts(self, name: str) -> DataFrame:
        """(listed columns, n): rows of a table by the columns that listings group by, from the stored counts."""
        keys, shape = COUNTED[name], TABLES[name]
        if self._later(name):
            return self.read(name).groupBy(*keys).agg(F.count("*").alias("n"))
        schema = T.StructType([*[shape[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType())])
        stored = self._parts_of(f"_counts/{name}")
        found = self.spark.createDataFrame([], schema)
        if stored:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/_counts/{name}")
        if self.exists(name) and not self._in_parts(name):
            found = self.read(name).groupBy(*keys).agg(F.count("*").alias("n"))
        elif missing := self._parts_of(name) - stored:
            found = found.unionByName(self._group_counts(name, missing))
        return found.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0")

    def _write(self, name: str, rows: DataFrame, overwrite: str, touched: set[int] | None = None) -> None:
        self.begin()
        self._forget(name, touched)
        # rebalancing splits large partitions and merges small ones by their real size
        (
            rows.hint("rebalance", "part")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", overwrite)
            .partitionBy("part")
            .parquet(f"{self.root}/{name}")
        )
        self.recount(name, touched)

    def merge(
        self, name: str, batch: DataFrame, order_col: str = "file_path", update_cols: list[str] | None = None, later: bool = False
    ) -> None:
        """Upsert a batch; ``batch`` is read several times, so pass a stored one. With ``later`` it is read once and its rows are
        only put down as a deferred merge, which is one write however much is stored."""
        keys, columns = UPSERTS[name]
        fresh = incoming_rows(batch, TABLES[name], keys, update_cols or columns, order_col)
        pending = self._later(name)
        if update_cols not in (None, columns):
            later = False
            if pending:  # these update other columns
                self.settle(name)
                pending = []
        if later or pending:
            self.begin()
            fresh.write.mode("overwrite").parquet(f"{self.root}/_later/{name}/seq={max(pending, default=0) + 1}")
            if not later:
                self.settle(name)
            return
        self._merge(name, fresh, keys, update_cols or columns, batch)

    def _merge(self, name: str, fresh: DataFrame, keys: list[str], columns: list[str], batch: DataFrame | None = None) -> None:
        """Upsert rows of one a key; ``batch``, by default these, is a stored table with the same keys."""
        part = self._part(name)
        if not self.exists(name):
            self._write(name, fresh.withColumn("part", part), "dynamic")
            return
        batch = fresh if batch is None else batch
        touched = [r.part for r in batch.select(part.alias("part")).distinct().collect()]  # at most ``parts``
        if not touched:
            return
        existing = self._stored(name).filter(F.col("part").isin(touched)).drop("part")
        merged = applied(existing, fresh, keys, columns)
        with passing(self.spark):
            self._write(name, materialise(merged.withColumn("part", part), name), "dynamic", set(touched))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Overwrite the whole table."""
        with passing(self.spark):
            self._write(name, materialise(rows.withColumn("part", self._part(name)), name), "static")
        if self._later(name):
            self._delete(f"_later/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        if name not in PLACED:
            rows.write.mode("append").parquet(f"{self.root}/{name}")
            return
        self._place(name)
        placed = rows.withColumn("part", self._part(name)).hint("rebalance", "part")
        self._forget(name, None)
        placed.write.mode("append").partitionBy("part").parquet(f"{self.root}/{name}")
        self.recount(name)

    def _place(self, name: str) -> None:
        """Bring a table that was stored without partitions into them, and deferred merges as well."""
        self.begin()
        self.settle(name)
        if self.exists(name) and not self._in_parts(name):
            self.replace(name, self.read(name))

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """Stored rows with the keys of a stored table ``keys``, from the partitions of these only."""
        self.settle(name)
        touched = [r.part for r in keys.select(self._part(name).alias("part")).distinct().collect()]  # at most ``parts``
        rows = self._stored(name).filter(F.col("part").isin(touched)).drop("part")
        return rows.join(keys.select(*PLACED[name]).distinct(), PLACED[name], "left_semi")

    def swap(self, name: str, gone: DataFrame, rows: DataFrame) -> None:
        """Take out all rows with the keys of ``gone`` and put in ``rows``; both are stored tables.

        Only the partitions of either are read and rewritten. One that ends up without rows is
        deleted, since a dynamic overwrite leaves it alone. Repeating a swap changes nothing.
        """
        self._place(name)
        part = self._part(name).alias("part")
        touched = {r.part for r in gone.select(part).union(rows.select(part)).distinct().collect()}  # at most ``parts``
        if not touched:
            return
        kept = self._stored(name).filter(F.col("part").isin(*touched))
        kept = kept.join(gone.select(*PLACED[name]).distinct(), PLACED[name], "left_anti")
        columns = [*TABLES[name].names, "part"]
        after = materialise(kept.select(columns).unionByName(rows.withColumn("part", self._part(name)).select(columns)), name)
        present = {r.part for r in after.select("part").distinct().collect()}
        if present:
            self._write(name, after, "dynamic", present)
        self._forget(name, touched - present)
        for emptied in touched - present:
            self._delete(f"{name}/part={emptied}")

    def all(self, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in names or TABLES}

    def all_counts(self) -> dict[str, DataFrame]:
        return {name: self.counts(name) for name in COUNTED}
