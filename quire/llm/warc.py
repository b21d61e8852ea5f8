"""WARC archives written and read through Spark, and a capture index merged from their sorted runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import Store, ascii_lower
from quire.llm.url_trust import host_of

LINE = "\r\n"
RECORD_END = LINE * 2
SMALLEST_REVISIT = 100
ENTRY = (
    "page_id bigint, url string, captured bigint, file string, record_offset bigint, record_length bigint, "
    "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"
)


def url_key(url: Column) -> Column:
    """Sort key of a url: host labels in reverse order, then the rest in lower case."""
    rest = F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), ascii_lower(rest))


def _header(fields: list[tuple[str, Column]]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", " ")) for name, value in fields]
    return F.concat_ws(LINE, F.lit("WARC/1.0"), *lines)


def write_archives(pages: DataFrame, path: str, first_capture: int = 1_704_067_200) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    Of records with equal payloads of ``SMALLEST_REVISIT`` bytes or more the one
    with the smallest page_id is a ``response``, the others are ``revisit``
    records without payload that refer to it; smaller ones are all responses. A
    null html is an empty payload, a null url an empty target, a null page_id
    is written without id and revisits whatever has its payload. Rows that
    repeat the smallest page_id are all responses. The capture time is
    ``first_capture`` plus the page_id in seconds, for lack of a column. Each file
    is one run, sorted by url key, time and page_id.
    """
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2(F.col("payload"), 256), "bytes": F.octet_length("payload")})
    firsts = rows.filter(F.col("bytes") >= SMALLEST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    ).filter("copies > 1").select("digest", "first")
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("first")))
    uuid = F.regexp_replace(F.md5(F.concat_ws("|", F.lit("page"), "page_id")), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    http = F.concat(
        F.lit(LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
        F.col("bytes").cast("string"), F.lit(RECORD_END),
    )
    captured = F.lit(first_capture) + F.coalesce("page_id", F.lit(0))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    head = _header([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", uuid),
        ("WARC-Date", F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Captured", captured.cast("string")),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("Content-Type", F.when(~revisit, "application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ])
    order = rows.select(
        F.concat(head, F.lit(RECORD_END), block).alias("value"), url_key(F.col("url")).alias("k"), captured.alias("t"), "page_id"
    )
    order = order.sortWithinPartitions("k", "t", "page_id").select("value")
    order.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _records(stream: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of one unpacked file."""
    at = 0
    while at < len(stream):
        end = stream.index(RECORD_END.encode(), at)
        first, *lines = stream[at:end].decode().split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, stream[start:stop]
        at = stop + 4


def _entry(file: str, at: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size, intact = int(fields["X-Payload-Length"]), True
    if fields["WARC-Type"] == "response":
        payload = block[block.index(RECORD_END.encode()) + 4 :]
        real = hashlib.sha256(payload).hexdigest()
        digest, intact, size = real, real == digest and len(payload) == size, len(payload)
    number = lambda name: int(fields[name]) if name in fields else None
    return (
        number("X-Page-ID"), fields.get("WARC-Target-URI", ""), number("X-Captured"), file, at, length, size, digest,
        fields["WARC-Type"], number("X-Refers-To-Page"), intact,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record under ``path``: where it is, what it holds, whether its digest is right."""
    schema = T._parse_datatype_string(ENTRY)
    names = schema.fieldNames()
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.dataType.simpleString()] for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                stream = zlib.decompress(content.as_buffer(), 47)
                rows = [_entry(file.as_py().rsplit("/", 1)[-1], *record) for record in _records(stream)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * len(runs)
        self.winner = self._build(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        """Whether run ``a``'s head comes out before ``b``'s; an ended run loses, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


KEY = ["url_key", "captured", "order_id"]


def merge_index(entries: DataFrame, rows_per_part: int = 20_000, sample: int = 20_000) -> DataFrame:
    """All entries in order of (url key, time, page_id): adds ``url_key`` and ``position`` from 0.

    ``entries`` should be a stored table. Every file is a sorted run. Bounds
    from a sample of at most about ``sample`` whole keys cut the key space into parts
    of about ``rows_per_part`` entries (so one url with a third of all captures
    is cut as well); a part's slices of all runs are merged by a loser tree. The
    sample only places the cuts; every entry is merged. A null page_id comes first.
    """
    keyed = entries.withColumns({"url_key": url_key(F.col("url")), "order_id": F.coalesce("page_id", F.lit(-(1 << 62)))})
    rows = keyed.count()
    parts = max(1, -(-rows // rows_per_part))
    share = max(1, rows // sample)
    picked = keyed.filter(F.pmod(F.xxhash64(*KEY, "file", "record_offset"), F.lit(share)) == 0).select(*KEY) if parts > 1 else None
    seen = sorted(tuple(r) for r in picked.collect()) if picked is not None else []
    bounds = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    sent = entries.sparkSession.sparkContext.broadcast(bounds)
    schema = T.StructType([*keyed.schema.fields, T.StructField("part", T.LongType())])
    names = schema.fieldNames()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in KEY), strict=True)
            part = pa.array([bisect_right(sent.value, k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names)

    def merge(table: pa.Table) -> pa.Table:
        keys = list(zip(*(table.column(k).to_pylist() for k in KEY), strict=True))
        runs: dict[str, list[tuple]] = {}
        places = zip(table.column("file").to_pylist(), table.column("record_offset").to_pylist(), strict=True)
        for i, (file, offset) in enumerate(places):
            runs.setdefault(file, []).append((keys[i], file, offset, i))
        merged = LoserTree([sorted(runs[file]) for file in sorted(runs)])
        order = [entry[3] for entry in merged]
        out = table.take(pa.array(order, pa.int64()))
        return out.append_column("place", pa.array(range(len(order)), pa.int64()))

    full = T.StructType([*schema.fields, T.StructField("place", T.LongType())])
    dealt = keyed.mapInArrow(deal, schema)
    merged = dealt.groupBy("part").applyInArrow(merge, full)
    store = Store(entries.sparkSession, "warc-index")
    merged = store.save(merged, "merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = merged.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "part").withColumn("position", F.col("start") + F.col("place")).drop("start", "place", "part", "order_id")


def captures(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their globally ordered index."""
    spark = pages.sparkSession
    store = Store(spark, "warc")
    write_archives(pages, f"{store.path}/archives")
    return merge_index(store.save(read_archives(spark, f"{store.path}/archives"), "entries"))
