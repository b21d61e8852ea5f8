"""Order-free document fingerprints: sums of wide vectors hashed from paragraphs.

A paragraph (a line, cut further at sentence ends) hashes to a wide vector
that is zero but for three places: one of ``LANES`` sparse lanes gets a 32-bit
value, and the two dense lanes get 44-bit values. A document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two, so it
does not depend on their order, and paragraphs can be added or taken out
without reading the rest. Equality rests on all lanes together; likeness is
read off the sparse lanes, since an edit only moves the lanes of the
paragraphs that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, range_blocks

LANES = 32
SPARSE_BITS, DENSE_BITS, DENSE_LANES = 32, 44, 2
#: Line ends, and single spaces after the end of a sentence.
BREAKS = r"\n|(?<=[.!?]) "
WIDTHS = [DENSE_BITS] * DENSE_LANES + [SPARSE_BITS] * LANES


def paragraphs(text: Column) -> Column:
    """Trimmed, not empty pieces of a text; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda p: F.trim(p)), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint as an array: dense lanes, then sparse lanes.

    The 32 hex digits of a paragraph's MD5 give: lane (2), sparse value (8),
    dense values (11 and 11).
    """
    digits = F.transform(paragraphs(text), F.md5)

    def number(d: Column, start: int, length: int) -> Column:
        return F.conv(F.substring(d, start, length), 16, 10).cast("bigint")

    parts = F.transform(
        digits,
        lambda d: F.struct(
            (number(d, 1, 2) % LANES).alias("lane"), number(d, 3, 8).alias("value"),
            number(d, 11, 11).alias("a"), number(d, 22, 11).alias("b"),
        ),
    )
    zero = F.lit(0).cast("bigint")

    def total(values: Column, bits: int) -> Column:
        return F.aggregate(values, zero, lambda s, v: (s + v).bitwiseAND(F.lit((1 << bits) - 1)))

    def lanes(p: Column) -> Column:
        dense = [total(p[k], DENSE_BITS) for k in "ab"]
        sparse = F.transform(
            F.sequence(F.lit(0), F.lit(LANES - 1)),
            lambda j: total(F.transform(F.filter(p, lambda x: x["lane"] == j), lambda x: x["value"]), SPARSE_BITS),
        )
        return F.concat(F.array(*dense), sparse)

    return F.transform(F.array(parts), lanes)[0]


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after inserting (1) or deleting (-1) paragraphs whose fingerprint is ``b``."""
    masks = F.lit([(1 << w) - 1 for w in WIDTHS])
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + sign * y), masks, lambda s, m: s.bitwiseAND(m))


def to_string(v: Column) -> Column:
    """Hex digits of all lanes in order."""
    dense = F.transform(F.slice(v, 1, DENSE_LANES), lambda x: F.lpad(F.lower(F.hex(x)), 11, "0"))
    sparse = F.transform(F.slice(v, DENSE_LANES + 1, LANES), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.array_join(F.concat(dense, sparse), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal share of the sparse lanes that either document uses; 1 for equal fingerprints."""
    pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), DENSE_LANES + 1, LANES)
    used = F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = F.filter(used, lambda p: p["x"] == p["y"])
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.size(same) / F.greatest(F.size(used), F.lit(1)), 9))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` (hex string); null and empty texts have that of no paragraphs."""
    return docs.withColumn("fingerprint", to_string(vector(F.col(text))))


def edit_probe(docs: DataFrame, rows_per_block: int = 500) -> DataFrame:
    """Fingerprints of each text, its edited text and the next document's text.

    The edit replaces the last quarter of the code points by the beginning of
    the next document in ascending ``doc_id`` (the first one, after the last).
    Repeated ids are ordered by text; a null id comes first; a null text is
    empty. A single document is its own successor. Rows are ordered within
    blocks of ids; the first document of each block stands in for the
    successor of the last one of the block before.
    """
    store = Store(docs.sparkSession, "fingerprint")
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = range_blocks(rows.select("doc_id"), "doc_id", rows_per_block, rows.count())
    rows = rows.select(F.struct("doc_id", "text").alias("d"), block.alias("_block"))
    heads = store.save(rows.groupBy("_block").agg(F.min("d").alias("head")), "heads")
    order = Window.orderBy("_block")  # one slim row for each block, without its text
    numbers = heads.select("_block")
    after = numbers.select(F.col("_block"), F.lead("_block").over(order).alias("_next"))
    first = numbers.agg(F.min("_block").alias("_first"))
    after = after.crossJoin(F.broadcast(first)).select("_block", F.coalesce("_next", "_first").alias("_next"))
    successors = after.join(heads.select(F.col("_block").alias("_next"), "head"), "_next").select("_block", "head")
    here = Window.partitionBy("_block").orderBy("d")
    seen = rows.select("_block", "d", F.lead("d.text").over(here).alias("follow"))
    seen = seen.join(successors, "_block", "left")
    seen = seen.select("d.*", F.coalesce("follow", "head.text").alias("next_text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    seen = seen.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    seen = seen.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("text")).alias("own"),
        vector(F.col("edited")).alias("changed"), vector(F.col("next_text")).alias("following"),
    )
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", to_string(F.col("own")).alias("fingerprint"),
        to_string(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
