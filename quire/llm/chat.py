"""Chat formatting with every participant in turn as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store

START, END = "<|im_start|>", "<|im_end|>"


def _name(speaker: Column) -> Column:
    """A speaker as a user name: letters, digits, dot, dash and underscore."""
    return F.regexp_replace(speaker, r"[^\p{L}\p{N}._-]", "_")


def _slices(said: DataFrame, slice_rows: int, store: Store) -> DataFrame:
    """(conv_id, part, slice, messages): each part in order of turn, speaker and text, ``slice_rows`` messages a slice.

    Equal messages are one row with their number, which is cut where a slice ends. Rows
    are numbered within blocks, ranges of the order, and the blocks' sizes give each its start.
    """
    part, order = ["conv_id", "part"], ["turn", "speaker", "text"]
    counted = store.save(said.groupBy(*part, *order).agg(F.count("*").alias("times")), "messages")
    blocked = store.save(counted.repartitionByRange(*part, *order).withColumn("block", F.spark_partition_id()), "blocks")
    sizes = blocked.groupBy(*part, "block").agg(F.sum("times").alias("size"))
    ahead = lambda w, by: w.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("size").over(ahead(Window.partitionBy(*part), ["block"])), F.lit(0)))
    starts = store.save(sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "start"), "starts")
    here = F.coalesce(F.sum("times").over(ahead(Window.partitionBy(*part, "block"), order)), F.lit(0))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))
    placed = blocked.withColumn("here", here).join(starts, same).withColumn("at", F.col("start") + F.col("here"))
    end = F.col("at") + F.col("times")
    number = lambda x: F.floor(x / slice_rows)
    cut = placed.select(*part, *order, "at", end.alias("end"), F.explode(F.sequence(number(F.col("at")), number(end - 1))).alias("slice"))
    held = F.least("end", (F.col("slice") + 1) * slice_rows) - F.greatest("at", F.col("slice") * slice_rows)
    rows = cut.groupBy(*part, "slice").agg(F.array_sort(F.collect_list(F.struct(*order, held.cast("int").alias("held")))).alias("rows"))
    one = lambda m: F.struct(*[m[c].alias(c) for c in order])
    return rows.select(*part, "slice", F.flatten(F.transform("rows", lambda m: F.array_repeat(one(m), m["held"]))).alias("messages"))


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
    part_turns: int = 64,
    slice_rows: int = 4096,
) -> DataFrame:
    """One row per conversation, participant and part, with text and loss mask.

    For every speaker other than ``system`` the dialogue is rendered with that
    speaker as ``assistant`` and all others as named users; system messages stay
    as they are. ``mask`` lists the spans (start, end; code points of this
    part's text) that bear loss: the participant's own words and their end
    marker. A part holds ``part_turns`` turn numbers, so a dialogue of any length
    is spread over many rows; ``start_char`` says where the part begins, and the
    parts' texts, joined in order of (part, slice), are the whole rendering.

    Messages are ordered by turn, speaker and text, repeated ones all stay. A
    null turn comes first (part -1), a null speaker is ``unknown``, a null text is
    empty, a null conversation is one of its own. Markers inside a text are
    broken with an underscore. More than ``slice_rows`` messages under the turn
    numbers of one part (many repeats) are cut into slices of so many, in their
    order. A conversation of system messages only has no participant and gives
    no row.
    """
    said = turns.select(
        F.col(conversation).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<|_im_")).alias("text"),
    )
    crowded = said.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > slice_rows)
    store = Store(turns.sparkSession, "chat")
    crowded = store.save(crowded.select(F.col("conv_id").alias("c"), F.col("part").alias("p")), "crowded")
    full = said["conv_id"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    message = F.struct("turn", "speaker", "text")
    calm = said.join(crowded, full, "left_anti").groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    calm = calm.select("conv_id", "part", F.lit(0).cast("long").alias("slice"), "messages")
    parts = calm.unionByName(_slices(said.join(crowded, full, "left_semi"), slice_rows, store))
    people = said.filter(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def head(m: Column) -> Column:
        return F.when(m["speaker"] == system, START + "system\n").when(
            m["speaker"] == F.col("perspective"), START + "assistant\n"
        ).otherwise(F.concat(F.lit(START + "user name="), _name(m["speaker"]), F.lit("\n")))

    drawn = seen.withColumn(
        "drawn",
        F.transform("messages", lambda m: F.struct(
            head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"),
            (m["speaker"] == F.col("perspective")).alias("own"),
        )),
    )
    drawn = drawn.withColumn("sizes", F.transform("drawn", lambda d: F.length(d["head"]) + F.length(d["body"]) + 1))
    drawn = drawn.withColumn(
        "places",
        F.transform("drawn", lambda d, i: F.struct(
            d["own"].alias("own"), F.length(d["head"]).alias("head"), F.length(d["body"]).alias("body"),
            F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda s, x: s + x).alias("at"),
        )),
    )
    done = drawn.select(
        "conv_id", "perspective", "part", "slice",
        F.array_join(F.transform("drawn", lambda d: F.concat(d["head"], d["body"], F.lit("\n"))), "").alias("text"),
        F.transform(
            F.filter("places", lambda p: p["own"]),
            lambda p: F.struct((p["at"] + p["head"]).alias("start"), (p["at"] + p["head"] + p["body"]).alias("end")),
        ).alias("mask"),
        F.size("messages").cast("long").alias("n_messages"),
    )
    done = done.withColumn("n_chars", F.length("text").cast("long"))
    order = Window.partitionBy("conv_id", "perspective").orderBy("part", "slice").rowsBetween(Window.unboundedPreceding, -1)
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + m["end"] - m["start"])
    return done.withColumns({"n_loss_chars": loss, "start_char": F.coalesce(F.sum("n_chars").over(order), F.lit(0))})
