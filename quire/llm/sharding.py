"""Balanced label propagation: linked documents gather in shards, under exact quotas of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, ranked

#: A group of more than this share of a quota is placed by itself, before the others.
BIG_SHARE = 8
BLOCKS = 1024


def quotas(rows: int, shards: int) -> list[int]:
    """Rows that each shard gets: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def spread_big(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, list[int], list[int]]]:
    """(group, shards, cumulative rows) for big groups, largest first; ``room`` shrinks.

    A group goes whole into the shard with most room; one that fits nowhere
    fills shard after shard.
    """
    placed = []
    for group, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        shards, ends, left = [], [], n
        while left:
            s = max(range(len(room)), key=lambda x: (room[x], -x))
            taken = min(left, room[s])
            room[s] -= taken
            left -= taken
            shards.append(s)
            ends.append(n - left)
        placed.append((group, shards, ends))
    return placed


def propagate(cells: DataFrame, room: list[int], store: Store, rounds: int) -> tuple[DataFrame, list[int]]:
    """Move the members of every group towards one shard, round by round.

    ``cells`` (g, shard, n) counts a group's members by shard, the state of the
    propagation; neighbours are the other members. In a round each group that is
    spread prefers the shard that holds most of it among those with room for
    the rest. Per shard, requests are taken in blocks of a hash until its room is
    used up; the others wait for the room that moving away leaves. Ends when no
    group is spread or nothing moved. Returns the cells and the room left.
    """
    shards = len(room)
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [room[s] - held.get(s, 0) for s in range(shards)]
        there = Window.partitionBy("g")
        spread = cells.withColumns({"size": F.sum("n").over(there), "parts": F.count("*").over(there)}).filter("parts > 1")
        need = F.col("size") - F.col("n")
        open_room = F.get(F.lit([max(0, f) for f in free]).cast("array<bigint>"), F.col("shard"))
        wish = F.max(F.struct((need <= open_room).alias("fits"), "n", F.xxhash64(F.lit(turn), "g", "shard").alias("tie"), "shard", "size"))
        wishes = spread.groupBy("g").agg(wish.alias("wish")).filter("wish.fits")
        wishes = wishes.select("g", F.col("wish.shard").alias("to"), F.col("wish.size").alias("size"), (F.col("wish.size") - F.col("wish.n")).alias("need"))
        wishes = store.save(wishes.withColumn("block", F.pmod(F.xxhash64(F.lit(-1 - turn), "g"), F.lit(BLOCKS))), f"wishes{turn}")
        asked = wishes.groupBy("to", "block").agg(F.sum("need").alias("need"))
        so_far = Window.partitionBy("to").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        granted = asked.withColumn("sum", F.sum("need").over(so_far))
        granted = granted.filter(F.col("sum") <= F.get(F.lit([max(0, f) for f in free]).cast("array<bigint>"), F.col("to")))
        moved = wishes.join(granted.select("to", "block"), ["to", "block"], "left_semi").select("g", F.col("to").alias("shard"), F.col("size").alias("n"))
        moved = store.save(moved, f"moved{turn}")
        if moved.isEmpty():
            break
        cells = store.save(cells.join(moved, "g", "left_anti").unionByName(moved), f"cells{turn}")
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return cells, [room[s] - held.get(s, 0) for s in range(shards)]


def _settle(cells: DataFrame, room: list[int], store: Store) -> tuple[DataFrame, list[int]]:
    """Cells within the room of each shard: where first labels overfill one, whole blocks of cells go to those with room."""
    for turn in range(20):
        held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [room[s] - held.get(s, 0) for s in range(len(room))]
        if min(free) >= 0:
            break
        cells = cells.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "g"), F.lit(BLOCKS)))
        sums = cells.groupBy("shard", "block").agg(F.sum("n").alias("sum"))
        moves = []
        for s, rows in _by_shard(sums.collect()).items():
            for block, n in rows:
                if free[s] >= 0:
                    break
                to = max(range(len(room)), key=lambda x: free[x])
                moves.append((s, block, to))
                free[s] += n
                free[to] -= n
        table = cells.sparkSession.createDataFrame(moves, "shard int, block bigint, to int")
        cells = cells.join(F.broadcast(table), ["shard", "block"], "left")
        cells = cells.groupBy("g", F.coalesce("to", "shard").alias("shard")).agg(F.sum("n").alias("n"))
        cells = store.save(cells, f"settled{turn}")
    return cells, free


def _by_shard(rows: list) -> dict[int, list[tuple[int, int]]]:
    """Block sums by shard, at most shards x BLOCKS of them; the smallest first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["sum"], r["block"])):
        out.setdefault(r["shard"], []).append((r["block"], r["sum"]))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 10) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``rows``.

    Documents with equal texts are linked; a null text counts as empty but has
    size 8 either way. Shard sizes are at most one row apart. Groups of more
    than an eighth of a quota (fewer than 8 x ``shards``) are placed first, split
    only if no shard has room for all of one. All others start from hashed labels and
    gather by label propagation; unlinked documents fill what is left. Slots
    number a shard's rows from 0. Rows that repeat an id are rows like others.
    """
    store = Store(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )
    slim = store.save(slim, "documents")
    rows = slim.count()
    room = quotas(rows, shards)
    counted = slim.groupBy("g", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("of", F.sum("n").over(Window.partitionBy("g"))).filter("of > 1")
    counted = store.save(counted, "cells")
    limit = max(1, rows // shards // BIG_SHARE)
    big = counted.filter(F.col("of") > limit).select("g", "of").distinct()  # fewer than 8 x shards by the limit
    placed = spread_big([(bytes(r["g"]), r["of"]) for r in big.collect()], room)
    cells = counted.filter(F.col("of") <= limit).select("g", "shard", "n")
    cells, _ = _settle(cells, room, store)
    cells, free = propagate(cells, room, store, rounds)

    # The plan: shards of a group, and how many of its rows have gone when each is full.
    plan = "g binary, to array<int>, ends array<bigint>"
    big_plan = docs.sparkSession.createDataFrame(placed, plan)
    one = F.sort_array(F.collect_list(F.struct("shard", "n")))
    small_plan = cells.groupBy("g").agg(one.alias("c")).select(
        "g", F.col("c.shard").alias("to"),
        F.transform("c", lambda x, i: F.aggregate(F.slice("c", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["n"])).alias("ends"),
    )
    known = slim.join(F.broadcast(big_plan.withColumnsRenamed({"to": "big_to", "ends": "big_ends"})), "g", "left")
    # Rows of big groups look up a key of their own, so that they do not meet in one task.
    look = F.when(F.col("big_to").isNull(), F.col("g")).otherwise(F.unhex(F.md5(F.concat_ws("|", F.lit("big"), "doc_id", "text_crc32"))))
    known = known.withColumn("look", look).join(small_plan.withColumnRenamed("g", "look"), "look", "left")
    known = known.select(
        "doc_id", "size", "text_crc32", "g", F.coalesce("big_to", "to").alias("to"), F.coalesce("big_ends", "ends").alias("ends"),
    )
    ends, total = [], 0
    for f in free:
        total += f
        ends.append(total)
    known = known.withColumns({
        "queue": F.when(F.col("to").isNull(), F.lit("").cast("binary")).otherwise(F.col("g")),
        "to": F.coalesce("to", F.lit(list(range(shards)))), "ends": F.coalesce("ends", F.lit(ends).cast("array<bigint>")),
    })
    known = store.save(known.drop("g"), "planned")
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-rows // 2000))))
    order = ["doc_id", "text_crc32", "size"]
    numbered = ranked(known, ["queue"], order, block, "place", store)
    chosen = F.get("to", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    sharded = store.save(numbered.select(*order, chosen.alias("shard")), "sharded")
    return ranked(sharded, ["shard"], order, block, "slot", store).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
