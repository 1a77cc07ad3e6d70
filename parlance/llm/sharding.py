"""Balanced label propagation of linked documents over a fixed number of shards.

Documents with equal texts are linked. What a group of them holds in each shard is a cell (group,
shard, n). Every document starts in the shard of its hash. In each round a join gives each group
the shard where most of its documents are (its neighbours' shard), and its other cells ask to move
there; requests are granted, larger groups first, until the shard's quota is used up. Groups whose
shard is full turn to the fullest of their shards with room left, or to another with room. Rounds
end when nothing asks to move or no request is granted. Then the documents without links fill every
shard up to its exact size, so that counts differ by one at most.

A group larger than a shard is spread, and no step gathers a group, a shard or the table in one
task: ranks are counted within salted parts, and offsets of parts are summed beside them.

Defined results: a null text has size 16 and CRC of the empty text, and is linked to other null or
empty texts; repeated rows are placed each for itself; groups that tie for a shard go by their keys,
rows of a group by doc_id; a very long text is one row as any other, however large; an empty table gives
no row; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, with_ids

SHARDS = 40
#: Parts in which rows of one group or one shard are numbered.
PARTS = 1024
ROUNDS = 8


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with nth, their number from 0 within key: within each salted part first, then parts are offset."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    sizes = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(key, "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    return rows.withColumn("nth", within).join(offsets, [key, "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")


def _home(first: int, shards: int) -> Column:
    return F.pmod(F.xxhash64("group", F.lit(first)), F.lit(shards)).cast("int")


def propagate(cells: DataFrame, quota: dict[int, int], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """cells (group, shard, n) after balanced moves; the documents in a shard never exceed its quota."""
    shards = len(quota)
    for _ in range(rounds):
        used = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = {s: quota[s] - used.get(s, 0) for s in quota}
        free = F.create_map(*[F.lit(x) for s in sorted(room) for x in (s, room[s])])
        open_ = sorted(s for s in room if room[s] > 0)
        if not open_:
            break
        spare = F.element_at(F.array(*[F.lit(s) for s in open_]), F.pmod(F.xxhash64("group"), F.lit(len(open_))).cast("int") + 1)
        over = F.greatest(F.lit(0), -F.element_at(free, F.col("shard")))
        totals = cells.groupBy("group").agg(F.sum("n").alias("total"), F.max(F.struct("n", F.xxhash64("group", "shard"), "shard")).getField("shard").alias("most"), F.max(F.when(F.element_at(free, F.col("shard")) > 0, F.struct("n", F.xxhash64("group", "shard"), "shard"))).getField("shard").alias("fit"))
        asks = cells.join(totals, "group").withColumn("to", F.when(F.col("shard") != F.col("most"), F.when(F.element_at(free, F.col("most")) > 0, F.col("most")).otherwise(F.coalesce("fit", spare))).when(over > 0, F.coalesce(F.when(F.col("fit") != F.col("shard"), F.col("fit")), spare)))
        # a cell in its group's main shard leaves only if the shard is over its quota
        moves = asks.where("to is not null and to <> shard")
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("to").orderBy(F.desc("total"), "group", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        granted = moves.withColumn("granted", F.greatest(F.lit(0), F.least("n", F.element_at(free, F.col("to")) - ahead)))
        granted = scratch.save(granted.where("granted > 0").select("group", "shard", "to", "granted"))
        if granted.isEmpty():
            break
        change = granted.select("group", "shard", (-F.col("granted")).alias("n")).unionByName(granted.select("group", F.col("to").alias("shard"), F.col("granted").alias("n")))
        cells = scratch.save(cells.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return cells


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.save(with_ids(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("group")))
    total = rows.count()
    target = {s: total // shards + (s < total % shards) for s in range(shards)}
    order = ["group", "doc_id", "size", "text_crc32"]
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    linked_groups = scratch.save(sizes.where("members > 1"))
    linked = rows.join(linked_groups, "group", "left_semi")
    alone = rows.join(linked_groups, "group", "left_anti")

    start = linked.groupBy("group", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(scratch.save(start), target, scratch)
    # what a shard got beyond its size, if rounds ended early, is dealt out with the unlinked documents
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = cells.select("group", "shard", upto.alias("upto"), (upto - F.col("n")).alias("from"))
    placed = _numbered(linked, "group", order).join(ranges, "group").where("nth >= `from` and nth < upto").select("doc_id", "size", "text_crc32", "group", "shard")
    placed = scratch.save(_numbered(placed, "shard", order))

    # one number a shard: how many of its places linked documents take
    taken = {r["shard"]: min(r["n"], target[r["shard"]]) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, target[s])])
    stay = placed.where(F.col("nth") < F.element_at(keep, F.col("shard")))
    rest = alone.select(*order).unionByName(placed.where(F.col("nth") >= F.element_at(keep, F.col("shard"))).select(*order))
    rest = _numbered(rest.withColumn("all", F.lit(0)), "all", order) if total else rest.withColumn("nth", F.lit(0))
    bounds, n = [], 0
    for s in range(shards):
        n += target[s] - taken.get(s, 0)
        bounds.append(n)
    into = F.lit(None).cast("int")
    first = F.lit(None).cast("long")
    for s in reversed(range(shards)):
        into = F.when(F.col("nth") < bounds[s], s).otherwise(into)
        first = F.when(F.col("nth") < bounds[s], taken.get(s, 0) - (bounds[s - 1] if s else 0)).otherwise(first)
    filled = rest.select("doc_id", "size", "text_crc32", into.alias("shard"), (F.col("nth") + first).cast("long").alias("slot"))
    return stay.select("doc_id", "size", "text_crc32", "shard", F.col("nth").cast("long").alias("slot")).unionByName(filled)


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
