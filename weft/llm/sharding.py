"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Members of one group that are in one
shard are interchangeable, so the state is cells (group, shard, count), never
links. In each round every group looks at where its members are: the shard that
holds most of them is the label of the others. Movers go there as far as the
shard's quota, the room for linked documents at even sizes, allows; where more
want to come than fit, every cell sends the same share, so a group that holds a
third of all rows moves in part. Unlinked documents have no wish; they make
room. In the end slots are counted, and the rows that stand beyond a shard's
even size, unlinked ones first, fill the places that others have left.

The law is `rows`: the shards' counts differ by one at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.common import cut, numbered, settle, table

ROUNDS = 6
#: Documents to a chunk of the slot count, and members of the largest group that a chunk holds whole.
CHUNK, WHOLE = 4096, 256


def _pick(shards: int, values: list[int], key: Column) -> Column:
    """The value of the shard that key has: a CASE over the few shards."""
    return reduce(lambda rest, s: F.when(key == s, F.lit(int(values[s]))).otherwise(rest), range(shards), F.lit(0)).cast("long")


def propagate(cells: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, shard, n) after the rounds: members move to the shard that holds most of their group, within the quotas; where more would come than a shard takes, the groups that are left look to the others in the next round."""
    full: list[int] = []
    for step in range(rounds):
        best = cells.groupBy("g").agg(F.max(F.struct(F.when(F.col("shard").isin(full), 0).otherwise(F.col("n")).alias("n"), F.xxhash64("g", "shard", F.lit(step)).alias("tie"), F.col("shard").alias("to"))).alias("best"))
        wish = settle(cells.join(best, "g").select("g", "shard", "n", F.col("best.to").alias("to")))
        tally = {(r["shard"], r["stays"]): r["n"] for r in wish.groupBy(F.col("to").alias("shard"), (F.col("shard") == F.col("to")).alias("stays")).agg(F.sum("n").alias("n")).collect()}  # two rows a shard
        if not any(n for (_, stays), n in tally.items() if not stays):
            return cells
        shares = [min(1.0, max(0, capacity - tally.get((s, True), 0)) / max(1, tally.get((s, False), 0))) for s in range(shards)]
        full = [s for s in range(shards) if shares[s] < 1]
        share = reduce(lambda rest, s: F.when(F.col("to") == s, F.lit(shares[s])).otherwise(rest), range(shards), F.lit(0.0))
        # Small cells move whole or not at all, and all of a group alike: a hash of the group says which, so that many groups come to the share on the whole.
        luck = (F.pmod(F.xxhash64("g", "to", F.lit(step)), F.lit(1 << 20)) + 0.5) / (1 << 20)
        part = F.when(F.col("n") <= WHOLE, F.when(luck < share, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor(F.col("n") * share + luck)))
        moved = F.when(F.col("shard") == F.col("to"), F.lit(0)).otherwise(part).cast("long")
        sent = wish.withColumn("moved", F.when(share >= 1, F.when(F.col("shard") == F.col("to"), F.lit(0)).otherwise(F.col("n"))).otherwise(moved).cast("long"))
        cells = sent.select("g", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("x")).where("x.n > 0").groupBy("g", "x.shard").agg(F.sum("x.n").alias("n"))
    return cells


def shard(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """rid, doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text has size 1 and the crc32 of an empty one, and is linked with
    empty texts; null or repeated ids are rows like others; an empty table
    gives an empty result; only doc_id and text are read. Which of a group's
    members go to which of its shards is settled by a hash of the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = numbered(
        docs, "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")
    ).withColumn("u", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(1 << 40)))
    rows = cut(rows)
    total = rows.count()
    start = F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")
    linked = rows.groupBy("g", start.alias("shard")).agg(F.count("*").alias("n"))
    many = linked.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    cells = propagate(settle(linked.join(many, "g")), shards, -(-total // shards), rounds)

    # A group's shards as an array of upper bounds: a member's hash says which of them it goes to.
    spread = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"), F.sum("n").alias("all"))  # as many parts as shards at most
    unit = (F.col("u") % (1 << 30)) / (1 << 30) * F.col("all")
    fold = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("shard")), lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when((a["shard"] < 0) & (unit < a["sum"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")))
    placed = rows.join(spread, "g", "left").select("rid", "doc_id", "size", "text_crc32", "u", F.when(F.col("all").isNull(), 2).when(F.col("all") <= WHOLE, 1).otherwise(0).alias("kind"), "g", F.coalesce(F.when(F.col("all").isNotNull(), fold["shard"]), start).alias("shard"))

    # Slots, as numbers within chunks and the chunks' offsets. Large groups come first, then the others, each whole, then
    # unlinked rows: what is beyond a shard's even size is taken from the end, so few groups are cut in two there.
    chunks = max(1, total // CHUNK)
    placed = cut(placed.withColumn("chunk", F.pmod(F.when(F.col("kind") == 1, F.xxhash64("g", F.lit(7))).otherwise(F.xxhash64("u", F.lit(7))), F.lit(chunks))))
    counts = placed.groupBy("shard", "kind", "chunk").agg(F.count("*").alias("n"))
    group = counts.groupBy("shard", F.floor(F.col("chunk") / CHUNK).alias("block"), "kind").agg(F.sum("n").alias("block_n"))
    blocks = group.withColumn("before", F.coalesce(F.sum("block_n").over(W.partitionBy("shard").orderBy("kind", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = (
        counts.withColumn("block", F.floor(F.col("chunk") / CHUNK)).withColumn("within", F.coalesce(F.sum("n").over(W.partitionBy("shard", "kind", "block").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(blocks, ["shard", "kind", "block"]).select("shard", "kind", "chunk", (F.col("before") + F.col("within")).alias("offset"))
    )
    number = F.row_number().over(W.partitionBy("shard", "kind", "chunk").orderBy(F.when(F.col("kind") == 1, F.col("g")), "doc_id", "rid"))
    slotted = placed.withColumn("number", number).join(offsets, ["shard", "kind", "chunk"]).withColumn("slot", F.col("offset") + F.col("number") - 1)

    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    have = [held.get(s, 0) for s in range(shards)]
    order = sorted(range(shards), key=lambda s: (-have[s], s))
    even = [0] * shards
    for rank, s in enumerate(order):
        even[s] = total // shards + (rank < total % shards)
    over = [max(0, h - e) for h, e in zip(have, even, strict=True)]
    before = [sum(over[:s]) for s in range(shards)]
    surplus = F.col("slot") - _pick(shards, even, F.col("shard"))
    place, target, slot, taken = F.when(surplus >= 0, surplus + _pick(shards, before, F.col("shard"))), F.col("shard"), F.col("slot"), 0
    for s in range(shards):
        if room := max(0, even[s] - have[s]):
            here = place.isNotNull() & (place >= taken) & (place < taken + room)
            target, slot, taken = F.when(here, F.lit(s)).otherwise(target), F.when(here, place - taken + have[s]).otherwise(slot), taken + room
    return slotted.select("rid", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), target.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop("rid")
