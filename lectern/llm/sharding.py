"""Sharding by fixed virtual slots (native).

Records hash into a fixed number of virtual slots.  Only the slots are weighed and placed:
bytes and rows are summed per slot, and a versioned map says which shard holds which slot.
A new version is made by editing the last one, so few slots move.

Law ``bytes``: the map balances the bytes of the shards.  Equal texts are not kept together
(their group may hold a third of all rows); the record's id and checksum choose its slot.

Defined results: a null or empty text weighs one byte; null ids are ids like others;
repeated rows are all placed; an empty table gives an empty result and a map of empty slots.
Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: all that placing needs, one scan of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return narrow.withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def weigh(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included: ``slots`` rows."""
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    held = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return every.join(held, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _deal(pool: Column, loads: Column) -> Column:
    """Fold over slots, heaviest first: each goes to the shard with the least bytes so far."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"))

    def put(acc: Column, slot: Column) -> Column:
        best = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == best - 1, v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.array_append(acc["placed"], F.struct(slot["virtual_slot"].alias("virtual_slot"), (best - 1).alias("shard"))).alias("placed"),
        )

    return F.aggregate(pool, start, put)["placed"]


def _pool(weights: DataFrame) -> DataFrame:
    """One row: the slots to place, heaviest first.  Never longer than the number of slots."""
    heavy_first = F.sort_array(F.collect_list(F.struct(
        (-F.col("bytes")).alias("order"), F.col("virtual_slot"), F.col("bytes"))))
    return weights.agg(heavy_first.alias("pool"))


def first_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, virtual_slot, shard."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = _pool(weights).select(F.explode(_deal(F.col("pool"), zero)).alias("p"))
    return placed.select(F.lit(1).alias("version"), "p.virtual_slot", "p.shard")


def edit_map(old: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for new weights or more shards.

    Each shard keeps slots, in slot order, up to its fair share of the bytes; only the rest
    moves, to the shards with the least bytes.  Slots of shards that no longer exist move.
    """
    share = F.sum("bytes").over(W.partitionBy()) / shards
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, 0))
    marked = old.join(weights, "virtual_slot").select(
        "version", "virtual_slot", "shard", "bytes",
        ((F.col("shard") < shards) & (running <= share)).alias("stays"))
    kept = marked.where("stays")
    by_shard = old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(
        kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard", "left").fillna(0, ["bytes"])
    loads = by_shard.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "bytes"))), lambda s: s["bytes"]).alias("loads"))
    # One row beside one row: the slots that move and what the shards already hold.
    both = _pool(marked.where("not stays")).withColumn("one", F.lit(1)).join(loads.withColumn("one", F.lit(1)), "one")
    moved = both.select(F.explode(_deal(F.col("pool"), F.col("loads"))).alias("p")).select("p.virtual_slot", "p.shard")
    version = old.agg((F.max("version") + 1).alias("version")).withColumn("one", F.lit(1))
    placed = kept.select("virtual_slot", "shard").unionByName(moved).withColumn("one", F.lit(1))
    return placed.join(version, "one").select("version", "virtual_slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Keep every version; a version is written once, under its own partition."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the last one unless named."""
    stored = spark.read.parquet(path)
    if version is not None:
        return stored.where(F.col("version") == version)
    last = stored.agg(F.max("version").alias("version"))
    return stored.join(F.broadcast(last), "version")


def place(recs: DataFrame, slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Every record with its shard and its gapless position in the shard.

    A position is the number of rows in the shard's earlier slots, known from the weights,
    plus the rank within the slot, so no task holds more than one slot's rows.  The map and
    the weights have one row per slot, a fixed number, and are broadcast.
    """
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slot_map.join(weights, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return recs.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "virtual_slot")
