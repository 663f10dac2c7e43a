"""Sharding over fixed virtual slots (operator 9), in DataFrame and SQL functions only.

Records hash (doc_id and text) into a fixed number of slots; bytes are summed per slot; a versioned slot-to-shard map says where each
slot lives. Rebalancing edits the map: a slot stays at home while its shard has room, else it moves to the least
loaded shard, larger slots first. The law that holds is `bytes`: shard sizes are near equal.

Defined cases: null text counts no bytes; a null doc_id is a value like any other, and rows that share a doc_id spread
by their texts; equal rows share a virtual slot and get different positions; very long texts are whole, one slot each at least; an empty table gives an empty result and a map in which every slot is at home; columns
besides doc_id and text are not read, whatever their names. The maximum that a shard exceeds the mean by is one slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import materialise, table

N_SLOTS = 8192
N_SHARDS = 40
OVERHEAD_BYTES = 16


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    slots = records.sparkSession.range(0, n_slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(sums, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"), F.coalesce("r", F.lit(0)).cast("long").alias("rows")
    )


def initial_map(spark: SparkSession, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return spark.range(0, n_slots, 1, 1).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The map's next version over n_shards shards: one row holds the fixed number of slots and folds over them.

    A slot keeps its shard while that shard stays within the mean; the others, in order of falling size, go to the
    shard with the fewest bytes. Growing the shard count is the same edit: the new shard starts empty."""
    largest_first = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot"), F.col("shard").alias("home"))))
    one = slot_map.join(sizes, "virtual_slot").agg(
        largest_first.alias("slots"), F.ceil(F.sum("bytes") / F.lit(n_shards)).cast("long").alias("mean"), F.max("version").alias("version")
    )
    edit = f"""
        aggregate(
          slots,
          named_struct('loads', array_repeat(0L, {n_shards}), 'placed', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
          (s, x) -> transform(
            array(if(x.home < {n_shards} and element_at(s.loads, x.home + 1) - x.minus <= mean,
                     x.home, cast(array_position(s.loads, array_min(s.loads)) as int) - 1)),
            to -> named_struct(
              'loads', transform(s.loads, (l, i) -> if(i = to, l - x.minus, l)),
              'placed', concat(s.placed, array(named_struct('virtual_slot', x.slot, 'shard', to)))))[0],
          s -> s.placed)"""
    return one.select((F.col("version") + 1).alias("version"), F.explode(F.expr(edit)).alias("p")).select("version", "p.virtual_slot", "p.shard")


def place(records: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shard and gapless position in the shard of every record. The map has n_slots rows, a constant, so it is sent to
    all tasks; positions count within virtual slots, so no task orders a whole shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("rank", F.row_number().over(within).cast("long"))
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("rank") - 1).drop("start", "rank")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards by the stored, rebalanced map."""
    records = slotted(table(spark, sf_dir, "documents"))
    sizes = materialise(slot_bytes(records), "slot-bytes")
    first = initial_map(spark)
    versions = materialise(first.unionByName(rebalance(first, sizes, N_SHARDS)), "slot-map")
    placed = place(records, versions.where("version = 1").drop("version"), sizes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


QUERIES = {"op9_virtual_slots": op9_virtual_slots}
ORACLES: dict[str, str] = {}
