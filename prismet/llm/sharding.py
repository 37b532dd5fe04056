"""Sharding by jump consistent hashing: a key and the shard count decide the shard, without a ring table.

Native: only SQL functions, one shuffle of narrow rows for the slots. The 64-bit generator of the published algorithm
needs products modulo 2**64, which ANSI arithmetic rejects as overflow, so the product is taken in three limbs.

Nulls: a null key counts as key 0, a null text as no bytes. Rows of equal key share a shard and take slots next to each
other. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.llm._ranges import bucket_of, range_bounds
from prismet.llm._stage import default_parts

#: The multiplier of the published generator (a fixed value of the algorithm).
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _next_state(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2**64."""
    limbs = [k.bitwiseAND(F.lit(0x3FFFFF)), F.shiftrightunsigned(k, 22).bitwiseAND(F.lit(0x3FFFFF)), F.shiftrightunsigned(k, 44)]
    factors = [(MULTIPLIER << (22 * i)) % (1 << 64) for i in range(3)]
    low = sum((x * F.lit(f & _LOW) for x, f in zip(limbs, factors, strict=True)), F.lit(1).cast("long"))
    high = sum((x * F.lit(f >> 32) for x, f in zip(limbs, factors, strict=True)), F.shiftrightunsigned(low, 32))
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def jump_shards(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard of a 64-bit key among ``shards``, and among one more.

    A jump goes from b to floor((b + 1) * 2**31 / (r + 1)), r being the top 31 bits of the next state. Jumps only grow,
    so ``shards + 1`` steps of a fold suffice.
    """

    def step(s: Column, _: Column) -> Column:
        nxt = _next_state(s["k"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(nxt, 33) + 1).cast("double"))).cast("long")
        on = s["j"] <= shards
        return F.struct(
            F.when(on, nxt).otherwise(s["k"]).alias("k"),
            F.when(on, jump).otherwise(s["j"]).alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            F.when(on, s["j"]).otherwise(s["grown"]).alias("grown"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(key.cast("long").alias("k"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(out["shard"].cast("int").alias("shard"), out["grown"].cast("int").alias("grown"))


def assign_shards(df: DataFrame, key_col: str, *, shards: int, keep: list[Column] = ()) -> DataFrame:
    """Rows of ``keep`` with ``shard``, ``grown_shard`` and ``slot``, the gapless place in the shard by ascending key.

    Slots: rows fall into key ranges of equal size, the counts of each (range, shard) give its first slot, and a window
    over one (range, shard) numbers its rows. The count table has shards x ranges rows, which bounds its broadcast.
    """
    parts = default_parts(df.sparkSession)
    key = F.coalesce(F.col(key_col).cast("long"), F.lit(0).cast("long"))
    rows = df.select(key.alias("_key"), *keep).withColumn("_at", jump_shards(F.col("_key"), shards))
    rows = rows.select("*", F.col("_at.shard").alias("shard"), F.col("_at.grown").alias("grown_shard")).drop("_at")
    ids = df.select(key.alias("_key"))
    bounds = range_bounds(ids, "_key", parts)
    rows = rows.withColumn("_range", bucket_of(F.col("_key"), bounds) if bounds else F.lit(0))
    counted = ids.withColumn("_range", bucket_of(F.col("_key"), bounds) if bounds else F.lit(0)).withColumn("shard", jump_shards(F.col("_key"), shards)["shard"])
    counted = counted.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range", "shard").orderBy("_key", *[c for c in rows.columns if c not in ("_key", "_range", "shard", "grown_shard")])
    numbered = rows.withColumn("_row", F.row_number().over(within)).join(F.broadcast(firsts), ["shard", "_range"])
    return numbered.withColumn("slot", F.col("_first") + F.col("_row") - 1).drop("_key", "_range", "_row", "_first")
