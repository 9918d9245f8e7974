"""Shards by jump consistent hashing, in SQL expressions alone.

A key walks up the shard numbers in jumps whose lengths a 64-bit congruential generator seeded with the key decides;
the last jump that stays below the shard count is the shard. Appending a shard moves 1/n of the keys, all into it.

Defined results: a null key is shard 0; null text has size 1 and checksum 0; repeated rows all get a slot each; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator, a fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Buckets in which a shard's rows are numbered: three hex digits of a digest.
BUCKETS = 4096


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64 without overflow: 16- and 32-bit limbs of long."""
    c, d = MULTIPLIER & LOW, MULTIPLIER >> 32
    lo, hi = key.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(key, 32)
    lo0, lo1 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftright(lo, 16)
    hi0, hi1 = hi.bitwiseAND(F.lit(0xFFFF)), F.shiftright(hi, 16)
    t0, t1 = lo0 * F.lit(c), lo1 * F.lit(c)
    low = t0.bitwiseAND(F.lit(LOW)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = lambda a0, a1, m: (a0 * F.lit(m)).bitwiseAND(F.lit(LOW)) + F.shiftleft((a1 * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(t0, 32) + F.shiftright(t1, 16) + F.shiftright(low, 32) + cross(lo0, lo1, d) + cross(hi0, hi1, c)
    return F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int) of a long key among so many shards; null is 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(s: Column, _: Column) -> Column:
        n = _next(s["key"])
        ahead = F.floor((s["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(n, 33) + 1).cast("double")))
        done = s["to"] >= shards
        return F.struct(F.when(done, s["key"]).otherwise(n).alias("key"), F.when(done, s["at"]).otherwise(s["to"]).alias("at"), F.when(done, s["to"]).otherwise(ahead).alias("to"))

    start = F.struct(F.coalesce(key.cast("long"), F.lit(0)).cast("long").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    # Each jump goes up by one at least: shards + 1 steps always end the walk.
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard_table(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Slots run from 0 in each shard without gaps. They are dealt in two levels: rows are numbered within small buckets
    (a digest of doc_id and checksum), and a bucket starts where those before it in its shard end; so no task
    holds a whole shard. Only ids, sizes and checksums are shuffled, never texts. A slot depends on the rows alone, not
    on how they are partitioned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1), "bucket": F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 3), 16, 10).cast("int"), F.lit(buckets))})
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["bucket", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
