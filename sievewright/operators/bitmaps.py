"""Sets of row ids as bitmaps, one for each bucket of 32,768 ids: (bucket, bm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bucket, position

BUCKET_BITS = 32_768
#: Most bitmaps, of 4 KB each, that every task gets a copy of.
BROADCAST_BUCKETS = 4_000


def from_rids(rids: DataFrame, rid: str = "rid", by: tuple[str, ...] = ()) -> DataFrame:
    return rids.groupBy(*by, bucket(F.col(rid)).alias("bucket")).agg(F.bitmap_construct_agg(position(F.col(rid))).alias("bm"))


def union(*sets: DataFrame) -> DataFrame:
    both = sets[0].select("bucket", "bm")
    for s in sets[1:]:
        both = both.unionByName(s.select("bucket", "bm"))
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bm").alias("bm"))


def intersection(*sets: DataFrame) -> DataFrame:
    """A bucket that one of the sets lacks is empty; an AND over no rows would be full, so buckets are counted."""
    both = sets[0].select("bucket", "bm")
    for s in sets[1:]:
        both = both.unionByName(s.select("bucket", "bm"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bm").alias("bm"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(sets)).drop("_n")


def cardinality(bitmaps: DataFrame) -> Column:
    return F.coalesce(F.sum(F.bitmap_count("bm")), F.lit(0)).cast("long")


def count(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(cardinality(bitmaps).alias("cnt"))


def count_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many ids of left aren't in right: there is no AND NOT, so what both have is taken off."""
    signed = left.select(F.bitmap_count("bm").alias("n")).unionByName(intersection(left, right).select((-F.bitmap_count("bm")).alias("n")))
    return signed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cnt"))


def to_rids(bitmaps: DataFrame, *keep: str) -> DataFrame:
    """The ids in the bitmaps, each a row. Hex digit d of a bitmap holds byte d div 2, high half first; bits count up."""
    digits = bitmaps.select(*keep, "bucket", F.posexplode(F.split(F.hex("bm"), "")).alias("_d", "_h")).filter("_h <> '0' AND _h <> ''")
    value = F.conv("_h", 16, 10).cast("int")
    bits = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.getbit(F.col("_v"), k) == 1)
    out = digits.withColumn("_v", value.cast("long")).withColumn("_k", F.explode(bits))
    place = F.floor(F.col("_d") / 2) * 8 + F.when(F.col("_d") % 2 == 0, 4).otherwise(0) + F.col("_k")
    return out.select(*keep, ((F.col("bucket") - 1) * BUCKET_BITS + place + 1).cast("long").alias("rid"))


def never_broadcast(rids: DataFrame) -> DataFrame:
    """Ids out of bitmaps, for a join: Spark takes them for as large as the bitmaps that they are made from, some 40 times too small."""
    return rids.hint("merge")


def difference_rids(left: DataFrame, right: DataFrame) -> DataFrame:
    return to_rids(left).join(never_broadcast(to_rids(right)), "rid", "left_anti")


def holding(rows: DataFrame, bitmaps: DataFrame, most: int) -> DataFrame:
    """The rows (rid) whose ids are in the bitmaps: rows meet the bitmap of their bucket and test their bit, no id becomes a row.

    most: no more bitmaps than that can come; it decides whether they are broadcast, as their files tell little of their size.
    """
    # Words of 64 bits are read in place, while a binary value would be copied for each row. Hex puts a word's first byte on top.
    word = lambda k: F.conv(F.hex(F.substring(F.col("bm"), k * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = bitmaps.select(F.col("bucket").alias("_bucket"), F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 64 - 1)), word).alias("_words"))
    at = position(F.col("rid")).cast("int")
    bit = F.getbit(F.get("_words", F.shiftright(at, 6)), at.bitwiseAND(63).bitwiseXOR(56))
    words = F.broadcast(words) if most <= BROADCAST_BUCKETS else words.hint("merge")
    return rows.join(words, (bucket(F.col("rid")) == F.col("_bucket")) & (bit == 1), "left_semi")
