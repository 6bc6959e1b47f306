"""Sharding by vector bin packing: groups of equal texts go where their sizes match the room left best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_small, ranked, small_batches, written
from .mixing import n_words

#: A group of equal texts stays whole up to this share of one shard's capacity; a larger one is cut into lots.
WHOLE_SHARE = 0.5
#: A cut group gets this many lots for each capacity that it fills, and from SPREAD_SHARE on one lot in every shard.
LOTS = 4
SPREAD_SHARE = 4
#: Weights of bytes, tokens and rows in the dot product: the law is equal bytes, the others follow.
WEIGHTS = np.array([64.0, 1.0, 1.0])
#: Lots of at least this share of one shard's capacity, in any measure, are placed first, all together: their
#: number is at most 3 * shards / LARGE_SHARE.
LARGE_SHARE = 1 / 500
#: Smaller lots are placed in blocks of about so many.
BLOCK_LOTS = 20_000


def pack(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bins of the items, in the order given: each goes where its dot product with the room left is highest, of the bins
    that have room for its bytes while there are any.

    vectors: items x measures; room: bins x measures, both as shares of all there is to place; room changes.
    """
    bins = np.empty(len(vectors), dtype=np.int32)
    for i, v in enumerate(vectors):
        score, fits = room @ (v * WEIGHTS), room[:, 0] >= v[0]
        bins[i] = b = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        room[b] -= v
    return bins


def _placed(lots: pd.DataFrame, room: np.ndarray) -> pd.DataFrame:
    lots = lots.sort_values(["bytes", "tokens", "key", "lot"], ascending=[False, False, True, True], kind="stable")
    v = lots[["bytes", "tokens", "rows"]].to_numpy(dtype=np.float64)
    total = v.sum(axis=0)
    scale = np.where(total > 0, total, 1.0)
    return lots.assign(shard=pack(v / scale, room))[["key", "lot", "shard"]]


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """documents -> doc_id, size, text_crc32, tokens, shard, slot: bytes, tokens and rows are balanced jointly.

    Equal texts form a group and stay in one shard unless they hold over WHOLE_SHARE of its capacity; such a group
    is cut into lots by a hash of doc_id. The large lots, bounded in number, are placed on the driver; all others in
    blocks dealt out by a hash, each filling its part of the room that the large ones left.
    Nulls: a null text counts as empty and has no bytes; null doc_ids are kept. Repeated rows are rows of their own;
    slots of rows with equal doc_id are in any order. An empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        n_words().alias("tokens"), F.sha2(text.cast("binary"), 256).alias("key"),
    )
    slim = written(slim, "slim")
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = written(groups, "groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "rows")]).first()
    capacity = {c: max(1.0, whole[c] / shards) for c in ("bytes", "tokens", "rows")}
    share = F.greatest(*[F.col(c) / F.lit(capacity[c]) for c in capacity])
    # At most 3 * shards / WHOLE_SHARE groups are over the limit.
    cut = written(groups.filter(share > WHOLE_SHARE).select("key", F.when(share > SPREAD_SHARE, F.ceil(share / shards) * shards).otherwise(F.ceil(share * LOTS)).cast("int").alias("lots")), "cut")
    slim = joined_small(slim, cut, ["key"])
    lot = F.when(F.col("lots").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("lots")))
    slim = slim.withColumn("lot", F.coalesce(lot, F.lit(0)).cast("int")).drop("lots")
    lots = slim.groupBy("key", "lot").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    lots = written(lots, "lots")
    small_batches(docs.sparkSession)

    large = lots.filter(share >= LARGE_SHARE).toPandas()
    whole_v = np.array([max(1.0, whole[c]) for c in ("bytes", "tokens", "rows")])
    room = np.full((shards, 3), 1.0 / shards)
    large = large.sort_values(["bytes", "tokens", "key", "lot"], ascending=[False, False, True, True], kind="stable")
    large_bins = pack(large[["bytes", "tokens", "rows"]].to_numpy(dtype=np.float64) / whole_v, room)
    spark = docs.sparkSession
    placed_large = spark.createDataFrame(
        [(k, int(n), int(b)) for k, n, b in zip(large["key"], large["lot"], large_bins)], "key string, lot int, shard int"
    )
    room = np.maximum(room, 0.0)
    left = room / np.where(room.sum(axis=0) > 0, room.sum(axis=0), 1.0)

    rest = lots.filter(share < LARGE_SHARE)
    blocks = max(1, -(-rest.count() // BLOCK_LOTS))
    rest = rest.withColumn("_block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)))
    placed = rest.groupBy("_block").applyInPandas(lambda pdf: _placed(pdf, left.copy()), "key string, lot int, shard int")
    placed = written(placed.unionByName(placed_large), "placed")
    out = slim.join(placed.select(F.col("key").alias("_k"), F.col("lot").alias("_l"), "shard"), (F.col("key") == F.col("_k")) & (F.col("lot") == F.col("_l")))
    out = out.select("doc_id", "size", "text_crc32", "tokens", "shard")
    return ranked(out, ["doc_id"], ["shard"], "slot")


def op2_vector_sharding(spark, sf_dir: str) -> DataFrame:
    sharded = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
