"""What several operators of this subpackage share: places to write, Arrow streams, global ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from ..sources.storage import discard, scratch_path, shared_dir, written

__all__ = ["discard", "joined_small", "joined_spread", "map_batches", "ranked", "scratch_path", "shared_dir", "shuffle_partitions", "small_batches", "text_bytes", "written"]

#: Rows of one Arrow batch; keeps a Python worker's memory small when texts are long.
BATCH_ROWS = 512
#: Tables of at most this many (small) rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text that are broadcast, at most.
BROADCAST_BYTES = 16 << 20
#: Fields of eight bytes that a row of such a table may have; of narrower rows as many more are broadcast.
BROADCAST_FIELDS = 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, and so the memory of a Python worker, for this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _give_back() -> None:
    """Returns the memory of a finished task to the system: the worker lives on, and its peak would stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        gc.disable()  # many small objects live through a task, which the collector would visit again and again
        try:
            yield from function(batches)
        finally:
            gc.enable()
            _give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def joined_small(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join with a written table, broadcast only if its counted rows are few. right's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    if right.count() <= most:
        renamed = F.broadcast(renamed)
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


#: A key that holds over one row in so many is hot: there are fewer such keys than this number. Their rows are dealt out
#: over as many parts as they fill shares of that size.
HOT_SHARE = 1000
#: No key of fewer rows is hot.
HOT_ROWS = 1000


def _broadcast_rows(schema: StructType) -> int:
    """BROADCAST_ROWS, or more where all fields have a fixed size and there are few."""
    fields, left = 0, [f.dataType for f in schema.fields]
    while left:
        kind = left.pop()
        if isinstance(kind, StructType):
            left += [f.dataType for f in kind.fields]
        elif isinstance(kind, (NumericType, BooleanType)):
            fields += 1
        else:
            return BROADCAST_ROWS
    return BROADCAST_ROWS * max(BROADCAST_FIELDS, fields) // max(1, fields)


def joined_spread(left: DataFrame, right: DataFrame, key: str, other: str, by: str | Column, counted: str | None = None, wide: str | None = None) -> DataFrame:
    """Inner join of left.key with right.other, one row a key on the right; a key with many rows on the left is cut by a hash of by.

    right is broadcast if its counted rows (more of them if narrow), and the bytes of the text column wide if it has one, are few. Else the rows of each hot key are counted, at most HOT_SHARE such counts come to the
    driver, and right's row is repeated for each part. counted: the column of right that has the counts already. right's key is dropped.
    """
    size = right.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length(wide)) if wide else F.lit(0)).alias("bytes")).first()
    if size["n"] <= _broadcast_rows(right.schema) and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), F.col(key) == F.col(other)).drop(other)
    times = right.select(F.col(other).alias("_k"), F.col(counted).alias("_n")) if counted else left.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    times = written(times, "times")
    least = max(HOT_ROWS, (times.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot = {r["_k"]: min(HOT_SHARE, -(-r["_n"] // least)) for r in times.filter(F.col("_n") > least).collect()}
    if not hot:
        return left.join(right, F.col(key) == F.col(other)).drop(other)
    parts = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"_hot {left.schema[key].dataType.simpleString()}, _parts int"))
    left = left.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_hot", "_parts")
    right = right.join(parts, F.col(other) == F.col("_hot"), "left").withColumn("_other_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return left.join(right, (F.col(key) == F.col(other)) & (F.col("_part") == F.col("_other_part"))).drop(other, "_part", "_other_part")


def ranked(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with a gapless 0-based rank within group, in the order of group and then order (nulls first).

    A range shuffle deals out all rows evenly, however large one group is; a group that spans partitions gets the
    sum of its counts in earlier partitions added. Only one row a partition and group meets in the prefix sum.
    Rows equal in group and order get ranks in any order. df should be slim: it is written once.
    """
    keys = [*group, *order]
    n = shuffle_partitions(df.sparkSession)
    laid = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    counts = laid.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("_part", *group, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    out = joined_small(laid, starts, ["_part", *group])
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
