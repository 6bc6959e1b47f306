"""Postings: for each value of each key column, the rows that have it.

A row of the dataset is (attno, is_null, key, bucket, card) with the row ids of one bucket either as a bitmap (bm) or,
for columns of many values, where a dense bitmap would be mostly zeros, as an array of positions (pos). Rows are in
order of column and key, so that Parquet's statistics skip what a lookup doesn't need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket, canonical, literal_keys, position
from ..plans.predicates import And, Eq, In, IsNotNull, IsNull

#: Columns of more distinct values than this store positions.
DENSE_VALUES = 2_000
SCHEMA = "attno int, is_null boolean, key string, bucket long, card long, bm binary, pos array<int>"


def extract(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """rows (rid, key columns) -> attno, is_null, key, rid: one row for each key column of each row."""
    entries = F.array(*[F.struct(F.lit(i).alias("attno"), F.col(c).isNull().alias("is_null"), canonical(F.col(c), kind).alias("key")) for i, (c, kind) in enumerate(keys.items(), 1)])
    return rows.select("rid", F.explode(entries).alias("e")).select("e.attno", "e.is_null", "e.key", "rid")


def dense_columns(rows: DataFrame, keys: dict[str, str]) -> list[int]:
    """Numbers of the key columns that get bitmaps."""
    seen = rows.agg(*[F.approx_count_distinct(c).alias(f"_{i}") for i, c in enumerate(keys, 1)]).first()
    return [i for i in range(1, len(keys) + 1) if seen[f"_{i}"] <= DENSE_VALUES]


def build(rows: DataFrame, keys: dict[str, str], dense: list[int]) -> DataFrame:
    """rows (rid, key columns) -> SCHEMA."""
    names = ["attno", "is_null", "key", "bucket"]
    entries = extract(rows, keys).withColumn("bucket", bucket(F.col("rid"))).withColumn("p", position(F.col("rid")))
    is_dense = F.col("attno").isin(dense) if dense else F.lit(False)
    packed = entries.filter(is_dense).groupBy(*names).agg(F.count(F.lit(1)).alias("card"), F.bitmap_construct_agg("p").alias("bm"))
    # At most 32,768 positions are in a bucket.
    listed = entries.filter(~is_dense).groupBy(*names).agg(F.count(F.lit(1)).alias("card"), F.array_sort(F.collect_list(F.col("p").cast("int"))).alias("pos"))
    return packed.withColumn("pos", F.lit(None).cast("array<int>")).unionByName(listed.withColumn("bm", F.lit(None).cast("binary"))).select(*[c.split()[0] for c in SCHEMA.replace("array<int>", "x").split(", ")])


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of both, with one row for each value and bucket. Row ids that both hold count once."""
    both = old.unionByName(new)
    names = ["attno", "is_null", "key", "bucket"]
    packed = both.filter("bm IS NOT NULL").groupBy(*names).agg(F.bitmap_or_agg("bm").alias("bm")).withColumn("card", F.bitmap_count("bm"))
    listed = both.filter("bm IS NULL").groupBy(*names).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos")).withColumn("card", F.size("pos").cast("long"))
    return packed.withColumn("pos", F.lit(None).cast("array<int>")).unionByName(listed.withColumn("bm", F.lit(None).cast("binary"))).select(*old.columns)


def in_order(postings: DataFrame) -> DataFrame:
    return postings.repartitionByRange("attno", "is_null", "key").sortWithinPartitions("attno", "is_null", "key", "bucket")


def as_bitmaps(postings: DataFrame, *by: str) -> DataFrame:
    """(by..., bucket, bm) of postings of either kind, united."""
    dense = postings.filter("bm IS NOT NULL").select(*by, "bucket", "bm")
    sparse = postings.filter("bm IS NULL").select(*by, "bucket", F.explode("pos").alias("_p"))
    sparse = sparse.groupBy(*by, "bucket").agg(F.bitmap_construct_agg(F.col("_p").cast("long")).alias("bm"))
    return dense.unionByName(sparse).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))


def answerable(spark: SparkSession, predicate: And, keys: dict[str, str]) -> bool:
    """Whether every part is over a key column, and compares it in a way that keys can answer."""
    if not predicate.indexable(keys):
        return False
    literals = [(p.column, [p.value] if isinstance(p, Eq) else list(p.values)) for p in predicate.parts if isinstance(p, (Eq, In))]
    return all(literal_keys(spark, values, keys[column]) is not None for column, values in literals)


def conditions(postings: DataFrame, predicate: And, keys: dict[str, str]) -> list:
    """For each part of the predicate, which postings it unites; None if that is none for certain."""
    names = list(keys)
    out = []
    for p in predicate.parts:
        mine = F.col("attno") == names.index(p.column) + 1
        if isinstance(p, (Eq, In)):
            values = literal_keys(postings.sparkSession, [p.value] if isinstance(p, Eq) else list(p.values), keys[p.column])
            if values is None:
                raise ValueError(f"keys of {p.column} can't answer this comparison; a scan can")
            out.append(mine & ~F.col("is_null") & F.col("key").isin(values) if values else None)
        elif isinstance(p, IsNull):
            out.append(mine & F.col("is_null"))
        elif isinstance(p, IsNotNull):
            out.append(mine & ~F.col("is_null"))
    return out


def lookup(postings: DataFrame, predicate: And, keys: dict[str, str]) -> DataFrame | None:
    """(bucket, bm) of the rows that every part holds for; None if a part matches nothing for certain.

    A part is known by its place, not its column: two parts on one column intersect like any others.
    """
    parts = conditions(postings, predicate, keys)
    if any(c is None for c in parts):
        return None
    any_part = parts[0]
    for c in parts[1:]:
        any_part = any_part | c
    places = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(parts)]))
    # All that follows is by bucket: one exchange serves the unions and the intersection.
    hit = postings.filter(any_part).withColumn("_q", F.explode(places)).repartition("bucket")
    united = as_bitmaps(hit, "_q")
    met = united.groupBy("bucket").agg(F.bitmap_and_agg("bm").alias("bm"), F.count(F.lit(1)).alias("_n"))
    return met.filter(F.col("_n") == len(parts)).select("bucket", "bm")


def cardinalities(postings: DataFrame, predicate: And, keys: dict[str, str]) -> DataFrame:
    """(cnt) of a predicate of one part, from the stored cardinalities alone."""
    (only,) = conditions(postings, predicate, keys)
    found = postings.filter(only) if only is not None else postings.limit(0)
    return found.agg(F.coalesce(F.sum("card"), F.lit(0)).cast("long").alias("cnt"))
