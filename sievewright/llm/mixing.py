"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. The copies expected so far are summed along the
source, one random offset is added, and a document is emitted once for every integer that its own share crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, ranked, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size), one row a source -> with target (double).

    Sources take the weights in turn, by code point, null last. Together they get share times all words; none gets
    over most times its own, and what that leaves goes to the others by weight. With f the level of the rest, a
    source gets min(most * size, f * weight): ordered by most * size / weight, the capped ones come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.lit(weights[-1])
    for i, weight in list(enumerate(weights))[:-1]:
        cases = F.when(F.pmod(F.col("_n"), F.lit(len(weights))) == i, F.lit(weight)).otherwise(cases)
    s = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_w", cases.cast("double"))
    s = s.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_all", F.lit(share) * F.sum("source_size").over(whole)).withColumn("_all_w", F.sum("_w").over(whole))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level)
    s = s.withColumn("_f", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(whole))
    free = F.col("_f").isNotNull() & (F.struct("_ratio", "_n") >= F.struct(F.col("_f._ratio").alias("_ratio"), F.col("_f._n").alias("_n")))
    return s.select("source", "source_size", F.when(free, F.col("_f._level") * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def source_offset(seed: int, draw: int) -> Column:
    """A random offset for a source, in [0, 1): of seed, draw and the name alone, so reruns agree."""
    name = F.concat(F.lit(f"{seed}:{draw}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(offset: Column) -> Column:
    """Integers that a document's share crosses: from rate * rank to rate * (rank + 1), both moved by the offset."""
    return F.floor(F.col("_rate") * (F.col("_rank") + 1) + offset) - F.floor(F.col("_rate") * F.col("_rank") + offset)


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, draws: int = 32) -> DataFrame:
    """documents -> doc_id, th, source, size, source_size, target, copies (0 and up), one row a document; th is a hash of the text.

    Within its source a document's place is by size and doc_id, so that the sample holds every length in proportion
    and the words taken miss the target by about one document at most. Where a few long documents make up a source,
    that would be much: of draws random offsets a source takes the one whose words come nearest its target.
    Nulls: a null text has size 0; null is a source of its own; null doc_ids come first. A source without words
    has target 0 and no copies. Repeated rows are documents of their own; equal ones share copies in any order.
    An empty table gives none. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("source"), n_words().alias("size"))
    laid = ranked(slim, ["size", "doc_id"], ["source"], "_rank")
    sizes = laid.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most), "targets")
    out = joined_small(laid, targets, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("_rate", rate)
    size = F.col("size")
    missed = out.groupBy("source", "target").agg(*[F.abs(F.sum(size * _copies(source_offset(seed, k))) - F.first("target")).alias(f"_{k}") for k in range(draws)])
    best = F.least(*[F.struct(F.col(f"_{k}").alias("missed"), F.lit(k).alias("k"), source_offset(seed, k).alias("u")) for k in range(draws)])
    offsets = written(missed.select("source", best["u"].alias("_u")), "offsets")
    out = joined_small(out, offsets, ["source"])
    return out.select("doc_id", "th", "source", "size", "source_size", "target", _copies(F.col("_u")).cast("int").alias("copies"))


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s
), v AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 2e0 * source_size AS cap FROM w
), l AS (
  SELECT *, cap / w AS ratio,
    (1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0e0)) AS level
  FROM v WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level, ratio, n FROM l WHERE level <= ratio ORDER BY ratio, n LIMIT 1
), t AS (
  SELECT l.source, l.source_size, CASE WHEN (l.ratio, l.n) >= (f.ratio, f.n) THEN f.level * l.w ELSE l.cap END AS target
  FROM l LEFT JOIN f ON true
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS i,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT source, target, k, CAST(CAST('0x' || substr(md5('17:' || k || ':' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u
  FROM t, range(32) g(k)
), m AS (
  SELECT u.source, u.k, u.u, abs(CAST(sum(r.size * (floor(rate * (i + 1) + u.u) - floor(rate * i + u.u))) AS DOUBLE) - any_value(u.target)) AS missed
  FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source GROUP BY u.source, u.k, u.u
), o AS (
  SELECT source, u FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY missed, k) = 1
), c AS (
  SELECT doc_id, size, source_size, target, CAST(floor(rate * (i + 1) + u) - floor(rate * i + u) AS INTEGER) AS copies
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM c
"""
