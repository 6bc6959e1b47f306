"""The registered queries of the engine: each over the whole tables of a folder, with the SQL that it equals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workload_index
from .operators import bitmaps, postings
from .operators.index import BitmapIndex, IndexSpec
from .plans.predicates import And, Eq, In, IsNotNull, IsNull, Residual, all_of
from .sources.storage import scratch_path
from .workload_sql import SQL as _SQL

Query = Callable[[SparkSession, str], DataFrame]


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _counted(df: DataFrame, predicate: And) -> DataFrame:
    return df.filter(predicate.condition()).agg(F.count(F.lit(1)).alias("cnt"))


def _count(table: str, *parts, **derived: Callable[[], Column]) -> Query:
    """A count over a table with derived columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _load(spark, sf_dir, table).withColumns({name: make() for name, make in derived.items()})
        return _counted(df, all_of(*parts))

    return run


def _sum(column: str, *parts) -> Query:
    return lambda spark, sf_dir: _load(spark, sf_dir, "lineitem").filter(all_of(*parts).condition()).agg(F.sum(column).cast("long").alias("s"))


def _null_v() -> Column:
    """Line number, null where it is four."""
    return F.nullif(F.col("l_linenumber"), F.lit(4))


def _signed_zeros() -> Column:
    value = F.when(F.col("l_linenumber") == 1, F.lit("-0.0")).when(F.col("l_linenumber") == 2, F.lit("0.0")).otherwise(F.lit("1.5"))
    return value.cast("float")


def _some_nan() -> Column:
    return F.when(F.col("l_linenumber") == 1, F.lit("NaN")).otherwise(F.lit("1.5")).cast("float")


R, F_STATUS = Eq("l_returnflag", "R"), Eq("l_linestatus", "F")
_FLOAT_007 = Residual("v = CAST(0.07 AS FLOAT)")


def _rows(table: str, columns: list[str], *parts) -> Query:
    return lambda spark, sf_dir: _load(spark, sf_dir, table).filter(all_of(*parts).condition()).select(*columns)


def _by_linenumber(df: DataFrame) -> DataFrame:
    return df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("cnt"))


def project_unpinned_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_linenumber(_load(spark, sf_dir, "lineitem").filter(R.condition()))


def project_unpinned_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "lineitem").filter(all_of(R, IsNotNull("l_linenumber")).condition())
    return _by_linenumber(rows).orderBy("l_linenumber").limit(5)


def sum_include_null_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "lineitem").withColumn("v", _null_v()).filter(R.condition())
    return rows.agg(F.sum("v").cast("long").alias("s"), F.count("v").alias("n"))


def residual_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "lineitem").filter(all_of(R, Residual("l_linenumber <> 3")).condition())
    return rows.agg(F.coalesce(F.sum("l_orderkey"), F.lit(0)).cast("long").alias("s"), F.count(F.lit(1)).alias("cnt"))


def posting_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("card"))


def total_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "lineitem").agg((F.count_distinct("l_returnflag") + F.count_distinct("l_linenumber")).alias("total_entries"))


def pending_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit("R").alias("l_returnflag"))
    return _counted(_load(spark, sf_dir, "lineitem").select("l_returnflag").union(late), all_of(R))


def delete_then_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_load(spark, sf_dir, "lineitem").filter(~(F.col("l_orderkey") < 100)), all_of(R))


def delete_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _load(spark, sf_dir, "lineitem").filter("l_linenumber <> 3").select("l_linenumber")
    return _counted(left.union(_load(spark, sf_dir, "region").select(F.lit(3).alias("l_linenumber"))), all_of(Eq("l_linenumber", 3)))


def update_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("l_suppkey") == 7, F.col("l_orderkey") + 1000).otherwise(F.col("l_orderkey"))
    return _load(spark, sf_dir, "lineitem").withColumn("k", changed).filter(R.condition()).agg(F.sum("k").cast("long").alias("s"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "lineitem")
    both = rows.filter("l_orderkey < 5000").union(rows.filter("l_orderkey >= 5000"))
    return _by_linenumber(both.filter(Eq("l_suppkey", 7).condition()))


def rescan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("cnt"))
    keys = _load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"))
    return keys.join(held, F.col("v") == F.col("c_nationkey"), "left").select("v", F.coalesce("cnt", F.lit(0)).alias("cnt"))


QUERIES: dict[str, Query] = {
    "eq_text": _count("lineitem", R),
    "eq_int": _count("lineitem", Eq("l_linenumber", 3)),
    "eq_bigint": _count("lineitem", Eq("l_suppkey", 7)),
    "eq_smallint": _count("lineitem", Eq("v", 3), v=lambda: F.col("l_linenumber").cast("smallint")),
    "eq_bool": _count("lineitem", Eq("v", True), v=lambda: F.col("l_linestatus") == "F"),
    "eq_date": _count("lineitem", Eq("v", dt.date(1997, 10, 31)), v=lambda: F.col("l_shipdate").cast("date")),
    "eq_float4": _count("lineitem", _FLOAT_007, v=lambda: F.col("l_discount").cast("float")),
    "eq_float4_zero": _count("lineitem", Eq("v", 0.0), v=_signed_zeros),
    "eq_float4_nan": _count("lineitem", Eq("v", float("nan")), v=_some_nan),
    "eq_enum": _count("orders", Eq("o_orderstatus", "F")),
    "eq_uuid_like": _count("events", Residual("v = md5('click')"), v=lambda: F.md5("event_type")),
    "eq_oid_like": _count("orders", Eq("o_custkey", 42)),
    "eq_absent": _count("lineitem", Eq("l_linenumber", 99)),
    "eq_cross_int_bigint": _count("lineitem", Residual("l_linenumber = CAST(3 AS BIGINT)")),
    "eq_cross_overflow": _count("lineitem", Eq("v", 65539), v=lambda: F.col("l_linenumber").cast("smallint")),
    "and_2": _count("lineitem", F_STATUS, R),
    "and_3": _count("lineitem", Eq("l_linenumber", 2), Eq("l_returnflag", "N"), Eq("l_linestatus", "O")),
    "and_4_mixed_types": _count("lineitem", Eq("l_suppkey", 7), Eq("l_returnflag", "A"), Eq("l_linenumber", 1), Eq("v", True), v=lambda: F.col("l_discount") == 0.05),
    "and_absent": _count("lineitem", Eq("l_linenumber", 99), R),
    "and_contradiction": _count("events", Eq("event_type", "click"), Eq("event_type", "error")),
    "in_list": _count("lineitem", In("l_linenumber", [1, 3])),
    "in_single": _count("lineitem", In("l_linenumber", [5])),
    "in_absent": _count("lineitem", In("l_linenumber", [11, 12])),
    "in_mixed": _count("lineitem", In("l_linenumber", [2, 99, 100])),
    "in_all": _count("lineitem", In("l_linenumber", range(1, 8))),
    "in_duplicates": _count("lineitem", In("l_linenumber", [2, 2, 3, 3])),
    "in_with_null": _count("lineitem", In("l_linenumber", [2, None])),
    "in_long_50": _count("lineitem", In("l_suppkey", range(1, 51))),
    "in_and_eq": _count("lineitem", In("l_linenumber", [2, 3, 4]), R),
    "in_and_2eq": _count("lineitem", In("l_linenumber", [2, 3]), Eq("l_returnflag", "A"), F_STATUS),
    "null_is_null": _count("lineitem", IsNull("v"), v=_null_v),
    "null_is_not_null": _count("lineitem", IsNotNull("v"), v=_null_v),
    "null_and_eq": _count("lineitem", R, IsNull("v"), v=_null_v),
    "notnull_and_eq": _count("lineitem", R, IsNotNull("v"), v=_null_v),
    "eq_excludes_null": _count("lineitem", Eq("v", 3), v=_null_v),
    "rows_eq": _rows("lineitem", ["l_orderkey", "l_linenumber"], R, Eq("l_suppkey", 7)),
    "rows_in_text": _rows("events", ["event_id"], In("event_type", ["click", "error"])),
    "project_pinned_key": _rows("lineitem", ["l_returnflag", "l_linenumber"], R, Eq("l_linenumber", 7)),
    "project_unpinned_key": project_unpinned_key,
    "project_unpinned_limit": project_unpinned_limit,
    "sum_include": _sum("l_orderkey", R),
    "sum_include_and": _sum("l_orderkey", R, Eq("l_linenumber", 2), Eq("l_suppkey", 7)),
    "sum_include_null_payload": sum_include_null_payload,
    "sum_empty": _sum("l_orderkey", Eq("l_linenumber", 99)),
    "residual_neq": residual_neq,
    "range_not_equality": _count("lineitem", Residual("l_linenumber > 3")),
    "not_in": _count("lineitem", Residual("l_linenumber NOT IN (2, 3)")),
    "full_enumeration": _count("lineitem"),
    "posting_cardinality": posting_cardinality,
    "total_entries": total_entries,
    "pending_visible": pending_visible,
    "delete_then_count": delete_then_count,
    "delete_reinsert": delete_reinsert,
    "update_payload": update_payload,
    "partitioned": partitioned,
    "rescan_keys": rescan_keys,
}
SQL: dict[str, str] = dict(_SQL)
for _name in workload_index.SCANS:
    QUERIES[f"scan_{_name}"], SQL[f"scan_{_name}"] = QUERIES.pop(_name), SQL.pop(_name)
QUERIES["group_by_two_keys"] = lambda spark, sf_dir: _load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("cnt"), F.sum("l_orderkey").alias("s"))
SQL["group_by_two_keys"] = "SELECT l_returnflag, l_linestatus, count(*) AS cnt, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY ALL"
QUERIES |= workload_index.QUERIES
SQL |= workload_index.SQL


# The same over an index that is built, changed and queried in the shared folder.

KEYS = workload_index.KEYS


def build_index(spark: SparkSession, sf_dir: str) -> BitmapIndex:
    return BitmapIndex.build(spark, f"{sf_dir}/lineitem.parquet", IndexSpec(KEYS, ("l_orderkey",)), scratch_path(spark, "index"))


def _shared(spark: SparkSession, sf_dir: str) -> BitmapIndex:
    return workload_index.shared_index(spark, sf_dir, "lineitem")


def bitmap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).rows(all_of(R, Eq("l_suppkey", 7)), ["l_orderkey", "l_linenumber"], "bitmap").df


def bitmap_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).sum("l_orderkey", all_of(R, Eq("l_linenumber", 2), Eq("l_suppkey", 7)), "bitmap").df.select(F.col("s").cast("long").alias("s"))


def bitmap_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows returned but not on line 3: a difference of two sets."""
    index = _shared(spark, sf_dir)
    left, right = (postings.lookup(index.postings(), all_of(p), index.keys) for p in (R, Eq("l_linenumber", 3)))
    return bitmaps.count_difference(left, right)


def bitmap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows returned or on line 3."""
    index = _shared(spark, sf_dir)
    return bitmaps.count(bitmaps.union(*(postings.lookup(index.postings(), all_of(p), index.keys) for p in (R, Eq("l_linenumber", 3)))))


def index_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F come as returned rows, orders under 100 go, and what is left is compacted; counted after each step."""
    index, returned = build_index(spark, sf_dir), all_of(R)
    late = _load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in index.table().schema} | {"l_returnflag": F.lit("R"), "l_orderkey": F.col("o_orderkey")}
    steps = [index.count(returned, "bitmap").df]
    index.append(late.select(*[c.alias(n) for n, c in columns.items()]))
    steps.append(index.count(returned, "bitmap").df)
    index.compact()
    steps.append(index.count(returned, "bitmap").df)
    index.delete(all_of(Residual("l_orderkey < 100")))
    steps.append(index.count(returned, "bitmap").df)
    index.compact()
    steps.append(index.count(returned, "bitmap").df)
    out = steps[0].withColumn("step", F.lit(0))
    for i, s in enumerate(steps[1:], 1):
        out = out.union(s.withColumn("step", F.lit(i)))
    return out.select("step", "cnt")


def index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spark, sf_dir).histogram("l_returnflag")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spark, sf_dir).stats().select("total_entries", "pending_count", "pending_threshold", "bg_merge_running", "index_version", "indexed_rows")


def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spark, sf_dir).health()


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spark, sf_dir).check(heap_all_indexed=True)


def index_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark, sf_dir)
    asked = ((all_of(R), "auto"), (all_of(R, F_STATUS), "bitmap"), (all_of(R, Residual("l_linenumber > 3")), "bitmap"))
    lines = [index.count(p, route).explain() for p, route in asked]
    return spark.createDataFrame(list(enumerate(lines)), "n int, plan string")


QUERIES |= {
    "bitmap_rows_eq": bitmap_rows,
    "bitmap_sum_include_and": bitmap_sum,
    "bitmap_not": bitmap_not,
    "bitmap_union": bitmap_union,
    "index_lifecycle": index_lifecycle,
    "index_histogram": index_histogram,
    "index_stats": index_stats,
    "index_health": index_health,
    "index_check": index_check,
    "index_explain": index_explain,
}
_RETURNED = "SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'"
_LATE = "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'"
_GONE = "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey < 100) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 100)"
SQL |= {f"bitmap_{n}": _SQL[n] for n in ("rows_eq", "sum_include_and")}
SQL |= {
    "bitmap_not": "SELECT count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 3",
    "bitmap_union": "SELECT count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 3",
    "index_histogram": _SQL["posting_cardinality"],
    "index_lifecycle": f"SELECT 0 AS step, ({_RETURNED}) AS cnt UNION ALL SELECT 1, ({_RETURNED}) + ({_LATE}) UNION ALL SELECT 2, ({_RETURNED}) + ({_LATE})"
    f" UNION ALL SELECT 3, ({_RETURNED}) + ({_LATE}) - ({_GONE}) UNION ALL SELECT 4, ({_RETURNED}) + ({_LATE}) - ({_GONE})",
    "index_stats": "SELECT count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) + count(DISTINCT l_linenumber) + count(DISTINCT l_suppkey) AS total_entries, "
    "CAST(0 AS BIGINT) AS pending_count, 10000 AS pending_threshold, false AS bg_merge_running, 1 AS index_version, count(*) AS indexed_rows FROM lineitem",
    "index_health": "SELECT 'ok' AS health",
    "index_check": "SELECT * FROM (VALUES " + ", ".join(f"('{x}', true)" for x in ("all rows indexed", "bucket range", "cardinality", "every row once", "files", "format", "null flag", "one form", "unique")) + ") t(name, ok)",
    "index_explain": """SELECT * FROM (VALUES (0, 'BitmapCount: 1 qual(s), route bitmap (one condition: stored cardinalities)'), (1, 'BitmapCount: 2 qual(s), route bitmap (asked for)'),
        (2, 'Scan: 2 qual(s), route native (a condition can''t be answered by the index)')) t(n, plan)""",
}
