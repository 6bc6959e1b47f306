"""Registered queries that go through a bitmap index: reads over indexes that are built once an application, and changes.

The read-only indexes are over a copy of some tables in the shared folder, with a column of each key type besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bitmaps, postings
from .operators.index import BitmapIndex, IndexSpec, list_indexes
from .plans.predicates import Eq, In, Residual, all_of
from .sources.storage import scratch_path
from .streaming.ingest import ingest
from .workload_sql import SQL as _SQL

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
#: Columns derived of lineitem, one for each key type and special value.
DERIVED = {
    "v_short": "CAST(l_linenumber AS SMALLINT)", "v_bool": "l_linestatus = 'F'", "v_date": "CAST(l_shipdate AS DATE)", "v_float": "CAST(l_discount AS FLOAT)",
    "v_zero": "CAST(CASE l_linenumber WHEN 1 THEN '-0.0' WHEN 2 THEN '0.0' ELSE '1.5' END AS FLOAT)", "v_minus": "CAST('-0.0' AS DOUBLE)",
    "v_nan": "CAST(CASE l_linenumber WHEN 1 THEN 'NaN' ELSE '1.5' END AS FLOAT)", "v_null": "nullif(l_linenumber, 4)", "v_five": "l_discount = 0.05",
}
_TABLES = {
    "lineitem": (["l_orderkey", *KEYS, *(f"{sql} AS {name}" for name, sql in DERIVED.items())], IndexSpec((*KEYS, *DERIVED), ("l_orderkey",))),
    "orders": (["o_orderkey", "o_orderstatus", "o_custkey"], IndexSpec(("o_orderstatus", "o_custkey"))),
    "events": (["event_id", "event_type", "md5(event_type) AS v_md5"], IndexSpec(("event_type", "v_md5"), ("event_id",))),
    "customer": (["c_custkey", "c_nationkey"], IndexSpec(("c_nationkey",))),
}
_SHARED: dict[tuple[str, str, str], BitmapIndex] = {}


def shared_index(spark: SparkSession, sf_dir: str, table: str) -> BitmapIndex:
    """The index of a table, built by the first query of the application that asks. Nothing may change it."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _SHARED or not _SHARED[key].store.names():
        columns, spec = _TABLES[table]
        path = scratch_path(spark, table)
        spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns).write.parquet(path)
        _SHARED[key] = BitmapIndex.build(spark, path, spec, scratch_path(spark, f"{table}-index"))
    return _SHARED[key]


def _lineitem(spark: SparkSession, sf_dir: str) -> BitmapIndex:
    return shared_index(spark, sf_dir, "lineitem")


def own_index(spark: SparkSession, sf_dir: str, where: str = "true", threshold: int = 10_000) -> BitmapIndex:
    """An index of l_orderkey and KEYS that the query may change."""
    path = scratch_path(spark, "lineitem")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(where).select("l_orderkey", *KEYS).write.parquet(path)
    return BitmapIndex.build(spark, path, IndexSpec(KEYS, ("l_orderkey",)), scratch_path(spark, "index"), threshold)


#: Counts by WHERE clause; the SQL is that of the scan of the same name.
COUNTS = {
    "eq_text": ("lineitem", "l_returnflag = 'R'"), "eq_int": ("lineitem", "l_linenumber = 3"), "eq_bigint": ("lineitem", "l_suppkey = 7"),
    "eq_smallint": ("lineitem", "v_short = 3"), "eq_bool": ("lineitem", "v_bool = true"), "eq_date": ("lineitem", "v_date = DATE '1997-10-31'"),
    "eq_float4": ("lineitem", "v_float = CAST(0.07 AS FLOAT)"), "eq_float4_zero": ("lineitem", "v_zero = 0.0D"), "eq_float4_nan": ("lineitem", "v_nan = CAST('NaN' AS FLOAT)"),
    "eq_enum": ("orders", "o_orderstatus = 'F'"), "eq_uuid_like": ("events", f"v_md5 = '{hashlib.md5(b'click').hexdigest()}'"), "eq_oid_like": ("orders", "o_custkey = 42"),
    "eq_absent": ("lineitem", "l_linenumber = 99"), "eq_cross_int_bigint": ("lineitem", "l_linenumber = CAST(3 AS BIGINT)"), "eq_cross_overflow": ("lineitem", "v_short = 65539"),
    "and_2": ("lineitem", "l_linestatus = 'F' AND l_returnflag = 'R'"), "and_3": ("lineitem", "l_linenumber = 2 AND l_returnflag = 'N' AND l_linestatus = 'O'"),
    "and_4_mixed_types": ("lineitem", "l_suppkey = 7 AND l_returnflag = 'A' AND l_linenumber = 1 AND v_five = true"), "and_absent": ("lineitem", "l_linenumber = 99 AND l_returnflag = 'R'"),
    "and_contradiction": ("events", "event_type = 'click' AND event_type = 'error'"), "in_list": ("lineitem", "l_linenumber IN (1, 3)"), "in_single": ("lineitem", "l_linenumber IN (5)"),
    "in_absent": ("lineitem", "l_linenumber IN (11, 12)"), "in_mixed": ("lineitem", "l_linenumber IN (2, 99, 100)"), "in_all": ("lineitem", "l_linenumber IN (1, 2, 3, 4, 5, 6, 7)"),
    "in_duplicates": ("lineitem", "l_linenumber IN (2, 2, 3, 3)"), "in_with_null": ("lineitem", "l_linenumber IN (2, NULL)"),
    "in_long_50": ("lineitem", f"l_suppkey IN ({', '.join(map(str, range(1, 51)))})"), "in_and_eq": ("lineitem", "l_linenumber IN (2, 3, 4) AND l_returnflag = 'R'"),
    "in_and_2eq": ("lineitem", "l_linenumber IN (2, 3) AND l_returnflag = 'A' AND l_linestatus = 'F'"), "null_is_null": ("lineitem", "v_null IS NULL"),
    "null_is_not_null": ("lineitem", "v_null IS NOT NULL"), "null_and_eq": ("lineitem", "l_returnflag = 'R' AND v_null IS NULL"),
    "notnull_and_eq": ("lineitem", "l_returnflag = 'R' AND v_null IS NOT NULL"), "eq_excludes_null": ("lineitem", "v_null = 3"),
}


def _count(table: str, where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = shared_index(spark, sf_dir, table)
        answer = index.count(index.where(where), "bitmap")
        if answer.route != "bitmap":
            raise AssertionError(f"{where} is for the index to answer: {answer.why}")
        return answer.df

    return run


#: Conditions whose literals are of another type than the column, with the same in SQL for a lineitem that has DERIVED.
LITERALS = (
    ("v_date = '1997-10-31'", "CAST(l_shipdate AS DATE) = DATE '1997-10-31'"), ("v_date IN ('1997-10-31', '1997-11-01')", "CAST(l_shipdate AS DATE) IN (DATE '1997-10-31', DATE '1997-11-01')"),
    ("l_linenumber = '3'", "l_linenumber = 3"), ("l_linenumber IN ('3')", "l_linenumber = 3"), ("l_linenumber IN ('3', '4')", "l_linenumber IN (3, 4)"), ("l_linenumber = 3.0D", "l_linenumber = 3"),
    ("l_suppkey = 7.0D", "l_suppkey = 7"), ("l_suppkey = '7'", "l_suppkey = 7"), ("l_suppkey = CAST(7 AS TINYINT)", "l_suppkey = 7"), ("v_short = 3.5D", "false"), ("v_short = '3'", "l_linenumber = 3"),
    ("v_bool = 'true'", "l_linestatus = 'F'"), ("v_float = 0.07D", "false"), ("v_zero = '1.5'", "l_linenumber NOT IN (1, 2)"), ("v_zero = 0", "l_linenumber IN (1, 2)"), ("v_zero = -0.0D", "l_linenumber IN (1, 2)"),
    ("v_zero = '0'", "l_linenumber IN (1, 2)"), ("v_zero IN (0.0D, 1.5D)", "true"), ("v_minus = 0.0D", "true"), ("v_minus = 0", "true"), ("v_minus IN (0.0D)", "true"), ("v_minus = 0.0D AND l_linenumber = 3", "l_linenumber = 3"),
    ("l_linenumber IN (NULL)", "false"), ("v_bool", "l_linestatus = 'F'"), ("NOT v_bool AND l_linenumber = 3", "l_linestatus <> 'F' AND l_linenumber = 3"), ("l_returnflag = 'R' AND l_linenumber = '3'", "l_returnflag = 'R' AND l_linenumber = 3"),
)


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of each condition in LITERALS by each route."""
    index, out = _lineitem(spark, sf_dir), None
    for n, (where, _) in enumerate(LITERALS):
        for route in ("native", "bitmap", "auto"):
            one = index.count(index.where(where), route).df.select(F.lit(n).alias("n"), F.lit(route).alias("route"), "cnt")
            out = one if out is None else out.unionByName(one)
    return out


def _in_nothing(values: list) -> Query:
    return lambda spark, sf_dir: _lineitem(spark, sf_dir).count(all_of(Eq("l_returnflag", "R"), In("l_linenumber", values)), "bitmap").df


def project_pinned_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, predicate, columns = _lineitem(spark, sf_dir), all_of(Eq("l_returnflag", "R"), Eq("l_linenumber", 7)), ["l_returnflag", "l_linenumber"]
    if not index.index_only(predicate, columns):
        raise AssertionError("both columns are pinned")
    return index.rows(predicate, columns, "bitmap").df


def project_pinned_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero that is pinned keeps the sign that each row has."""
    rows = _lineitem(spark, sf_dir).rows(all_of(Eq("v_zero", 0.0), Eq("l_returnflag", "R")), ["v_zero"], "bitmap").df
    return rows.groupBy(F.col("v_zero").cast("string").alias("zero")).agg(F.count(F.lit(1)).alias("cnt"))


def sum_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).sum("l_orderkey", all_of(Eq("l_returnflag", "R")), "bitmap").df.select(F.col("s").cast("long").alias("s"))


def rows_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_index(spark, sf_dir, "events").rows(all_of(In("event_type", ["click", "error"])), ["event_id"], "bitmap").df


def bitmap_and_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes of one column each over the same table: their sets of rows are intersected."""
    path = scratch_path(spark, "lineitem")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEYS).write.parquet(path)
    one, two = (BitmapIndex.build(spark, path, IndexSpec([k]), scratch_path(spark, f"index-{k}")) for k in ("l_returnflag", "l_linenumber"))
    return bitmaps.count(bitmaps.intersection(postings.lookup(one.postings(), all_of(Eq("l_returnflag", "R")), one.keys), postings.lookup(two.postings(), all_of(In("l_linenumber", [2, 3])), two.keys)))


def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows returned that are on line 3 (semi), and that are not (anti), by row id."""
    index = _lineitem(spark, sf_dir)
    left, right = index.rids(all_of(Eq("l_returnflag", "R"))), index.rids(all_of(Eq("l_linenumber", 3)))
    both = [left.join(right, "rid", f"left_{how}").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(how).alias("how"), "cnt") for how in ("semi", "anti")]
    return both[0].union(both[1])


def posting_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).histogram("l_returnflag")


def total_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lineitem")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linenumber").write.parquet(path)
    return BitmapIndex.build(spark, path, IndexSpec(("l_returnflag", "l_linenumber")), scratch_path(spark, "index")).stats().select("total_entries")


def _as_lineitem(df: DataFrame, **values) -> DataFrame:
    """Rows with the columns of own_index; what isn't given is null."""
    kinds = {"l_orderkey": "long", "l_returnflag": "string", "l_linestatus": "string", "l_linenumber": "int", "l_suppkey": "long"}
    return df.select(*[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def pending_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark, sf_dir, threshold=10_000_000)
    index.append(_as_lineitem(spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'"), l_returnflag=F.lit("R")))
    if not index.manifest["pending"]:
        raise AssertionError("the rows are to be pending")
    return index.count(all_of(Eq("l_returnflag", "R")), "bitmap").df


def delete_then_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark, sf_dir)
    index.delete(all_of(Residual("l_orderkey < 100")))
    return index.count(all_of(Eq("l_returnflag", "R")), "bitmap").df


def delete_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark, sf_dir)
    index.delete(all_of(Eq("l_linenumber", 3)))
    index.append(_as_lineitem(spark.read.parquet(f"{sf_dir}/region.parquet"), l_linenumber=F.lit(3)))
    index.compact()
    return index.count(all_of(Eq("l_linenumber", 3)), "bitmap").df


def update_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark, sf_dir)
    index.update(all_of(Eq("l_suppkey", 7)), {"l_orderkey": F.col("l_orderkey") + 1000})
    return index.sum("l_orderkey", all_of(Eq("l_returnflag", "R")), "bitmap").df.select(F.col("s").cast("long").alias("s"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions, each a table of its own, under one index."""
    paths = [scratch_path(spark, f"part-{i}") for i in range(2)]
    for path, where in zip(paths, ("l_orderkey < 5000", "l_orderkey >= 5000")):
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(where).select("l_orderkey", *KEYS).write.parquet(path)
    index = BitmapIndex.build(spark, paths, IndexSpec(KEYS), scratch_path(spark, "index"))
    return index.rows(all_of(Eq("l_suppkey", 7)), ["l_linenumber"], "bitmap").df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("cnt"))


def rescan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("v"))
    return shared_index(spark, sf_dir, "customer").count_many(keys, "c_nationkey")


def build_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over an index of no rows, then with five."""
    index = own_index(spark, sf_dir, "false")
    before = index.count(all_of(Eq("l_linenumber", 3)), "bitmap").df.select(F.lit(0).alias("step"), "cnt")
    index.append(_as_lineitem(spark.read.parquet(f"{sf_dir}/region.parquet"), l_linenumber=F.lit(3)))
    index.compact()
    return before.union(index.count(all_of(Eq("l_linenumber", 3)), "bitmap").df.select(F.lit(1).alias("step"), "cnt"))


def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark, sf_dir)
    index.append(_as_lineitem(spark.read.parquet(f"{sf_dir}/region.parquet"), l_linenumber=F.lit(3)))
    index.reindex()
    index.reindex()
    return index.count(all_of(Eq("l_linenumber", 3)), "bitmap").df


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes of one folder, with their pending rows and thresholds."""
    root, region = scratch_path(spark, "indexes"), f"{sf_dir}/region.parquet"
    for name, threshold in (("one", 1000), ("two", 20_000)):
        index = BitmapIndex.build(spark, region, IndexSpec(("r_name",)), f"{root}/{name}", threshold)
    index.append(spark.read.parquet(region))
    index.set_threshold(5000)
    return list_indexes(spark, root).select("name", "total_entries", "pending_count", "pending_threshold")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F come by a stream, as returned rows, and again by one with a new checkpoint."""
    index = own_index(spark, sf_dir)
    source = scratch_path(spark, "source")
    _as_lineitem(spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'"), l_returnflag=F.lit("R")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(source), index, scratch_path(spark, "checkpoint")).awaitTermination()
    return index.count(all_of(Eq("l_returnflag", "R")), "bitmap").df


QUERIES: dict[str, Query] = {f"bitmap_{name}": _count(*spec) for name, spec in COUNTS.items()}
QUERIES |= {
    "literals_by_route": literals, "in_empty": _in_nothing([]), "in_all_null": _in_nothing([None, None]), "project_pinned_key": project_pinned_key, "project_pinned_zero": project_pinned_zero,
    "bitmap_sum_include": sum_include, "bitmap_rows_in_text": rows_in_text, "bitmap_and_of_two_indexes": bitmap_and_of_two, "bitmap_semi_and_anti": semi_and_anti, "posting_cardinality": posting_cardinality,
    "total_entries": total_entries, "pending_visible": pending_visible, "delete_then_count": delete_then_count, "delete_reinsert": delete_reinsert, "update_payload": update_payload,
    "partitioned": partitioned, "rescan_keys": rescan_keys, "index_build_empty": build_empty, "index_reindex": reindex, "index_list": listed, "index_streamed": streamed,
}
#: Queries of which the scan stays, under this name.
SCANS = ("project_pinned_key", "posting_cardinality", "total_entries", "pending_visible", "delete_then_count", "delete_reinsert", "update_payload", "partitioned", "rescan_keys")

_NONE = "SELECT CAST(0 AS BIGINT) AS cnt"
SQL: dict[str, str] = {f"bitmap_{name}": _SQL[name] for name in COUNTS} | {name: _SQL[name] for name in SCANS}
SQL |= {
    "literals_by_route": " UNION ALL ".join(f"SELECT {n} AS n, '{route}' AS route, count(*) AS cnt FROM lineitem WHERE {sql}" for n, (_, sql) in enumerate(LITERALS) for route in ("native", "bitmap", "auto")),
    "in_empty": _NONE, "in_all_null": _NONE, "bitmap_sum_include": _SQL["sum_include"], "bitmap_rows_in_text": _SQL["rows_in_text"],
    "project_pinned_zero": "SELECT CASE l_linenumber WHEN 1 THEN '-0.0' ELSE '0.0' END AS zero, count(*) AS cnt FROM lineitem WHERE l_linenumber IN (1, 2) AND l_returnflag = 'R' GROUP BY 1",
    "bitmap_and_of_two_indexes": "SELECT count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (2, 3)",
    "bitmap_semi_and_anti": "SELECT CASE WHEN l_linenumber = 3 THEN 'semi' ELSE 'anti' END AS how, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "index_build_empty": "SELECT 0 AS step, CAST(0 AS BIGINT) AS cnt UNION ALL SELECT 1, count(*) FROM region",
    "index_reindex": "SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber = 3) + (SELECT count(*) FROM region) AS cnt",
    "index_list": "SELECT 'one' AS name, count(DISTINCT r_name) AS total_entries, CAST(0 AS BIGINT) AS pending_count, 1000 AS pending_threshold FROM region UNION ALL SELECT 'two', count(DISTINCT r_name), count(*), 5000 FROM region",
    "index_streamed": "SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') + 2 * (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS cnt",
}
