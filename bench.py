"""Times the headline queries and prints one line of JSON: the least of three runs after one to warm up.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of threads. The queries are counts and sums under
conjunctions of equalities and IN lists, by a scan and over a bitmap index that is built once and timed apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from sievewright.operators.index import BitmapIndex
from sievewright.plans.predicates import Eq, In, Residual, all_of
from sievewright.workload import QUERIES, build_index

SCANNED = ("eq_text", "eq_bigint", "and_2", "and_3", "in_list", "in_long_50", "in_and_2eq", "null_is_null", "sum_include", "sum_include_and", "project_unpinned_key", "rows_eq", "residual_neq", "full_enumeration", "scan_posting_cardinality", "scan_rescan_keys")
PREDICATES = {
    "one_large_value": all_of(Eq("l_linestatus", "F")),
    "scattered_4": all_of(Eq("l_suppkey", 7), Eq("l_returnflag", "A"), Eq("l_linenumber", 1), Eq("l_linestatus", "F")),
    "scattered_3": all_of(Eq("l_linenumber", 2), Eq("l_returnflag", "N"), Eq("l_linestatus", "O")),
    "two": all_of(Eq("l_returnflag", "R"), Eq("l_linestatus", "F")),
    "last_column": all_of(Eq("l_suppkey", 7)),
    "in_list": all_of(In("l_linenumber", [2, 3, 4])),
    "in_list_50": all_of(In("l_suppkey", range(1, 51))),
    "in_and_eq": all_of(In("l_linenumber", [2, 3, 4]), Eq("l_returnflag", "R")),
    "residual": all_of(Eq("l_returnflag", "R"), Residual("l_linenumber > 3")),
}
REPEAT = 3


def best(run) -> float:
    times = []
    for _ in range(REPEAT + 1):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(min(times[1:]), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {f"scan_{name.removeprefix('scan_')}": best(lambda name=name: QUERIES[name](spark, sf_dir).collect()) for name in SCANNED}
    began = time.perf_counter()
    index: BitmapIndex = build_index(spark, sf_dir)
    took["index_build"] = round(time.perf_counter() - began, 4)
    for name, predicate in PREDICATES.items():
        if predicate.indexable(index.keys):
            took[f"index_{name}"] = best(lambda p=predicate: index.count(p, "bitmap").df.collect())
        took[f"auto_{name}"] = best(lambda p=predicate: index.count(p).df.collect())
    print(json.dumps({"metric": "headline queries, sum of the least times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
