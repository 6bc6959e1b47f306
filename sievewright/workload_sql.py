"""SQL that each query of the workload equals, for any engine that has the same tables."""

SQL = {
    "eq_text": "SELECT count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R'",
    "eq_int": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber = 3",
    "eq_bigint": "SELECT count(*) AS cnt FROM lineitem WHERE l_suppkey = 7",
    "eq_smallint": "SELECT count(*) AS cnt FROM lineitem WHERE CAST(l_linenumber AS SMALLINT) = CAST(3 AS SMALLINT)",
    "eq_bool": "SELECT count(*) AS cnt FROM lineitem WHERE (l_linestatus = 'F') = true",
    "eq_date": "SELECT count(*) AS cnt FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1997-10-31'",
    "eq_float4": "SELECT count(*) AS cnt FROM lineitem WHERE CAST(l_discount AS FLOAT) = CAST(0.07 AS FLOAT)",
    "eq_float4_zero": "SELECT count(*) AS cnt FROM (SELECT CASE WHEN l_linenumber = 1 THEN CAST('-0.0' AS FLOAT) WHEN l_linenumber = 2 THEN CAST('0.0' AS FLOAT) ELSE CAST('1.5' AS FLOAT) END AS v FROM lineitem) t WHERE v = CAST('0.0' AS FLOAT)",
    "eq_float4_nan": "SELECT count(*) AS cnt FROM (SELECT CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS FLOAT) ELSE CAST('1.5' AS FLOAT) END AS v FROM lineitem) t WHERE v = CAST('NaN' AS FLOAT)",
    "eq_enum": "SELECT count(*) AS cnt FROM orders WHERE o_orderstatus = 'F'",
    "eq_uuid_like": "SELECT count(*) AS cnt FROM events WHERE md5(event_type) = md5('click')",
    "eq_oid_like": "SELECT count(*) AS cnt FROM orders WHERE o_custkey = 42",
    "eq_absent": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber = 99",
    "eq_cross_int_bigint": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber = CAST(3 AS BIGINT)",
    "eq_cross_overflow": "SELECT count(*) AS cnt FROM lineitem WHERE CAST(l_linenumber AS SMALLINT) = 65539",
    "and_2": "SELECT count(*) AS cnt FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'",
    "and_3": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'N' AND l_linestatus = 'O'",
    "and_4_mixed_types": "SELECT count(*) AS cnt FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'A' AND l_linenumber = 1 AND (l_discount = 0.05) = true",
    "and_absent": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber = 99 AND l_returnflag = 'R'",
    "and_contradiction": "SELECT count(*) AS cnt FROM events WHERE event_type = 'click' AND event_type = 'error'",
    "in_list": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (1, 3)",
    "in_single": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (5)",
    "in_absent": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (11, 12)",
    "in_mixed": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (2, 99, 100)",
    "in_all": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4, 5, 6, 7)",
    "in_duplicates": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (2, 2, 3, 3)",
    "in_with_null": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (2, NULL)",
    "in_long_50": "SELECT count(*) AS cnt FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50)",
    "in_and_eq": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (2, 3, 4) AND l_returnflag = 'R'",
    "in_and_2eq": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber IN (2, 3) AND l_returnflag = 'A' AND l_linestatus = 'F'",
    "null_is_null": "SELECT count(*) AS cnt FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE v IS NULL",
    "null_is_not_null": "SELECT count(*) AS cnt FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE v IS NOT NULL",
    "null_and_eq": "SELECT count(*) AS cnt FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE l_returnflag = 'R' AND v IS NULL",
    "notnull_and_eq": "SELECT count(*) AS cnt FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE l_returnflag = 'R' AND v IS NOT NULL",
    "eq_excludes_null": "SELECT count(*) AS cnt FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE v = 3",
    "rows_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 7",
    "rows_in_text": "SELECT event_id FROM events WHERE event_type IN ('click', 'error')",
    "project_pinned_key": "SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7",
    "project_unpinned_key": "SELECT l_linenumber, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linenumber",
    "project_unpinned_limit": "SELECT l_linenumber, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IS NOT NULL GROUP BY l_linenumber ORDER BY l_linenumber LIMIT 5",
    "sum_include": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'R'",
    "sum_include_and": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 AND l_suppkey = 7",
    "sum_include_null_payload": "SELECT CAST(sum(v) AS BIGINT) AS s, count(v) AS n FROM (SELECT l_orderkey, l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS v FROM lineitem) t WHERE l_returnflag = 'R'",
    "sum_empty": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_linenumber = 99",
    "residual_neq": "SELECT CAST(COALESCE(sum(l_orderkey), 0) AS BIGINT) AS s, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 3",
    "range_not_equality": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber > 3",
    "not_in": "SELECT count(*) AS cnt FROM lineitem WHERE l_linenumber NOT IN (2, 3)",
    "full_enumeration": "SELECT count(*) AS cnt FROM lineitem",
    "posting_cardinality": "SELECT l_returnflag AS k, count(*) AS card FROM lineitem GROUP BY l_returnflag",
    "total_entries": "SELECT count(DISTINCT l_returnflag) + count(DISTINCT l_linenumber) AS total_entries FROM lineitem",
    "pending_visible": "SELECT count(*) AS cnt FROM (SELECT l_returnflag FROM lineitem UNION ALL SELECT 'R' AS l_returnflag FROM orders WHERE o_orderstatus = 'F') t WHERE l_returnflag = 'R'",
    "delete_then_count": "SELECT count(*) AS cnt FROM (SELECT * FROM lineitem WHERE NOT (l_orderkey < 100)) t WHERE l_returnflag = 'R'",
    "delete_reinsert": "SELECT count(*) AS cnt FROM (SELECT l_linenumber FROM lineitem WHERE l_linenumber <> 3 UNION ALL SELECT 3 AS l_linenumber FROM region) t WHERE l_linenumber = 3",
    "update_payload": "SELECT CAST(sum(k) AS BIGINT) AS s FROM (SELECT CASE WHEN l_suppkey = 7 THEN l_orderkey + 1000 ELSE l_orderkey END AS k, l_returnflag FROM lineitem) t WHERE l_returnflag = 'R'",
    "partitioned": "SELECT l_linenumber, count(*) AS cnt FROM (SELECT * FROM lineitem WHERE l_orderkey < 5000 UNION ALL SELECT * FROM lineitem WHERE l_orderkey >= 5000) t WHERE l_suppkey = 7 GROUP BY l_linenumber",
    "rescan_keys": "SELECT k.n_nationkey AS v, count(c.c_custkey) AS cnt FROM nation k LEFT JOIN customer c ON c.c_nationkey = k.n_nationkey GROUP BY k.n_nationkey",
}
