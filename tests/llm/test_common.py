import random
from collections import defaultdict

from sievewright.llm.common import joined_small, ranked, written


def test_ranks_have_no_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(6)]), i) for i in range(700)]
    out = ranked(spark.createDataFrame(rows, "g string, o int, id int"), ["o"], ["g"]).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r["g"]].append((r["rank"], (r["o"] is not None, r["o"] or 0)))
    assert sorted(r["id"] for r in out) == list(range(700))
    for found in groups.values():
        found.sort()
        assert [r for r, _ in found] == list(range(len(found))) and [o for _, o in found] == sorted(o for _, o in found)


def test_ranks_without_group_and_of_nothing(spark):
    assert sorted((r["id"], r["rank"]) for r in ranked(spark.range(50).selectExpr("50 - id AS id"), ["id"]).collect()) == [(i, i - 1) for i in range(1, 51)]
    assert ranked(spark.range(0), ["id"]).count() == 0


def test_joins_are_null_safe_with_and_without_broadcast(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = written(spark.createDataFrame([(1, 10), (None, 20)], "k int, w int"), "right")
    for most in (100, 0):
        assert sorted(map(tuple, joined_small(left, right, ["k"], "left", most).collect()), key=str) == [(1, "a", 10), (3, "c", None), (None, "b", 20)]
        assert {r["v"] for r in joined_small(left, right, ["k"], "left_semi", most).select("v").collect()} == {"a", "b"}
    plan = lambda most: joined_small(left, right, ["k"], "inner", most)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(100)
