import re
from collections import defaultdict

import pytest
from compare import spark_rows, sql_rows

from sievewright.llm.mixing import OP7_SQL, mix_sources, op7_source_mixing, source_targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshared by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 900}, {"a": 0, "b": 10}, {None: 5, "z": 5, "Z": 7, "é": 1000, "k": 3}, {"x": 0}, {"only": 12}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def check(rows, out):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(dict(sizes))
    taken, longest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert len(out) == len(rows)


def test_odd_rows(make_docs, odd_rows):
    rows = [(*r[:2], "en", [None, "b", "a", "Z"][i % 4]) for i, r in enumerate(odd_rows)]
    check([(d, t, s) for d, t, _, s in rows], mix_sources(make_docs(rows)).collect())
    assert mix_sources(make_docs([])).count() == 0


def test_hot_source(make_docs):
    rows = [(i, "same words here", "en", "hot") for i in range(300)] + [(1000 + i, "w " * (i % 50), "en", f"s{i % 5}") for i in range(300)]
    check([(d, t, s) for d, t, _, s in rows], mix_sources(make_docs(rows)).collect())


def test_equals_its_sql(spark, sf_dir):
    assert spark_rows(op7_source_mixing(spark, sf_dir)) == sql_rows(OP7_SQL, sf_dir)


def test_reruns_agree(spark, sf_dir):
    assert spark_rows(op7_source_mixing(spark, sf_dir)) == spark_rows(op7_source_mixing(spark, sf_dir))
