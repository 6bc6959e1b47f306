import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievewright.functions.keys import UnsupportedKey, literal_keys, plain_key
from sievewright.operators import bitmaps, postings
from sievewright.operators.index import BitmapIndex, IndexCorrupt, IndexSpec, list_indexes
from sievewright.plans.predicates import Eq, In, IsNotNull, IsNull, Residual, all_of
from sievewright.sources.storage import Store
from sievewright.streaming.ingest import ingest

SCHEMA = "id long, a int, s short, b boolean, d date, f float, t string, v long"


def rows(n, first=0):
    out = []
    for i in range(first, first + n):
        f = [0.0, -0.0, float("nan"), 1.5, None][i % 5]
        out.append((i, None if i % 4 == 0 else i % 5, i % 3, i % 2 == 0, dt.date(2024, 1, 1 + i % 7), f, ["x", "y", "", None][i % 4], None if i % 6 == 0 else i))
    return out


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame(rows(300), SCHEMA).repartition(3).write.parquet(path)
    return path


@pytest.fixture
def index(spark, table, tmp_path):
    return BitmapIndex.build(spark, table, IndexSpec(["a", "s", "b", "d", "f", "t"], ["v"]), str(tmp_path / "index"))


def both(index, predicate):
    counts = {route: index.count(predicate, route).df.first()["cnt"] for route in ("native", "bitmap", "auto")}
    assert len(set(counts.values())) == 1, (predicate, counts)
    return counts["native"]


PREDICATES = [
    all_of(Eq("a", 3)), all_of(Eq("a", 99)), all_of(Eq("a", None)), all_of(In("a", [1, 1, None, 3])), all_of(In("a", [])), all_of(In("a", [None])),
    all_of(IsNull("a")), all_of(IsNotNull("a")), all_of(IsNull("a"), Eq("b", True)), all_of(IsNotNull("a"), Eq("b", False)), all_of(Eq("t", "x"), Eq("t", "y")),
    all_of(In("a", [1, 2, 3]), In("a", [3, 4])), all_of(Eq("f", 0.0)), all_of(Eq("f", -0.0)), all_of(Eq("f", float("nan"))), all_of(Eq("f", 1.5), IsNull("t")),
    all_of(Eq("d", dt.date(2024, 1, 3)), Eq("b", True), In("t", ["", "x"])), all_of(Eq("s", 65538)), all_of(Eq("s", 2)), all_of(IsNotNull("f")), all_of(Eq("t", "")),
    all_of(Eq("a", 1), Residual("v > 10")), all_of(Residual("a <> 3")), all_of(Residual("a NOT IN (1, 2)")), all_of(),
]


def test_routes_agree(index):
    for predicate in PREDICATES:
        both(index, predicate)


def test_counts_known(spark, tmp_path):
    data = [(g, None if g % 4 == 0 else g % 5) for g in range(1, 101)] + [(101, None), (102, 3)]
    path = str(tmp_path / "t")
    spark.createDataFrame(data, "id int, v int").write.parquet(path)
    index = BitmapIndex.build(spark, path, IndexSpec(["v"]), str(tmp_path / "i"))
    assert [both(index, all_of(p)) for p in (IsNull("v"), IsNotNull("v"), Eq("v", 3))] == [26, 76, 16]


def test_random_predicates(index):
    rng = random.Random(5)
    makers = {
        "a": lambda: rng.choice([Eq("a", rng.randrange(6)), In("a", [rng.randrange(6) for _ in range(3)]), IsNull("a"), IsNotNull("a"), Residual(f"a <> {rng.randrange(5)}")]),
        "s": lambda: rng.choice([Eq("s", rng.randrange(4)), In("s", [0, rng.randrange(4)])]),
        "t": lambda: rng.choice([Eq("t", rng.choice("xyz")), IsNull("t"), In("t", ["x", ""])]),
        "f": lambda: rng.choice([Eq("f", 0.0), IsNotNull("f"), In("f", [1.5, float("nan")])]),
    }
    for _ in range(12):
        both(index, all_of(*(makers[k]() for k in rng.sample(sorted(makers), rng.randrange(1, 4)))))


def test_life(spark, index, tmp_path):
    one, odd = all_of(Eq("a", 1)), all_of(Eq("b", False), IsNotNull("t"))
    before = both(index, one)
    index.append(spark.createDataFrame(rows(50, 300), SCHEMA))
    assert both(index, one) > before and index.stats().first()["pending_count"] == 50 and index.health().first()["health"] == "pending inserts"
    index.compact()
    index.assert_sound(True)
    held = both(index, odd)
    index.delete(all_of(Residual("id < 40")))
    assert both(index, odd) < held
    index.append(spark.createDataFrame(rows(10), SCHEMA))
    expected = sorted(r["id"] for r in index.table().filter(odd.condition()).collect())
    assert sorted(r["id"] for r in index.rows(odd, ["id"], "bitmap").df.collect()) == expected
    index.update(all_of(Eq("s", 2)), {"v": F.col("v") + 1000})
    total = index.sum("v", all_of(Eq("s", 2)), "native").df.first()
    assert index.sum("v", all_of(Eq("s", 2)), "bitmap").df.first() == total and total["s"] > 1000
    counted = index.table().count()
    index.compact()
    index.assert_sound(True)
    assert index.table().count() == counted == both(index, all_of(In("s", [0, 1, 2])))
    index.reindex()
    assert both(index, all_of(In("s", [0, 1, 2]))) == counted
    index.vacuum()
    index.assert_sound(True)
    assert list_indexes(spark, str(tmp_path)).count() == 1


def test_snapshot_stays(spark, index):
    pinned = index.count(all_of(Eq("s", 1)), "bitmap").df
    n = pinned.first()["cnt"]
    index.append(spark.createDataFrame(rows(30), SCHEMA))
    index.compact()
    assert pinned.first()["cnt"] == n < both(index, all_of(Eq("s", 1)))


def test_changed_files_are_scanned(spark, table, index):
    spark.createDataFrame(rows(5), SCHEMA).write.mode("overwrite").parquet(table)
    assert index.route(all_of(Eq("a", 1)), "bitmap")[0] == "native"


def test_projection_of_pinned_column(index):
    got = index.rows(all_of(Eq("t", "x"), IsNull("a")), ["t", "a", "v"], "bitmap").df.collect()
    assert got and all(r["t"] == "x" and r["a"] is None for r in got)
    assert index.index_only(all_of(Eq("t", "x")), ["t", "v"]) and not index.index_only(all_of(In("t", ["x"])), ["t"])


def test_no_more_than_bitmaps_is_broadcast(spark, tmp_path):
    """Not an id for each row found: at 36 million rows those were more than the driver's memory."""
    path, n = str(tmp_path / "t"), 200_000
    spark.range(n).select("id", (F.col("id") % 3).alias("k")).repartition(2).write.parquet(path)
    index = BitmapIndex.build(spark, path, IndexSpec(["k"]), str(tmp_path / "i"))
    df = index.sum("id", all_of(Eq("k", 1)), "bitmap").df
    assert tuple(df.collect()[0]) == (sum(range(1, n, 3)), len(range(1, n, 3)))
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = [int(float(r)) for r in re.findall(r"BroadcastQueryStage.*rowCount=([0-9.E+]+)", plan)]
    assert sent and max(sent) <= n // bitmaps.BUCKET_BITS + 2
    both = index.rids(all_of(Eq("k", 1))).join(index.rids(all_of(In("k", [1, 2]))), "rid", "left_semi")
    assert both.count() == len(range(1, n, 3)) and "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 10**9])
def test_rows_that_bitmaps_hold(spark, most):
    """Bits at the edges of bytes, words and buckets, full words and a full bucket."""
    size, rng = bitmaps.BUCKET_BITS, random.Random(3)
    held = {1, 8, 9, 64, 65, 128, size, size + 1, 2 * size, *range(3 * size + 1, 4 * size + 1), *range(4 * size + 65, 4 * size + 129), (5 << 40) + 1, (5 << 40) + size, *(rng.randrange(5 * size, 7 * size) for _ in range(500))}
    every = spark.range(1, 8 * size).unionByName(spark.range(5 << 40, (5 << 40) + 2 * size)).select(F.col("id").alias("rid"), F.lit("x").alias("bm"))
    sets = bitmaps.from_rids(spark.createDataFrame([(i,) for i in held], "rid long"))
    assert {r["rid"] for r in bitmaps.holding(every, sets, most).collect()} == held


@pytest.mark.parametrize("most", [0, bitmaps.BROADCAST_BUCKETS])
def test_rows_by_either_join(spark, index, monkeypatch, most):
    """With pending and deleted rows, and a condition that nothing can meet."""
    monkeypatch.setattr(bitmaps, "BROADCAST_BUCKETS", most)
    index.append(spark.createDataFrame(rows(50, 300), SCHEMA))
    index.delete(all_of(Residual("id % 7 = 0")))
    for predicate in (all_of(Eq("a", 1)), all_of(Eq("b", False), IsNotNull("t")), all_of(IsNull("a")), all_of(In("a", [])), all_of(Eq("s", 2), In("a", [1, 3]))):
        want, got = (sorted(map(str, index.rows(predicate, ["id", "v", "a"], route).df.collect())) for route in ("native", "bitmap"))
        assert got == want


def test_null_payload_stays_null(index):
    r = index.sum("v", all_of(Eq("s", 0)), "bitmap").df.first()
    expected = [x[7] for x in rows(300) if x[2] == 0 and x[7] is not None]
    assert (r["s"], r["n"]) == (sum(expected), len(expected))
    assert index.sum("v", all_of(Eq("a", 99)), "bitmap").df.first()["s"] is None


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    index = BitmapIndex.build(spark, path, IndexSpec(["a", "t"]), str(tmp_path / "i"))
    index.assert_sound(True)
    assert both(index, all_of(Eq("a", 1))) == both(index, all_of(Eq("a", 1), IsNull("t"))) == 0
    index.append(spark.createDataFrame(rows(20), SCHEMA))
    assert both(index, all_of(Eq("a", 1))) > 0
    index.compact()
    index.assert_sound(True)


def test_many_values_are_listed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6000).selectExpr("id", "id % 3 AS g").write.parquet(path)
    index = BitmapIndex.build(spark, path, IndexSpec(["id", "g"]), str(tmp_path / "i"))
    assert index.manifest["dense"] == [2]
    assert both(index, all_of(In("id", [3, 4, 6001]), Eq("g", 0))) == 1 and both(index, all_of(Eq("id", 17))) == 1
    index.assert_sound(True)


def test_corruption_is_found(spark, index):
    p = index.postings()
    broken = p.withColumn("card", F.col("card") + F.when(F.col("attno") == 1, 1).otherwise(0))
    broken.write.parquet(index.store.path("postings/broken"))
    index._commit(postings="postings/broken")
    with pytest.raises(IndexCorrupt):
        index.assert_sound()


def test_limits(spark, table, tmp_path):
    with pytest.raises(ValueError):
        BitmapIndex.build(spark, table, IndexSpec(["a"]), str(tmp_path / "x"), threshold=10)
    path = str(tmp_path / "nested")
    spark.sql("SELECT array(1) AS a").write.parquet(path)
    with pytest.raises(UnsupportedKey):
        BitmapIndex.build(spark, path, IndexSpec(["a"]), str(tmp_path / "y"))
    assert plain_key(65539, "smallint") == (True, None) and plain_key("3", "int") == (False, None)


def test_literals_of_other_types(spark, index):
    """Every kind of key against every kind of literal: the index answers as the scan does, or leaves it to the scan."""
    literals = [3, 2**40, 3.0, 0.1, -0.0, "3", "x", "2024-01-03", True, dt.date(2024, 1, 3), Decimal("1.50")]
    answered = 0
    for k, key in enumerate(("a", "s", "b", "d", "f", "t")):
        for i, value in enumerate(literals):
            predicate = all_of(In(key, [value, None]) if (i + k) % 2 else Eq(key, value))
            # A column plus nothing isn't pushed into the scan; types are as in a plain comparison.
            column = F.coalesce(F.col(key), F.col(key)) if key != "f" else F.col(key) + F.lit(0.0).cast("float")
            try:
                expected = index.table().filter(column == F.lit(value)).count()
            except PySparkException:
                assert index.route(predicate, "bitmap")[0] == "native", predicate
                continue
            answer = index.count(predicate, "bitmap")
            answered += answer.route == "bitmap"
            assert answer.df.first()["cnt"] == expected == index.count(predicate, "native").df.first()["cnt"], (predicate, answer.route)
    assert answered > 20
    assert literal_keys(spark, [0.1], "float") == [] and literal_keys(spark, [1.5], "float") == ["1.5"] and literal_keys(spark, ["3"], "string") == ["3"]


@pytest.mark.parametrize("stored", [[-0.0], [0.0], [-0.0, 1.5], [0.0, -0.0, float("nan")]])
def test_stored_signed_zeros(spark, tmp_path, stored):
    """Files that hold one zero only: statistics and dictionaries tell them apart, an equality must not."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, stored[i % len(stored)], float(stored[i % len(stored)]), i % 2) for i in range(100)], "id int, f float, g double, a int").coalesce(1).write.parquet(path)
    index = BitmapIndex.build(spark, path, IndexSpec(["f", "g", "a"], ["id"]), str(tmp_path / "i"))
    n = sum(stored[i % len(stored)] == 0 for i in range(100))
    for key in ("f", "g"):
        for p in (Eq(key, 0.0), Eq(key, 0), In(key, [-0.0, 7.0])):
            assert both(index, all_of(p)) == n, (key, p)
        assert both(index, all_of(Eq(key, 0.0), Eq("a", 0))) == sum(stored[i % len(stored)] == 0 for i in range(0, 100, 2))
        assert index.table().filter(Eq(key, 0.0).condition()).count() == n
        shown = index.rows(all_of(Eq(key, 0.0)), [key, "id"], "bitmap").df.collect()
        assert sorted((str(r[key]), r["id"]) for r in shown) == sorted((str(stored[i % len(stored)]), i) for i in range(100) if stored[i % len(stored)] == 0)


def test_update_is_one_generation(spark, index):
    total, generation = index.table().count(), index.manifest["generation"]
    index.update(all_of(Eq("s", 2)), {"v": F.lit(-5).cast("long")})
    assert index.manifest["generation"] == generation + 1 and index.table().count() == total
    assert index.table().filter("v = -5").count() == both(index, all_of(Eq("s", 2)))


def test_streams_keep_their_own_numbers(spark, index, tmp_path):
    n = index.table().count()
    for i in (1, 2):
        source = str(tmp_path / f"source{i}")
        spark.createDataFrame(rows(10, 1000 * i), SCHEMA).write.parquet(source)
        ingest(spark.readStream.schema(SCHEMA).parquet(source), index, str(tmp_path / f"checkpoint{i}")).awaitTermination(120)
    assert index.table().count() == n + 20
    # The same stream, with a batch more.
    spark.createDataFrame(rows(5, 5000), SCHEMA).write.mode("append").parquet(str(tmp_path / "source1"))
    ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "source1")), index, str(tmp_path / "checkpoint1")).awaitTermination(120)
    assert index.table().count() == n + 25
    # A batch that comes again adds nothing; one whose commit failed adds its rows once.
    (stream, last), generation = sorted(index.manifest["streams"].items())[0], index.manifest["generation"]
    index.append(spark.createDataFrame(rows(5, 9000), SCHEMA), stream, last)
    assert index.table().count() == n + 25 and index.manifest["generation"] == generation
    commit = index._commit

    def fails(**changes):
        raise OSError("lost")

    index._commit = fails
    with pytest.raises(OSError):
        index.append(spark.createDataFrame(rows(5, 9000), SCHEMA), stream, last + 1)
    index._commit = commit
    index.append(spark.createDataFrame(rows(5, 9000), SCHEMA), stream, last + 1)
    assert index.table().count() == n + 30


def test_second_writer_fails(spark, index):
    other = BitmapIndex(spark, index.store.root)
    index.append(spark.createDataFrame(rows(10), SCHEMA))
    with pytest.raises(FileExistsError):
        other.append(spark.createDataFrame(rows(7), SCHEMA))
    other.refresh()
    assert other.table().count() == 310


def test_vacuum_leaves_used_folders_only(spark, index):
    for i in range(3):
        index.append(spark.createDataFrame(rows(10, 1000 * i), SCHEMA))
    index.delete(all_of(Eq("s", 1)))
    index.compact()
    index.update(all_of(Eq("s", 2)), {"v": F.lit(1).cast("long")})
    index.vacuum()
    left = index.table().count()
    store = lambda kind: Store(spark, index.store.path(kind)).names()
    assert len(store("data")) == 2 and len(store("tombstones")) == 1 and len(store("postings")) == 1
    assert [x for x in index.store.names() if x.startswith((".", "manifest"))] == [f"manifest-{index.manifest['generation']:08d}.json"]
    assert BitmapIndex(spark, index.store.root).table().count() == left == both(index, all_of(In("s", [0, 2])))

def test_threshold_and_background_merge(spark, index):
    index.set_threshold(1000)
    index.append(spark.range(1200).selectExpr("id", "1 AS a", "CAST(1 AS SHORT) s", "true b", "DATE '2024-01-01' d", "CAST(1 AS FLOAT) f", "'x' t", "id v"))
    assert index.health().first()["health"] == "merge overdue"
    index.compact_if_due().join()
    assert index.health().first()["health"] == "ok" and both(index, all_of(Eq("a", 1), Eq("t", "x"))) >= 1200


def test_changing_keys(spark, index):
    got = {r["v"]: r["cnt"] for r in index.count_many(spark.createDataFrame([(1,), (2,), (77,)], "v int"), "a").collect()}
    assert got == {1: both(index, all_of(Eq("a", 1))), 2: both(index, all_of(Eq("a", 2))), 77: 0}


def test_set_algebra(spark):
    a, b = ({*range(1, 70_000, 3)}, {*range(1, 70_000, 7), 1 << 41})
    make = lambda s: bitmaps.from_rids(spark.createDataFrame([(x,) for x in sorted(s)], "rid long"))
    x, y = make(a), make(b)
    ids = lambda df: {r["rid"] for r in df.collect()}
    assert ids(bitmaps.to_rids(x)) == a
    assert ids(bitmaps.to_rids(bitmaps.union(x, y))) == a | b and ids(bitmaps.to_rids(bitmaps.intersection(x, y))) == a & b
    assert ids(bitmaps.difference_rids(x, y)) == a - b and bitmaps.count_difference(x, y).first()["cnt"] == len(a - b)
    assert bitmaps.count(x.limit(0)).first()["cnt"] == 0


def test_absent_buckets_are_empty(spark, index):
    assert postings.lookup(index.postings(), all_of(Eq("a", 99), Eq("s", 1)), index.keys) is not None
    assert both(index, all_of(Eq("a", 99), Eq("s", 1))) == 0


def test_stream(spark, index, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame(rows(25, 1000), SCHEMA).write.parquet(source)
    n = both(index, all_of(Eq("s", 1)))
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    ingest(stream, index, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert both(index, all_of(Eq("s", 1))) == n + sum(r[2] == 1 for r in rows(25, 1000))


def test_where_clauses(spark, index):
    texts = {
        "a = 3": all_of(Eq("a", 3)),
        "3 = a AND t IN ('x', NULL, 'x') AND b = true": all_of(Eq("a", 3), In("t", ["x"]), Eq("b", True)),
        "a IS NULL AND f IS NOT NULL AND d = DATE '2024-01-03'": all_of(IsNull("a"), IsNotNull("f"), Eq("d", dt.date(2024, 1, 3))),
        "a = NULL": all_of(Eq("a", None)),
        "b AND NOT b AND f = CAST(1.5 AS FLOAT) AND a = -3": all_of(Eq("b", True), Eq("b", False), Eq("f", 1.5), Eq("a", -3)),
        "a = 65538 AND s = 65538": all_of(Eq("a", 65538), Eq("s", 65538)),
    }
    for text, predicate in texts.items():
        assert index.where(text) == predicate
    for text in ("a > 3", "a <> 3", "a NOT IN (1, 2)", "NOT a = 3", "a = 1 OR s = 2", "t LIKE 'x%'", "a BETWEEN 1 AND 2", "a = s", "a + 1 = 2", "a <=> NULL", "v = 1", "a = rand()"):
        assert not index.where(text).indexable(index.keys)
    for text in (*texts, "a <> 3 AND s = 1", "a = 1 OR s = 2", "NOT (a = 3) AND t = 'x'", "a BETWEEN 1 AND 2 AND b = true"):
        expected = index.table().filter(text).count()
        assert both(index, index.where(text)) == expected
