import pytest

from sievewright.sources.storage import Store, clear_scratch, scratch_path, shared_dir, written


def test_written_tables_and_clearing(spark):
    df = written(spark.range(5), "five")
    assert df.count() == 5 and df.columns == ["id"]
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark)) and path != scratch_path(spark, "x")
    clear_scratch(spark)
    assert not any("sievewright-" + spark.sparkContext.applicationId == n for n in Store(spark, shared_dir(spark)).names())


def test_json_appears_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put_json("a.json", {"x": 1, "é": [None]})
    assert store.read_json("a.json") == {"x": 1, "é": [None]} and store.names() == ["a.json"]
    with pytest.raises(FileExistsError):
        store.put_json("a.json", {})
    seen = store.fingerprints([store.path("missing"), f"file:///{store.path('a.json').lstrip('/')}", store.path("a.json"), "/no/such/folder/x"])
    assert seen[0] is seen[3] is None and seen[1] == seen[2] and seen[1][0] > 10 and store.names() == ["a.json"]
