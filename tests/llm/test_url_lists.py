import datetime as dt
import random

from compare import spark_rows, sql_rows

from sievewright.llm.url_lists import OP9_SQL, filter_captures, op9_temporal_url_filter

LIST_SCHEMA = "kind string, pattern string, category string, at date, action string"
CAPTURE_SCHEMA = "page_id long, url string, fetched date, host string, hit string, _row string, kind string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CAPTURE_SCHEMA)


def blocked(spark, rows, entries):
    out = filter_captures(captures(spark, rows), spark.createDataFrame(entries, LIST_SCHEMA)).collect()
    assert len(out) == len(rows)
    return {r["page_id"]: (r["blocked"], r["pattern"], r["category"]) for r in out}


def test_entries_hold_from_add_to_remove(spark):
    entries = [("domain", "Bad.example.org", "spam", day(10), "add"), ("domain", "bad.example.org", "spam", day(20), "remove"), ("domain", "bad.example.org", "spam", day(30), "add")]
    rows = [(i, "http://www.bad.example.org/x", day(i)) for i in (9, 10, 19, 20, 29, 30, 99)]
    got = blocked(spark, rows, entries + entries)
    assert {i: b for i, (b, _, _) in got.items()} == {9: False, 10: True, 19: True, 20: False, 29: False, 30: True, 99: True}


def test_same_day(spark):
    entries = [("host", "a.org", "x", day(1), "remove"), ("host", "a.org", "x", day(1), "add"), ("host", "b.org", "x", day(1), "add"), ("host", "b.org", "x", day(1), "add")]
    got = blocked(spark, [(1, "http://a.org", day(5)), (2, "http://b.org", day(5))], entries)
    assert not got[1][0] and got[2][0]


def test_kinds(spark):
    entries = [("domain", "d.org", "a", day(0), "add"), ("host", "h.org", "b", day(0), "add"), ("prefix", "p.org/a/b", "c", day(0), "add"), ("domain", "x.d.org", "z", day(0), "add")]
    urls = {
        "http://d.org": "d.org", "https://user:pw@x.d.org:8080/q?http://h.org": "x.d.org", "http://xd.org/": None, "http://h.org./p": "h.org", "http://w.h.org": None, "http://p.org/a/b": "p.org/a/b",
        "http://P.org/a/b/c?x#y": "p.org/a/b", "http://p.org/a/bc": None, "http://p.org//a//b": "p.org/a/b", "http://p.org/A/b": None, "no url": None, "http:///d.org": None, "": None,
    }
    got = blocked(spark, [(i, u, day(3)) for i, u in enumerate(urls)], entries)
    assert [got[i][1] for i in range(len(urls))] == list(urls.values())


def test_nulls_repeats_and_empty_tables(spark):
    entries = [("domain", "d.org", "a", day(0), "add"), (None, "d.org", "a", day(0), "add"), ("domain", "e.org", None, day(0), "add"), ("domain", "d.org", "b", None, "add")]
    rows = [(1, None, day(1)), (2, "http://d.org", None), (None, "http://d.org", day(1)), (3, "http://e.org", day(1)), (4, "http://d.org/" + "a/" * 5000, day(1))]
    got = blocked(spark, rows, entries)
    assert (got[1][0], got[2][0], got[None][0], got[3][0], got[4][0]) == (False, False, True, False, True)
    twice = filter_captures(captures(spark, [rows[2]] * 3), spark.createDataFrame(entries, LIST_SCHEMA))
    assert [r["blocked"] for r in twice.collect()] == [True] * 3
    assert not blocked(spark, rows, [])[None][0]
    assert filter_captures(captures(spark, []), spark.createDataFrame(entries, LIST_SCHEMA)).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = [".".join(rng.choice("abc") for _ in range(k)) + ".org" for k in (1, 1, 2, 2, 3, 3)]
    entries = [(rng.choice(["domain", "host"]), rng.choice(hosts), rng.choice("xy"), day(rng.randrange(30)), rng.choice(["add", "add", "remove"])) for _ in range(60)]
    rows = [(i, f"http://{rng.choice(hosts)}/p", day(rng.randrange(30))) for i in range(200)]

    def active(host, when):
        found = set()
        for kind, pattern, category in {e[:3] for e in entries}:
            if host == pattern or (kind == "domain" and host.endswith("." + pattern)):
                said = [e for e in entries if e[:3] == (kind, pattern, category) and e[3] <= when]
                if said and max(said, key=lambda e: (e[3], e[4]))[4] == "add":
                    found.add((-len(pattern), kind, category))
        return found

    out = filter_captures(captures(spark, rows), spark.createDataFrame(entries, LIST_SCHEMA)).collect()
    for r in out:
        found = active(r["host"], r["fetched"])
        assert r["blocked"] == bool(found)
        if found:
            assert min(found)[1:] == (r["kind"], r["category"])


def test_equals_its_sql(spark, sf_dir):
    assert spark_rows(op9_temporal_url_filter(spark, sf_dir)) == sql_rows(OP9_SQL, sf_dir)


def test_no_python_on_executors(spark, sf_dir):
    plan = op9_temporal_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
