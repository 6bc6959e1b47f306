import base64
import hashlib

import pytest

from sievewright.llm import archives
from sievewright.llm.archives import arc_file, http_parts, op10_legacy_archives, read_arc, read_archives, read_warc, warc_date, warc_record, write_archives

SCHEMA = "page_id long, url string, html string, first_id string, value string, content string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, smallest=0):
    """Of each payload the least page is the response, and of its rows the first."""
    first = {}
    for i, (page, _, html) in enumerate(rows):
        own = (page is None, page or 0, i)
        first[html or ""] = min(own, first.get(html or "", own))
    out = []
    for i, (page, _, html) in enumerate(rows):
        h = html or ""
        late, least, row = first[h]
        again = row != i and len(h.encode()) >= smallest
        out.append((page, len(h.encode()), digest(h), "revisit" if again else "response", least if again and not late else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


ROWS = [
    (1, "http://a.org/x y", "<p>one</p>"), (7, "http://b.org", "<p>one</p>"), (3, None, None), (4, "http://c.org", ""), (None, "http://d.org", "<p>é日本\r\n\r\nWARC/1.1\r\n\r\n</p>"),
    (9, "http://e.org", "<p>é日本\r\n\r\nWARC/1.1\r\n\r\n</p>"), (5, "http://f.org\nline", "x" * 300_000), (6, "", "\n\n\r\n"), (2, "http://a.org", "<p>one</p>"), (2, "http://a.org", "<p>one</p>"), (-4, "u", "HTTP/1.1 500\r\n\r\n"),
]


@pytest.mark.parametrize("smallest", [0, 5, 12])
def test_odd_rows(spark, tmp_path, smallest):
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in ROWS], SCHEMA)
    write_archives(pages, str(tmp_path / "w"), smallest)
    found = read_archives(spark, str(tmp_path / "w"))
    assert got(found) == expected(ROWS, smallest)
    assert found.select("record_id").distinct().count() == len(ROWS)


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert read_archives(spark, str(tmp_path / "w")).count() == 0


def test_many_copies(spark, tmp_path):
    rows = [(i, "http://h.org", "copied" if i % 3 else f"own {i}") for i in range(3000)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    assert got(read_archives(spark, str(tmp_path / "w"))) == expected(rows)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op10_legacy_archives(spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"", b"plain", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npayload\n\nhttp://fake 1 2 3 4\n", bytes(range(256))]
    made = [({"URL": f"http://x/{i}", "IP-address": "1.2.3.4", "Archive-date": "20080102030405", "Content-type": "text/html", "Result-code": "200"}, b) for i, b in enumerate(blocks)]
    found = list(read_arc(arc_file(version, "20080101", made)))
    assert [b for _, b in found] == blocks and [f["URL"] for f, _ in found] == [m["URL"] for m, _ in made]
    assert ("Result-code" in found[0][0]) == (version == 2)


def test_broken_arcs_are_refused():
    good = arc_file(1, "20080101", [({"URL": "u", "Archive-date": "2008"}, b"0123456789")])
    for bad in (good[:-4], b"no version block\n", good.replace(b"1 0 ", b"9 0 ")):
        with pytest.raises((ValueError, KeyError)):
            list(read_arc(bad))


def test_broken_warcs_are_refused():
    record = warc_record("response", "u", "2008-01-01T00:00:00Z", "-", 1, 0, "D", b"", b"payload", None) + b"\r\n\r\n"
    assert [b for _, b in read_warc(record * 2)] == [b"payload"] * 2
    for bad in (record[:-6], b"x" + record, record[:20]):
        with pytest.raises(ValueError):
            list(read_warc(bad))


def test_parts_and_dates():
    assert http_parts(b"HTTP/1.1 200\r\n\r\nx") == (b"HTTP/1.1 200\r\n\r\n", b"x") and http_parts(b"x\r\n\r\ny") == (b"", b"x\r\n\r\ny") and http_parts(b"HTTP/1.1 1") == (b"HTTP/1.1 1", b"")
    assert warc_date("20080102030405") == "2008-01-02T03:04:05Z" and warc_date("2008") == "2008-01-01T00:00:00Z" and warc_date("200811") == "2008-11-01T00:00:00Z"
    assert archives.record_id("a", 1) == archives.record_id("a", 1) != archives.record_id("a", 2)
