import glob
import hashlib
import os

import duckdb
import pytest

from tallyframe.llm import warc
from tallyframe.llm.common import fresh_path, mounted
from tallyframe.llm.warc import OP7_SQL, Index, build_index, parse, read_archive, round_trip, url_key, write_archives


def test_url_keys():
    assert url_key("https://Blog.Example.com:443/a?b=1#c") == "com,example,blog)/a?b=1"
    assert url_key("http://example.com") == "com,example)/"
    assert url_key("http://example.com:8080/x y") == "com,example:8080)/x%20y"
    assert url_key(None) == "-" and url_key("") == "-" and url_key("http://[bad") == "http://[bad"


def make(spark, n=600):
    body = "<p>" + "x" * 200
    rows = [(k, f"http://h{k % 7}.example.com/{k % 50}", f"{body}{k % 40}" if k % 3 else f"s{k % 5}", k) for k in range(n)]
    rows += [(5000, None, None, 1), (5001, "http://[bad", "é" * 60, 1), (5002, "http://a b.c/ d", "é" * 60, 1), (5003, "http://a.b/\n", "z" * 300_000, 1)]
    rows += [(5004, "u", "same" * 30, 1)] * 2
    rows += [(6000, "http://a.b/x\ny", "W" * 200, 1), (6001, None, "W" * 200, 1), (6002, " \t", "V" * 200, 1), (6003, "http://c.d", "V" * 200, 1)]
    rows += [(7000 + k, "http://one.example.com/hot", "H" * 300 if k % 2 else f"{'h' * 200}{k}", 1) for k in range(120)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest long")


def test_round_trip_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    pages = make(spark)
    pages_arrow = pages.toArrow()  # noqa: F841
    want = duckdb.sql(OP7_SQL.replace("FROM pages", "FROM pages_arrow")).fetchall()
    got = [tuple(r) for r in round_trip(pages.repartition(6)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert round_trip(pages.limit(0)).count() == 0


def test_missing_ids(spark):
    pages = spark.createDataFrame([(None, "u", "y" * 200), (3, "v", "y" * 200), (None, "w", "q" * 200), (None, "w", "q" * 200)], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in round_trip(pages).collect()), key=str)
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 3), (3, "response", None)]


def test_a_damaged_response_is_noticed_through_its_revisits(spark):
    folder = mounted(fresh_path(spark, "warc-test"))
    os.makedirs(folder)
    pages = spark.createDataFrame([(1, "http://a.b/1", "y" * 200), (2, "http://a.b/2", "y" * 200)], "page_id long, url string, html string").coalesce(1)
    captures = write_archives(pages, folder)
    files = build_index(captures, folder)
    place = captures.filter("page_id = 1").first()
    path = f"{folder}/{place.archive}"
    with open(path, "rb") as f:
        data = bytearray(f.read())
    wrong = warc._member(warc.record(1, "http://a.b/1", b"z" * 200, hashlib.sha256(b"y" * 200).hexdigest(), None, False))
    with open(path, "wb") as f:
        f.write(data[: place.offset] + wrong.ljust(place.length, b"\0")[: max(place.length, len(wrong))] + data[place.offset + place.length :])
    revisit = captures.filter("page_id = 2")
    with pytest.raises(Exception, match="damaged record|incorrect|invalid|Error"):
        warc.read_back(revisit, folder, files).collect()


def test_a_repeated_task_leaves_files_of_its_own(spark, tmp_path):
    """The first attempt at each task fails after it has written; the lost files are named by no capture."""
    folder = mounted(fresh_path(spark, "warc-test"))
    os.makedirs(folder)
    captures = write_archives(make(spark, 60).repartition(3), folder)
    again = write_archives(make(spark, 60).repartition(3), folder)  # the same partitions, other attempts
    one, two = ({r.archive for r in c.select("archive").distinct().collect()} for c in (captures, again))
    assert one and two and not one & two
    files = build_index(captures, folder)
    assert warc.read_back(captures, folder, files).count() == captures.count()


def test_lists_of_lists_lead_to_every_capture(spark, monkeypatch):
    """Many small index files under lists of two: several levels, a hot key over many files, pages without id."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "FILE_LINES", 40)
    monkeypatch.setattr(warc, "LIST_FILES", 2)
    folder = mounted(fresh_path(spark, "warc-test"))
    os.makedirs(folder)
    pages = make(spark, 200).select("page_id", "url", "html").union(spark.createDataFrame([(None, "http://one.example.com/hot", "n" * 200)] * 30 + [(7050, "http://one.example.com/hot", "r")] * 30, "page_id long, url string, html string"))
    captures = write_archives(pages, folder)
    files = build_index(captures, folder)
    assert len(files) <= 2 and len(glob.glob(f"{folder}/*.directory")) > 16 and len(glob.glob(f"{folder}/*.list")) > 10
    rows, index = captures.collect(), Index(folder, files)
    for r in rows:
        assert (r.archive, r.offset) in {(c["archive"], c["offset"]) for c in index.captures_of(r.key, r.page_id)}
    for key in {r.key for r in rows}:
        assert sorted((c["archive"], c["offset"]) for c in index.captures(key)) == sorted((r.archive, r.offset) for r in rows if r.key == key)
    assert warc.read_back(captures, folder, files).count() == len(rows)


def test_archives_and_lookups(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    folder = mounted(fresh_path(spark, "warc-test"))
    os.makedirs(folder)
    captures = write_archives(make(spark), folder)
    files = build_index(captures, folder)
    assert not glob.glob(f"{folder}/*.part")
    index = Index(folder, files)
    want = {(r.page_id, r.offset) for r in captures.filter("key = 'com,example,h3)/10'").collect()}
    assert len(want) > 1 and {(c["page_id"], c["offset"]) for c in index.captures("com,example,h3)/10")} == want
    assert list(index.captures("com,example,h3)/none")) == []
    some = captures.filter("page_id in (7003, 5004)").collect()
    assert len(some) == 3
    for r in some:
        assert (r.archive, r.offset) in {(c["archive"], c["offset"]) for c in index.captures_of(r.key, r.page_id)}
    assert list(index.captures_of("com,example,one)/hot", 1)) == []
    seen = 0
    for path in glob.glob(f"{folder}/*.warc.gz"):
        for _, _, content in read_archive(path):
            fields, http, payload = parse(content)
            seen += 1
            if fields["WARC-Type"] == "response":
                assert hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"][7:] and len(payload) == int(http["Content-Length"])
    assert seen == captures.count()
