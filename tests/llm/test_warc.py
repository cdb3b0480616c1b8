import base64
import hashlib

import pytest
from bytestrata.llm import warc
from bytestrata.llm.queries import op3_warc
from pyspark.sql import functions as F


def expected(rows, least=0):
    head = {}
    for i, _, h in rows:
        if i is not None:
            head[h or ""] = max(head.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = head.get(h or "") if len(b) >= least else None
        to = None if to == i else to
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


ROWS = [(1, "http://a.example.org/x", "<p>é</p>"), (2, "http://a.example.org/x", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "not a url \n\r", "x" * 300_000), (6, "http://[bad", "y\r\n\r\nz"), (7, "https://B.example.org:8080/q?u=1", "<p>é</p>"), (7, "https://B.example.org:8080/q?u=1", "<p>é</p>"), (None, "http://a", "solo"), (None, "http://a", "<p>é</p>")]


@pytest.mark.parametrize("p", [warc.Params(), warc.Params(block_entries=1, range_entries=2, archive=1000, read=1), warc.Params(least=5)])
def test_edges(spark, p):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"key": F.lit(1), "file": F.lit("f")})
    assert sorted((tuple(r) for r in warc.round_trip(df, p).collect()), key=repr) == expected(ROWS, p.least)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op3_warc(spark, d).collect()), key=repr) == expected(rows)


def test_index_finds_chosen_pages_only(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    root, entries, blocks = warc.write(df, warc.Params(block_entries=3, range_entries=20))
    some = df.where("page_id % 7 = 0").select("page_id", "url").unionByName(spark.createDataFrame([(10**6, "http://nowhere.example/")], "page_id long, url string"))
    found = warc.capture_lookup(root, blocks, some)
    assert sorted(r.page_id for r in found.collect()) == sorted(r.page_id for r in df.where("page_id % 7 = 0").collect())


def test_keys():
    assert warc.surt("http://www.Example.org:8080/a/b?c=d#e") == "org,example,www:8080)/a/b?c=d"
    assert warc.surt(None) == ")/"
