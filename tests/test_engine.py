import struct

import pytest
from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect
from bytestrata.plans.queries import ORACLES, QUERIES

from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])


WAV = b"RIFF" + struct.pack("<I", 44) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 8) + bytes(8)
GZIP = b"\x1f\x8b\x08\x08\0\0\0\0\0\x03hello.txt\0DATA" + struct.pack("<II", 0xDEADBEEF, 42)
FLAC = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 4096, 4096) + b"\0\0\x10\0\0\x20" + bytes.fromhex("0ac442f0000003e8") + b"\xab" * 16 + b"\xff\xf8\1\2"
SQLITE = b"SQLite format 3\0" + struct.pack(">HBBBBBBII", 1, 1, 1, 0, 64, 32, 32, 5, 10) + bytes(88)
WEBP = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\x12\0\0\0\x09\0\0\x04\0\0"


def labels(kind, data):
    return {(r[3], r[4], r[5]) for r in flat(dissect(kind, data))}


@pytest.mark.parametrize(
    ("kind", "data", "some"),
    [
        ("WAV", WAV, {("Chunk: fmt ", 12, 36), ("Audio format: PCM", 20, 22), ("Sample rate: 44100", 24, 28), ("Data", 44, 52)}),
        ("Gzip", GZIP, {("Original file name: hello.txt", 10, 20), ("CRC-32: 0xdeadbeef", 24, 28), ("Input size (mod 2^32): 42", 28, 32), ("OS: Unix", 9, 10)}),
        ("FLAC", FLAC, {("Sample rate: 44100 Hz, Channels: 2, Bits per sample: 16, Total samples: 1000", 18, 26), ("Audio frames", 42, 46), ("Maximum frame size: 32", 15, 18)}),
        ("SQLite", SQLITE, {("page_size: 65536", 16, 18), ("database_size_pages: 10", 28, 32), ("Database pages", 100, len(SQLITE))}),
        ("WebP", WEBP, {("Feature flags: alpha, animation", 20, 21), ("Canvas width: 10", 24, 27), ("Canvas height: 5", 27, 30)}),
    ],
)
def test_labels_and_every_truncation(kind, data, some):
    assert some <= labels(kind, data)
    for n in range(len(data)):
        flat(dissect(kind, data[:n]))


@pytest.mark.parametrize("name", ["missing_offsets", "offset_lookup", "parent_links"])
def test_no_block_table_goes_through_the_driver(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_offset_lookup_stays_off_the_driver_while_it_runs(spark):
    """Nor does Spark turn its joins into broadcasts once it knows the sizes."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = QUERIES["offset_lookup"](spark, "/root/testdata/sf0.001")
        assert len(found.collect()) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    final = plan.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and final.count("SortMergeJoin") == 2 and "Broadcast" not in final
