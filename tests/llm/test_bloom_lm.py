import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bytestrata.llm import bloom_lm
from bytestrata.llm.queries import op8_lm_scoring
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def expected(rows):
    train = Counter(t for _, x, learn in rows if learn for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, x, _ in rows:
        ts = tokens(x)
        out[i] = (len(ts), sum(train[t] > 0 for t in ts), n, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts))
    return out


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = expected(rows)
    got = op8_lm_scoring(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("p", [bloom_lm.Params(), bloom_lm.Params(vocabulary_mb=0), bloom_lm.Params(filter_mb=0, segment_tokens=8)])
def test_edges_and_paths_beyond_the_bounds(spark, p):
    rows = [(1, "The cat sat on the mat", True), (2, "the cat sat", False), (3, None, True), (4, " ", False), (5, "zzz " * 3000, False), (1, "The cat sat on the mat", True), (None, "the dog", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("row_key", F.lit("clash"))
    got = bloom_lm.score_documents(df, F.col("learn"), p).collect()
    want = expected(rows)
    assert len(got) == len(rows) and all(g.row_key == "clash" for g in got)
    for g in got:
        n, known, total, base = want[g.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total) and g.base_score == pytest.approx(base)
        assert g.score < 0
    assert bloom_lm.score_documents(df.where("false"), F.col("learn"), p).count() == 0


def model(rows):
    """A function of a text: its log10 probability by counts in dictionaries; and the sum of p(. | u) for every history u."""
    train = [tokens(x) for _, x, learn in rows if learn]
    one, two = Counter(t for x in train for t in x), Counter(g for x in train for g in zip([None, *x], x))
    n, v = sum(one.values()), len(one)
    read = {g: 2 ** (c.bit_length() - 1) for g, c in two.items()}
    s, t = Counter(), Counter()
    for (u, _), c in read.items():
        s[u] += c
        t[u] += 1

    def p(w, u):
        p1 = (one[w] + 1) / (n + v + 1)
        return (read.get((u, w), 0) + (one[u] - s[u] + t[u]) * p1) / (one[u] + t[u]) if one[u] else p1

    unknown = "a word that no text has"
    sums = [sum(p(w, u) for w in [*one, unknown]) for u in [*one, unknown]]
    return lambda x: sum(math.log10(p(w, u)) for u, w in zip([None, *tokens(x)], tokens(x))), sums


def test_scores_are_log_probabilities_on_every_path(spark):
    gen = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in gen.zipf(1.4, 30) % 25), i % 3 > 0) for i in range(80)] + [(100, "w1 unseen w2 words", False), (101, None, True), (102, "w1 " * 3000, True)]
    probability, sums = model(rows)
    assert sums == pytest.approx([1.0] * len(sums))
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumns({"_train": F.lit("clash"), "score": F.lit("clash"), "text_": F.lit(1)})
    for p in (bloom_lm.Params(probes=30), bloom_lm.Params(probes=30, segment_tokens=500, vocabulary_mb=0), bloom_lm.Params(probes=30, segment_tokens=500, filter_mb=0)):
        got = bloom_lm.score_documents(df, F.col("learn"), p).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx({i: probability(x) for i, x, _ in rows})
        assert all(r["_train"] == "clash" for r in got) and len(got) == len(rows)


def test_sums_of_counts_beyond_32_bits():
    import pyarrow as pa

    h, c = np.array([5, 9], np.uint64), np.array([2**32 - 1, 1], np.int64)
    cols = [[x] * 3 for x in bloom_lm._pack(h, c, 8)]
    row = bloom_lm.builder(5)((pa.scalar(0), pa.scalar(0)), pa.table(dict(zip(("singles", "manys", "counts", "histories"), cols))))
    assert np.frombuffer(row["b"][0].as_py(), "<u8").tolist() == [3 * (2**32 - 1), 3]


def test_filter_reads_back_quantised_counts():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = 1 + np.arange(len(h)) % 50
    seg = h >> np.uint64(62)
    rows = []
    for s in range(4):
        m = seg == s
        row = bloom_lm.builder(5)((__import__("pyarrow").scalar(1), __import__("pyarrow").scalar(s)), __import__("pyarrow").table({n: [x] for n, x in zip(("singles", "manys", "counts", "histories"), bloom_lm._pack(h[m], c[m], 6, h[m]))}))
        rows.append((s, row["a"][0].as_py()))
    size = np.array([8 * len(b) for _, b in rows], np.uint64)
    data = np.frombuffer(b"".join(b for _, b in rows), np.uint8)
    f = bloom_lm.Filter((size, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.uint64), data), 5)
    want = np.floor(np.log2(c)) + 1
    got = f.levels(h)
    assert (got >= want).all() and (got == want).mean() > 0.95
    other = f.levels(h + np.uint64(12345))
    assert (other == 0).mean() > 0.9


def test_nothing_is_broadcast_or_gathered_on_the_driver(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("the model goes through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    gen = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in gen.zipf(1.4, 30) % 25), i % 3 > 0) for i in range(80)] + [(100, None, False), (101, "unseen", False)]
    probability, _ = model(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = bloom_lm.score_documents(df, F.col("learn"), bloom_lm.Params(probes=30, segment_tokens=100, task_tokens=1)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: probability(x) for i, x, _ in rows})
