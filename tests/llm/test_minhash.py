import re

import pandas as pd
from bytestrata.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(rows, p):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + p.shingle]) for i in range(len(w) - p.shingle + 1)} if len(w) >= p.shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or (u and sets[i] and sets[j] and p.den * len(sets[i] & sets[j]) >= p.num * u)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low.get(find(i)), d is None or low[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def got(spark, rows, p, extra=False):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), "doc_id long, text string") if rows else spark.createDataFrame([], "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({"rep": F.lit(1), "key": F.lit("x"), "bands": F.lit(2)})
    return sorted(tuple(r) for r in minhash.near_duplicates(df, p).collect() if r[0] is not None)


def test_documents_against_brute_force(spark):
    p = minhash.Params(shingle=3, num=85)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(spark, rows, p) == brute(rows, p)


def test_chains_large_buckets_and_edge_cases(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 20])) for i in range(100, 140)]  # many similar, not all to the smallest
    rows += [(i, " ".join(base[:59] + [f"t{i}"])) for i in range(200, 230)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "É a b"), (8, "é a b"), (9, "x " * 50000), (10, "x x x")]
    for p in (minhash.Params(shingle=3, num=85), minhash.Params()):
        assert got(spark, rows, p, extra=True) == brute(rows, p)


def test_rest_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    rows += [(i, " ".join(base[:70] + [f"{i % 3}x{k}" for k in range(12)])) for i in range(1, 25)]
    p = minhash.Params(shingle=3, num=85)
    assert got(spark, rows, p) == brute(rows, p)


def test_words_made_to_defeat_polynomial_hashes(spark):
    t, u = "a", "b"
    for _ in range(11):
        t, u = t + u, u + t
    rows = [(1, f"{t} {t} {t}"), (2, f"{u} {u} {u}"), (3, f"{t} {t} {t}")]
    p = minhash.Params(shingle=3, num=85)
    assert got(spark, rows, p) == brute(rows, p) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_empty_table_and_null_ids(spark):
    assert got(spark, [], minhash.Params()) == []
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    out = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out) == [(False, 3, True), (True, None, True), (True, None, True)]


def test_repeated_ids_with_different_texts(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    p = minhash.Params(shingle=3, num=85)
    rows = [(1, a), (2, b), (5, a), (5, b), (3, c), (5, c + " end")]  # 5 represents no class of 1 and 2, and joins them
    assert got(spark, rows, p) == brute(rows, p)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "CENTRES", 1)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    rows += [(i, " ".join(base[:70] + [f"{i % 12}x{k}" for k in range(12)] + [f"end{i}"])) for i in range(1, 25)]
    rows += [(i, f"{a} {x} {i}") for i in range(1, 7) for x in ("m", "n")]
    assert got(spark, rows, p) == brute(rows, p)
