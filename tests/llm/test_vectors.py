import numpy as np
import pytest
from bytestrata.llm import hnsw, kdtree
from bytestrata.llm.queries import op2_embedding_near_dedup
from pyspark.sql import functions as F

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"shard": F.lit(1), "v": F.lit(2)})


def brute_top(rows, k=5):
    able = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in able:
        if i % 50 == 0:
            s = sorted((-int(q @ v), j) for j, v in able if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def brute_near(rows, t=0.93):
    able = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, x, la in able:
        for b, y, lb in able:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links[a].add(b)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = i if i is None else min(seen)
        out.append((i, len(links[i]), low, low == i))
    return sorted(out, key=repr)


def near(spark, rows, p=hnsw.Params()):
    out = hnsw.near_duplicates(frame(spark, rows), p).collect()
    assert all(r.audit_hits == r.audit_links > 0 for r in out)
    return sorted((tuple(r)[:4] for r in out), key=repr)


def rows_with_groups(seed=1, n=400, groups=6):
    gen = np.random.default_rng(seed)
    heads = gen.normal(size=(groups, 16))
    rows = []
    for i in range(n):
        base = heads[i % groups] if i % 3 else gen.normal(size=16)
        rows.append((i, [float(x) for x in np.float32(base + gen.normal(size=16) * gen.choice([0.01, 0.2, 0.35]))], int(i % 2)))
    return rows


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 0), (1003, [NAN] * 16, 1), (1004, [None] * 16, 1), (1005, [1.0] * 16, None), (1050, [2.0, 1.0], 1), (1006, [2.0, 1.0], 1), (1100, [float("inf")] * 16, 0)]


@pytest.mark.parametrize("p", [kdtree.Params(), kdtree.Params(shard_rows=60, leaf=4)])
def test_top_k_equals_brute_force(spark, p):
    rows = rows_with_groups() + ODD
    got = kdtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, p).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)


def test_top_k_ties_few_rows_and_huge_values(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(0, 8)] + [(None, [1.0, 2.0], 0)]
    got = kdtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, kdtree.Params(leaf=1)).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)
    rows = [(0, [1e9, 3.0], 0), (1, [1e9, 2.0], 0), (2, [1e-9, 2.0], 0)]
    got = kdtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2]
    assert kdtree.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_beyond_doubles_go_to_the_smaller_id_in_every_shard(spark):
    rows = [(i, [2.0**19, 1 / 256, 1 / 256, 1 / 256], 0) for i in range(40)]
    got = kdtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, kdtree.Params(shard_rows=8)).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(k, k) for k in range(1, 6)] and {r.score for r in got} == {2**54 + 3}


def test_repeated_ids_are_the_querys_own_and_lie_in_several_shards(spark):
    rows = rows_with_groups(n=120) + [(50, [float(i % 7)] * 16, 0) for i in range(90)] + [(51, [9.0] * 16, 0)] * 40
    least = min(tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype("<i8").tobytes()) for i, v, _ in rows if i == 50)
    got = sorted(tuple(r) for r in kdtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, kdtree.Params(shard_rows=16, leaf=4)).collect())
    keep = [r for r in rows if r[0] != 50] + [r for r in rows if r[0] == 50 and tuple(np.floor(256 * np.array(r[1], np.float32).astype(float)).astype("<i8").tobytes()) == least][:1]
    assert [r for r in got if r[0] == 50] == [r for r in brute_top(keep) if r[0] == 50]


@pytest.mark.parametrize("p", [hnsw.Params(), hnsw.Params(shard_rows=50, beam=2, links=4, build_beam=6)])
def test_near_duplicates_equal_brute_force(spark, p):
    rows = rows_with_groups() + ODD
    got = near(spark, rows, p)
    assert got == brute_near(rows)
    assert hnsw.near_duplicates(frame(spark, []), p).count() == 0


def test_chains_of_links(spark):
    rows = [(i, [float(np.cos(0.3 * i)), float(np.sin(0.3 * i))], 1) for i in range(15)] + [(None, [1.0, 0.0], 1)]
    assert near(spark, rows) == brute_near(rows)


def test_repeated_ids_are_one_node(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (4, 1), 2: (3, 1), 3: (1, 1), 4: (6, 1)}


def test_audits_search_whole_shards_where_graphs_miss_links(spark, monkeypatch):
    monkeypatch.setattr(hnsw.Graph, "reachable", lambda self, q, width, least: [])
    rows = rows_with_groups(n=200)
    x = hnsw.unit_rows(np.array([r[1] for r in rows]))
    ids = np.arange(len(x))
    shard = hnsw.Shard(hnsw.Graph(x, hnsw.Params()), x, ids, ids, hnsw.Params())
    counts, _ = shard.links(x, ids, ids)
    assert shard.whole and shard.hits == shard.total > 0
    assert counts.tolist() == ((x @ x.T >= 0.93).sum(1) - 1).tolist()


def test_embeddings_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r)[:4] for r in op2_embedding_near_dedup(spark, d).collect()), key=repr) == brute_near(rows)
