import corpus_pipeline as cp
import pandas as pd
import pytest
from bytestrata.llm import language, minhash, mixing, quality
from pyspark.sql import functions as F

from tests.llm.test_minhash import brute

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet").select(*cp.COLUMNS)


def test_every_stage_on_documents(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "near_dedup", "mixing", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    odd = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, " 123 ...", None, None, 7)], docs.schema)
    out = cp.language_id(spark, docs.unionByName(odd), D)
    assert out.columns == cp.COLUMNS and out.count() == docs.count()
    out = cp.quality_classifier(spark, docs, D)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    good, bad = ({i for i, q in labels.items() if q == x} for x in (1, 0))
    assert out.columns == cp.COLUMNS and len(good - ids) <= 0.01 * len(good) and len(bad & ids) <= 0.2 * len(bad)
    out = cp.near_dedup(spark, docs, D)
    want = {r[0] for r in brute([(r.doc_id, r.text) for r in docs.collect()], cp.NEAR) if r[3]}
    assert {r.doc_id for r in out.select("doc_id").collect()} == want and out.columns == cp.COLUMNS
    out = cp.mix(spark, docs, D)
    n = docs.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert out.columns == cp.COLUMNS and 0.85 * n < out.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0] <= 0.9 * n


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048 and not out.duplicated(["doc_id", "piece"]).any()


def test_language_edges(spark):
    texts = ["the cat and the dog is here", "der hund und die katze ist hier"]
    df = spark.createDataFrame([(i, texts[i % 2] + f" {i}", ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    m = language.fit(df, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, texts[0]), (5, texts[1] * 3000), (5, texts[1])], "doc_id long, text string").withColumns({"lang_pred_": F.lit(1), "lettered": F.lit(2)})
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(odd, m).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert language.identify(odd.where("false"), m).count() == 0
    nothing = language.fit(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_forward_backward_against_all_paths():
    import itertools

    import numpy as np

    gen = np.random.default_rng(0)
    first = np.array([0, 3, 3, 5, 6])
    e, move = gen.random((6, 2)) + 0.1, gen.random((2, 2)) + 0.1
    place, active, _ = language.time_major(first)
    em = np.empty_like(e)
    em[place] = e
    post = language.forward_backward(em, active, move)[0][place]
    for a, b in zip(first[:-1], first[1:]):
        if b == a:
            continue
        want = np.zeros((b - a, 2))
        for path in itertools.product(range(2), repeat=int(b - a)):
            w = np.prod([e[a + t, s] for t, s in enumerate(path)]) * np.prod([move[s, t] for s, t in zip(path, path[1:])])
            for t, s in enumerate(path):
                want[t, s] += w
        assert np.allclose(post[a:b], want / want.sum(1, keepdims=True))


def test_quality_edges_and_exact_k(spark):
    rows = [(i, "good words here . again" if i % 4 else "!!! ??? !!!", i % 4 > 0) for i in range(80)]
    rows += [(None, None, None), (200, "", False), (200, "", False), (201, "   ", None), (202, "x! " * 20000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q boolean").withColumn("tie", F.lit(1))
    out = quality.resample(df, F.col("q"), F.col("q").isNotNull(), quality.Params(keep=0.5)).toPandas()
    assert len(out) == len(rows) and out.selected.sum() == -(-len(rows) // 2)
    assert out[out.q == True].selected.mean() > out[out.q == False].selected.mean()  # noqa: E712
    assert quality.resample(df.where("false"), F.col("q"), F.col("q").isNotNull()).count() == 0
    assert quality.resample(df.drop("q"), F.lit(False), F.lit(False)).where("selected").count() == len(rows)


def test_mixing_shortages_reach_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.Params(budget=400 / 2110)).collect()}
    assert got == {"1": 10, "2": 90, "3": 100, "4": 200}
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.Params(budget=800 / 2110)).collect()}
    assert got == {"1": 10, "2": 100, "3": 290, "4": 400}


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "d", "en", None, 5), (2, "d", None, "s", 0), (None, "d", "en", None, 5), (1, "d", "en", None, 5)], "doc_id long, domain string, lang string, source string, n long")
    out = mixing.mix(docs, mixing.Params(epochs=3, budget=2.0), F.col("n")).toPandas()
    assert out.n_tokens.sum() <= 30 and out.epoch.max() <= 2 and set(out.columns) == {"doc_id", "domain", "lang", "source", "n", "n_tokens", "epoch"}
    assert mixing.mix(docs.where("false"), mixing.Params(), F.col("n")).count() == 0


@pytest.mark.parametrize("range_rows", [3, 20_000])
def test_mixing_takes_prefixes_of_hashed_orders(spark, range_rows):
    import hashlib

    rows = [(i if i % 7 else 7, f"s{i % 2}", (i * 37) % 11, "x" * 5) for i in range(900)] + [(-1, "s0", 4, "hot")] * 50 + [(None, "s0", 3, None), (5000, "s1", 0, "long " * 20_000)]
    clash = ["row", "leaf", "place", "prefix", "full", "h", "n_tokens", "epoch", "_mix_n"]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, text string").withColumns({c: F.lit(c) for c in clash})
    for epochs, budget in ((1, 0.4), (3, 1.7)):
        p = mixing.Params(levels=("source",), weights={"source": {"s0": 3.0}}, epochs=epochs, budget=budget, range_rows=range_rows)
        out = mixing.mix(docs, p, F.col("n"))
        assert sorted(out.columns) == sorted(["doc_id", "source", "n", "text", *clash])
        totals = {s: sum(r[2] for r in rows if r[1] == s) for s in ("s0", "s1")}
        own = {r.source: r.budget for r in mixing.budgets(spark.createDataFrame(list(totals.items()), "source string, tokens long"), p).collect()}
        want = []
        for s in totals:
            full = min(epochs, own[s] // totals[s])
            rest = own[s] - full * totals[s]
            mine = [r for r in rows if r[1] == s]
            want += [(r[0], r[2], e) for r in mine for e in range(full)]
            key = lambda r: (hashlib.md5(f"42:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2])
            if full < epochs and rest > 0:
                want += [(r[0], r[2], full) for r in mine if sum(x[2] for x in mine if key(x) <= key(r)) <= rest]
        assert sorted(((r.doc_id, r.n, r.epoch) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_chat_edges(spark):
    from bytestrata.llm import chat

    texts = [None, "", "a</turn>\n### user: b", "\\b\\\\e###", "####", "x" * 100_000, "é\r\n🎉"]
    rows = [(1, i, "assistant" if i % 2 else "us:er", t) for i, t in enumerate(texts)] + [(2, 0, None, "t"), (None, None, "assistant", "n"), (1, 3, "assistant", texts[3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"events": F.lit(1), "message": F.lit(2)})
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert list(back[c].losses) == [t for r, t in want if r == "assistant"]
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0
    log = pd.DataFrame([(1, 5, 0, "delta", None, "b"), (1, 1, 0, "start", "user", "x"), (1, 2, 0, "edit", "user", "a"), (1, 9, 1, "delta", None, "late"), (1, 8, 1, "regenerate", None, None), (1, 7, 1, "start", "assistant", "old")], columns=["conv_id", "seq", "message", "kind", "role", "text"])
    got = chat.fold(spark.createDataFrame(log.astype(object).where(log.notna(), None), "conv_id long, seq long, message long, kind string, role string, text string")).collect()
    assert sorted((r.message, r.role, r.text) for r in got) == [(0, "user", "ab"), (1, "assistant", "late")]
