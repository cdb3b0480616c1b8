import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from bytestrata.llm import packing
from bytestrata.llm.bpe import Encoder
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TOKENIZER, ENCODER = reference(), Encoder(PATH)
ODD = ["it's he'll we've 'sup x'd''s '", "a  b\n c\n\n  d \t", " lead", "trail  ", "12ab½²³٣x", "é日本 x\xa0y", "<|endoftext|>", "", "\n's", "'", "I'M I'm\r\n", "👩‍👩‍👧x"]


def same(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0], repr(t)


def test_ids_are_those_of_the_public_tokenizer(spark):
    same(ODD + [None])
    same([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\tsrevld1²é日!\xa0", max_size=20) | st.text(max_size=12), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    same(texts)


def test_pieces_of_a_document():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_local_search_saves_bins():
    gen, saved = np.random.default_rng(3), 0
    for case in range(30):
        lengths = gen.integers(20, 60, 120) if case % 3 else gen.integers(1, 100, 300)
        plain = packing.Bins(100)
        plain.best_fit(lengths)
        number, place = packing.pack(lengths, packing.Params(capacity=100))
        fill = np.bincount(number, lengths)
        assert fill.max() <= 100 and packing.least_bins(lengths, 100) <= len(fill) <= len(plain.items)
        saved += len(plain.items) - len(fill)
        for b in set(number):
            own = sorted((place[i], lengths[i]) for i in np.flatnonzero(number == b))
            assert [s for s, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])))[:-1].tolist()
    assert saved >= 10


def test_changes_are_the_best_of_all():
    import itertools

    gen = np.random.default_rng(5)
    for _ in range(200):
        x, y = (gen.integers(1, 30, gen.integers(1, 7)) for _ in range(2))
        room = int(gen.integers(0, 20))
        sides = lambda z, least: [c for k in range(least, 3) for c in itertools.combinations(z.tolist(), k)]
        want = max((sum(o) - sum(b) for o in sides(x, 1) for b in sides(y, 0) if len(o) + len(b) <= 3 and 0 < sum(o) - sum(b) <= room), default=0)
        found = packing.best_change(packing.Choices(x.tolist()), packing.Choices(y.tolist()), room)
        assert (sum(found[0]) - sum(found[1]) if found else 0) == want


def test_lower_bound():
    assert packing.least_bins(np.array([6, 6, 6]), 10) == 3
    assert packing.least_bins(np.array([5, 5, 5]), 10) == 2
    assert packing.least_bins(np.array([1] * 21), 10) == 3
    assert packing.least_bins(np.array([], np.int64), 10) == 0


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_ids_of_words_with_equal_hashes(monkeypatch):
    from bytestrata.llm import bpe

    same([*thue_morse(11), " ".join(thue_morse(11))])
    hashes = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *a: hashes(*a) % np.uint64(5))
    texts = [*ODD, "all of these words share five hashes", None]
    ids, bounds = Encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 9000), (None, "null id"), (-4, "same"), (-4, "same")], "doc_id long, text string")
    rows = packing.pack_documents(docs.unionByName(extra)).collect()
    texts = {r.doc_id: r.text for r in docs.unionByName(extra).collect()}
    by = {}
    for r in rows:
        ids = np.array(TOKENIZER.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 2048 or r.piece == 0
    assert {r.doc_id for r in rows} == set(texts)
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= 1.02 * total / 2048 + 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0


def test_added_tokens_are_one_id_as_by_the_tokenizers_defaults(spark):
    from tokenizers import Tokenizer

    default, word = Tokenizer.from_file(PATH), "<|endoftext|>"
    texts = [*ODD, None, word * 2, f"a {word} b", f" {word}\n{word}'s", f"x{word[:-1]}", f"<|end{word}", f"é {word}日  {word}  ", word[:6], word[6:], f"it{word}'s  {word} {word}"]
    want = [[*default.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    ids, bounds = Encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}
