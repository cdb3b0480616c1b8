import numpy as np
import pyarrow as pa
from bytestrata.llm import language
from pyspark.sql import functions as F


def test_posteriors_equal_forward_backward():
    gen = np.random.default_rng(5)
    for lengths in ([1], [7, 3, 3, 1], [0, 4, 0, 2]):
        _, active, _ = language.time_major(np.concatenate(([0], np.cumsum(lengths))))
        e, move = gen.random((sum(lengths), 3)) + 0.01, gen.random((3, 3)) + 0.01
        np.testing.assert_allclose(language.posteriors(e, active, move), language.forward_backward(e, active, move)[0], rtol=1e-12)


def test_means_of_texts_do_not_depend_on_their_neighbours():
    texts = ["the cat and the dog", "der Hund und die Katze", "", None, "the Hund and die cat"]
    model = language.train(texts[:2] * 5, ["en", "de"] * 5)
    n, means = language.text_means(model, pa.array(texts, pa.string()))
    assert n.tolist() == [5, 5, 0, 0, 5] and len(means) == 3
    alone = [language.text_means(model, pa.array([t], pa.string()))[1][0] for t in texts if t]
    np.testing.assert_allclose(means, alone, rtol=1e-6)
    assert [model.languages[i] for i in means[:2].argmax(1)] == ["en", "de"]
    assert len(language.text_means(model, pa.array([], pa.string()))[1]) == 0


def test_fit_learns_every_language_of_skewed_tables(spark, monkeypatch):
    rows = [(f"der Hund {i}", "de") for i in range(400)] + [("die Katze", "de")] * 20_000
    rows += [(f"the dog {i}", "en") for i in range(400)] + [(f"le chien {i}", "fr") for i in range(3)]
    rows += [("gatto " * 2000 + str(i), "it") for i in range(2)] + [(f"hond {i} " + "x" * 8000, "nl") for i in range(200)] + [("een hond", "nl")] * 50
    rows += [("", "es"), (None, "pt"), ("sem", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    held = []
    monkeypatch.setattr(language, "train", lambda texts, labels, p: held.append(list(zip(texts, labels))))
    language.fit(docs, F.lit(True))
    language.fit(docs.repartition(3), F.lit(True))
    assert held[0] == held[1] and len(set(held[0])) == len(held[0])
    by = {x: [t for t, own in held[0] if own == x] for _, x in held[0]}
    assert {x: len(t) for x, t in by.items()} == {"de": 120, "en": 120, "fr": 3, "it": 1, "nl": 120}
    assert "een hond" in by["nl"] and by["it"] == [("gatto " * 2000)[:8000]]
