"""The text classifier against plain formulas, saving and loading, and its checks."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from sievegrid.operators import model

WORDS = {"food": "soup bread cheese", "travel": "train hotel ticket", "tech": "laptop server kernel"}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    out = [(i, " ".join(r.choice(WORDS[c].split(), 6)) + f" {i}", c, [float(i % 3), 1.0]) for i, c in enumerate(list(WORDS) * 24)]
    return spark.createDataFrame(out, "id int, text string, label string, numbers array<double>")


def plain_grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (2, 3, 4) if n <= len(w) for i in range(len(w) - n + 1)]
    return sorted(out)


def test_char_grams(spark):
    frame = spark.createDataFrame([("The  cat\n A",), ("",)], "t string")
    got = [sorted(r[0]) for r in frame.select(model.char_grams("t")).collect()]
    assert got == [plain_grams("The  cat\n A"), []]


def test_fit_predict_save_load(spark, rows, tmp_path):
    m = model.fit(rows, "text", "label", "numbers")
    assert m.classes == ["food", "tech", "travel"]
    out = m.predict(rows, "text", "numbers").collect()
    truth = {r["id"]: r["label"] for r in rows.collect()}
    assert all(r["predicted"] == truth[r["id"]] and abs(sum(r["probabilities"]) - 1) < 1e-9 for r in out)
    m.save(tmp_path / "m")
    with pytest.raises(FileExistsError):
        m.save(tmp_path / "m")
    again = model.Classifier.load(spark, tmp_path / "m").predict(rows, "text", "numbers").collect()
    assert {r["id"]: r["probabilities"] for r in again} == {r["id"]: r["probabilities"] for r in out}
    assert m.predict(rows.limit(0), "text", "numbers").count() == 0


def test_tfidf_formula(spark, rows):
    m = model.fit(rows, "text", "label")
    texts = [r["text"] for r in rows.orderBy("id").collect()]
    grams = [plain_grams(t) for t in texts]
    vocabulary = m.vocabulary
    df = {g: sum(g in set(x) for x in grams) for g in vocabulary}
    assert all(2 <= n <= 0.995 * len(texts) for n in df.values())
    row = m._vectors(rows.where("id = 5"), "text", None).first()["_x"].toArray()
    want = np.array([(1 + np.log(grams[5].count(g))) * (np.log((1 + len(texts)) / (1 + df[g])) + 1) if g in grams[5] else 0.0 for g in vocabulary])
    assert np.allclose(row, want / np.linalg.norm(want))


def test_trees_and_checks(spark, rows):
    m = model.fit(rows, "text", "label", "numbers", model.Settings(backend="trees", trees=3, depth=3))
    out = m.predict(rows, "text", "numbers").collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in out)
    with pytest.raises(ValueError):
        model.fit(rows.where("label = 'food'"), "text", "label")
    with pytest.raises(ValueError):
        model.Settings(backend="forest")
    bad = spark.createDataFrame([(1, "x", "food", [1.0])], rows.schema)
    with pytest.raises(PySparkException):
        m.predict(bad, "text", "numbers").collect()


def test_registered_query_takes_the_operators_settings(spark, monkeypatch):
    from sievegrid.operators import model
    from sievegrid.plans import registry

    def seen(*_, settings=None, **__):
        raise StopIteration(settings or model.Settings())

    monkeypatch.setattr(model, "fit", seen)
    with pytest.raises(StopIteration) as stopped:
        registry.queries()["text_classifier"](spark, "/root/testdata/sf0.001")
    assert stopped.value.value == model.Settings() and stopped.value.value.vocabulary == 20_000
