"""Text classification: character n-grams within words, TF-IDF, numeric features, and a linear or boosted model.

The vocabulary and its document frequencies are aggregations over column expressions, and
models are MLlib's. Sparse vectors with sublinear counts, which no built-in stage makes, come
from one Python function over the text.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions.text import _c, collapse_space
from sievegrid.session import written

FORMAT = "sievegrid-text-classifier-1"


def char_grams(text, low: int = 2, high: int = 4) -> Column:
    """The n-grams of each word with a space at either end; none is longer than its word."""
    words = F.filter(F.split(collapse_space(F.lower(_c(text))), " "), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(padded)))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))
        return F.flatten(F.transform(sizes, cut))

    return F.flatten(F.transform(words, grams))


@dataclass(frozen=True)
class Settings:
    low: int = 2
    high: int = 4
    min_documents: int = 2
    max_share: float = 0.995
    vocabulary: int = 20_000
    backend: str = "logistic"
    c: float = 2.0
    iterations: int = 1000
    trees: int = 20
    depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    seed: int = 42

    def __post_init__(self):
        if self.backend not in ("logistic", "trees"):
            raise ValueError(f"unknown backend: {self.backend}")


@dataclass
class Classifier:
    """A fitted model; predicting never refits."""

    settings: Settings
    classes: list
    width: int
    vocabulary: list[str]
    idf: list[float]
    models: list = field(default_factory=list)

    def _vectors(self, rows: DataFrame, text: str, numbers: str | None) -> DataFrame:
        return _assembled(rows, text, numbers, self.vocabulary, np.array(self.idf), self.settings, self.width)

    def predict(self, rows: DataFrame, text: str, numbers: str | None = None) -> DataFrame:
        """rows with `probabilities` (by class, in the order of classes) and `predicted`; an empty frame is fine."""
        x = self._vectors(rows, text, numbers)
        if self.settings.backend == "logistic":
            p = vector_to_array("_p")
            x = self.models[0].transform(x)
        else:
            for k, m in enumerate(self.models):
                x = m.transform(x).withColumn(f"_p{k}", vector_to_array("_p")[1]).drop("_p", "_r", "_y")
            one = [F.col(f"_p{k}") for k in range(len(self.models))]
            total = sum(one[1:], one[0])
            p = F.array(1 - one[0], one[0]) if len(one) == 1 else F.array(*[F.when(total > 0, v / total).otherwise(1.0 / len(one)) for v in one])
        names = F.array(*[F.lit(c) for c in self.classes])
        x = x.withColumn("probabilities", p)
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return x.withColumn("predicted", F.element_at(names, best)).select(*[c for c in rows.columns if c not in ("probabilities", "predicted")], "probabilities", "predicted")

    def save(self, path: str | Path) -> None:
        """A new directory with the fitted stages and a description; an existing one is an error."""
        path = Path(path)
        path.mkdir(parents=True)
        for k, m in enumerate(self.models):
            m.save(str(path / f"model{k}"))
        text = json.dumps({"format": FORMAT, "settings": asdict(self.settings), "classes": self.classes, "width": self.width, "vocabulary": self.vocabulary, "idf": self.idf, "models": len(self.models)}, ensure_ascii=False)
        (path / "classifier.json").write_text(text, encoding="utf-8")

    @staticmethod
    def load(spark: SparkSession, path: str | Path) -> Classifier:
        path = Path(path)
        x = json.loads((path / "classifier.json").read_text(encoding="utf-8"))
        if x.get("format") != FORMAT or len(x["idf"]) != len(x["vocabulary"]):
            raise ValueError("not a classifier of this format, or its parts do not fit")
        models = [PipelineModel.load(str(path / f"model{k}")) for k in range(x["models"])]
        return Classifier(Settings(**x["settings"]), x["classes"], x["width"], x["vocabulary"], x["idf"], models)


def grams_of(text: str, low: int, high: int) -> Counter:
    """What char_grams() makes, counted."""
    padded = (f" {w} " for w in text.lower().split())
    return Counter(w[i : i + n] for w in padded for n in range(low, min(high, len(w)) + 1) for i in range(len(w) - n + 1))


def _assembled(rows: DataFrame, text: str, numbers: str | None, vocabulary: list[str], idf: np.ndarray, s: Settings, width: int) -> DataFrame:
    """rows with the vector _x: the text's scaled counts, of length 1, then the numbers."""
    place = {g: k for k, g in enumerate(vocabulary)}

    def vector(text, more):
        if len(more) != width or not all(x is not None and np.isfinite(x) for x in more):
            raise ValueError(f"numeric features must be {width} finite numbers")
        found = sorted((place[g], n) for g, n in grams_of(text or "", s.low, s.high).items() if g in place)
        at = np.array([k for k, _ in found], np.int64)
        w = (1 + np.log([n for _, n in found])) * idf[at] if found else np.zeros(0)
        w = w / np.linalg.norm(w) if found else w
        some = [k for k, x in enumerate(more) if x]
        return SparseVector(len(place) + width, [*at.tolist(), *(len(place) + k for k in some)], [*w.tolist(), *(more[k] for k in some)])

    more = F.coalesce(F.col(numbers).cast("array<double>"), F.array()) if numbers else F.array().cast("array<double>")
    return rows.withColumn("_x", F.udf(vector, VectorUDT())(_c(text), more))


def fit(rows: DataFrame, text: str, label: str, numbers: str | None = None, settings: Settings | None = None) -> Classifier:
    """A classifier of `label` (strings or integers, two values or more) from text and numbers."""
    s = settings or Settings()
    kind = dict(rows.dtypes)[label]
    if kind not in ("string", "int", "bigint", "smallint", "tinyint"):
        raise ValueError("labels must be strings or integers")
    labels = sorted(r[0] for r in rows.select(label).distinct().collect() if r[0] is not None)
    if len(labels) < 2 or any(isinstance(v, str) and not v.strip() for v in labels):
        raise ValueError("labels must be non-blank and of two values or more")
    sizes = rows.agg(F.count(F.lit(1)), F.count(label), F.count(text), F.min(F.size(numbers)) if numbers else F.lit(0), F.max(F.size(numbers)) if numbers else F.lit(0)).first()
    if sizes[0] != sizes[1] or sizes[0] != sizes[2]:
        raise ValueError("every row needs a text and a label")
    if sizes[3] != sizes[4]:
        raise ValueError("numeric features differ in width")
    width = sizes[3] if numbers else 0
    n = sizes[0]
    grams = rows.select(char_grams(text, s.low, s.high).alias("g"))
    once = grams.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    terms = grams.select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(once, "g")
    kept = terms.where((F.col("df") >= s.min_documents) & (F.col("df") <= s.max_share * n)).orderBy(F.desc("n"), "g").limit(s.vocabulary).collect()
    if not kept:
        raise ValueError("no term is frequent enough")
    out = Classifier(s, labels, width, [r["g"] for r in kept], [float(np.log((1 + n) / (1 + r["df"])) + 1) for r in kept])
    index = F.element_at(F.create_map(*[v for k, c in enumerate(labels) for v in (F.lit(c), F.lit(float(k)))]), F.col(label))
    x = out._vectors(rows, text, numbers).withColumn("_label", index).select("_x", "_label")
    x = written(x)
    if s.backend == "logistic":
        model = LogisticRegression(featuresCol="_x", labelCol="_label", predictionCol="_y", probabilityCol="_p", rawPredictionCol="_r", regParam=1 / (s.c * n), elasticNetParam=0.0, standardization=False, maxIter=s.iterations)
        out.models = [PipelineModel([model.fit(x)])]
    else:
        for k in range(len(labels) if len(labels) > 2 else 1):
            one = x.withColumn("_label", (F.col("_label") == float(k if len(labels) > 2 else 1)).cast("double"))
            trees = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=s.trees, maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.subsample, seed=s.seed)
            trees = trees.setPredictionCol("_y").setProbabilityCol("_p").setRawPredictionCol("_r")
            out.models.append(PipelineModel([trees.fit(one)]))
    return out
