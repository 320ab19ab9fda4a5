"""Toxicity by maximum-scoring segments of token log-odds.

Learning: over a bounded sample of labelled documents (SAMPLE rows by a seeded hash of the
id), the tokens of each word, word beginning and word end in toxic and in other documents
give a log-odds ratio under an informative Dirichlet prior (the sample's own rates). Repeats
within a document count by their logarithm, and the standard error comes from the numbers of
documents, as tokens of one document go together; it means something from LEAST_DOCS toxic
documents on. A term scores its lower bound (ERRORS standard errors down) where that alone
outweighs the prior odds; every other token scores a fixed loss.

Scoring: one linear scan finds all maximal-scoring segments of a document. A segment of
score S among n tokens is expected K n exp(-lambda S) times by chance, with lambda from the
score distribution of the sample's other documents and K from their best segments; what its
exponent exceeds the document's chance level by is its significance. The best and the sum of
the significances give a probability by a logistic fit on the sample. For lambda, K and the fit
each document of the sample is scored by terms from which its own share of the counts is taken
out (a jackknife), or words that only a few toxic documents happen to hold would look certain.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sievegrid.llm.common import bounded_ids, held_out, materialize, table

MODULUS, REMAINDER = 4, 2
#: Bound of the fitted model: labelled rows sampled.
SAMPLE = 12_000
LEAST_DOCS = 3
PRIOR, PRIOR_SHARE = 2000.0, 0.01
ERRORS = 1.5
LOSS = 0.35
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_PARTS = (4, 5, 6, 7)
_CACHE = 400_000
#: Counts are integers, in such parts of a token, so that sums don't depend on their order.
UNIT = 1024
COUNTS = ("toxic", "other", "toxic_docs", "other_docs")


def terms(word: str) -> list[str]:
    """A word itself, its beginnings and its ends."""
    n = len(word)
    return [word, *("^" + word[:k] for k in _PARTS if k < n), *(word[-k:] + "$" for k in _PARTS if k < n)]


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float, prior: float = PRIOR) -> np.ndarray:
    """Log-odds ratios of token counts; the prior spreads `prior` tokens a side at the pooled rates.

    The sample decides how many: PRIOR, or PRIOR_SHARE of its tokens if that is less.
    """
    pooled = (toxic + other) / max(n_toxic + n_other, 1)
    a, b = toxic + prior * pooled, other + prior * pooled
    return np.log(a / (n_toxic + prior - a)) - np.log(b / (n_other + prior - b))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), left to right, in linear time."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum through
    for at in np.flatnonzero(scores > 0):
        first, end, low, high = int(at), int(at) + 1, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((first, end, low, high))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, high - low) for f, e, low, high in stack]


def _lambda(value: np.ndarray, count: np.ndarray) -> float:
    """The positive root of mean(exp(lambda s)) = 1 over the scores `value`, each `count` times; 1 where they have none."""
    if not len(value) or value.max() <= 0 or (value * count).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    weight = count / count.sum()
    while (weight * np.exp(high * value)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.exp(mid * value)).sum() < 1 else (low, mid)
    return (low + high) / 2


class _Scores(dict):
    """Score of each word met so far."""

    def __init__(self, weights: dict):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        s = self[word] = max(self.weights.get(t, -LOSS) for t in terms(word.lower()))
        return s


class Scorer:
    """Token scores and document statistics under a fitted model; keeps a bounded cache of words."""

    def __init__(self, model: dict):
        self.model, self.cache = model, _Scores(model["terms"])

    def tokens(self, text: str | None) -> np.ndarray:
        """Each word's score."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        found = _WORD.findall(text or "")
        return np.fromiter(map(self.cache.__getitem__, found), float, len(found))

    def statistic(self, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Best and summed significance, and the significant segments."""
        if not len(scores) or scores.max() <= 0:
            return 0.0, 0.0, []
        chance = self.model["log_k"] + np.log(len(scores))
        found = [(f, e, self.model["lambda"] * s - chance) for f, e, s in segments(scores)]
        found = [x for x in found if x[2] > 0]
        return max((x[2] for x in found), default=0.0), sum(x[2] for x in found), found

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(best)), np.log1p(best), np.log1p(total)]) @ self.model["logit"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each term: damped tokens (in UNIT parts) and documents, in toxic documents and in others; the term '' has all tokens."""
    sums = [Counter(), Counter(), Counter(), Counter()]
    for f in frames:
        for text, label in zip(f["text"], f["label"], strict=True):
            tokens, documents = (sums[0], sums[2]) if label else (sums[1], sums[3])
            seen = set()
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                n = round(UNIT * (1 + math.log(n)))
                tokens[""] += n
                for t in terms(word):
                    tokens[t] += n
                    seen.add(t)
            documents.update(seen)
    names = list(sums[0].keys() | sums[1].keys())  # rare terms too: only the sums over all tasks can tell
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pd.DataFrame({"term": part} | {c: [s[t] for t in part] for c, s in zip(COUNTS, sums, strict=True)})


_MOMENTS = "label int, n long, top double, value double, count long"


def _moments(model: dict):
    """A row (label, n, top) for each document, and rows (value, count) of the gains in those that are not toxic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = Scorer(model | {"terms": model["without_other"]}), Scorer(model | {"terms": model["without_toxic"]})
        for f in frames:
            rows, gains = [], [np.zeros(0)]
            for text, label in zip(f["text"], f["label"], strict=True):
                s = scorers[int(label)].tokens(text)
                rows.append((int(label), len(s), max((x[2] for x in segments(s)), default=0.0)))
                gains.append(s[s > 0] if not label else s[:0])
            yield pd.DataFrame(rows, columns=["label", "n", "top"]).assign(value=None, count=None).astype({"value": float, "count": "Int64"})
            value, count = np.unique(np.concatenate(gains), return_counts=True)
            yield pd.DataFrame({"label": None, "n": None, "top": None, "value": value, "count": count}).astype({"label": "Int32", "n": "Int64", "top": float})

    return run


def _statistics(model: dict):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = Scorer(model | {"terms": model["without_other"]}), Scorer(model | {"terms": model["without_toxic"]})
        for f in frames:
            rows = [(int(label), *scorers[int(label)].statistic(scorers[int(label)].tokens(text))[:2]) for text, label in zip(f["text"], f["label"], strict=True)]
            yield pd.DataFrame(rows, columns=["label", "best", "total"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` rows of labels (doc_id, label) whose document is in docs.

    Rows without a label, id or document are left out; of repeated ids the greatest label and
    the least text count. Without a toxic row no term scores. The same rows give the same model,
    however they are dealt to tasks.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = known.join(bounded_ids(known, "doc_id", sample).select("doc_id"), "doc_id", "left_semi")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = materialize(rows.select("text", "label"))
    n = {int(r["label"]): r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = materialize(
        rows.mapInPandas(_counted, "term string, " + ", ".join(f"{c} long" for c in COUNTS))
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
    )
    tokens = lambda c: F.col(c) / float(UNIT)
    whole = counts.where("term = ''").select(tokens("toxic"), tokens("other")).first()
    n_toxic, n_other = (float(whole[0]), float(whole[1])) if whole else (0.0, 0.0)
    prior = min(PRIOR, PRIOR_SHARE * (n_toxic + n_other))

    def bound(toxic, other, toxic_docs, other_docs):
        """log_odds() less its errors, in the engine, so that only terms that score leave it."""
        pooled = (toxic + other) / max(n_toxic + n_other, 1.0)
        a, b = toxic + prior * pooled, other + prior * pooled
        delta = F.log(a / (n_toxic + prior - a)) - F.log(b / (n_other + prior - b))
        return F.when(toxic_docs >= LEAST_DOCS, delta - ERRORS * F.sqrt(1 / (toxic_docs + 0.5) + 1 / (other_docs + 0.5)))

    toxic, other, toxic_docs, other_docs = tokens("toxic"), tokens("other"), F.col("toxic_docs"), F.col("other_docs")
    less = lambda n, docs: F.when(docs > 0, n * (docs - 1) / docs).otherwise(0.0)
    needed = float(np.log(max(n.get(0, 0), 1) / max(n.get(1, 0), 1)))
    best = (
        counts.where(f"term != '' and toxic_docs >= {LEAST_DOCS}")
        .select(
            "term",
            bound(toxic, other, toxic_docs, other_docs).alias("terms"),
            bound(toxic, less(other, other_docs), toxic_docs, F.greatest(other_docs - 1, F.lit(0))).alias("without_other"),
            bound(less(toxic, toxic_docs), other, toxic_docs - 1, other_docs).alias("without_toxic"),
        )
        .where(F.greatest("terms", "without_other") > needed)
        .toPandas()
    )
    weights = {c: {t: float(x) for t, x in zip(best["term"], best[c], strict=True) if x > needed} for c in ("terms", "without_other", "without_toxic")}
    model = weights | {"lambda": 1.0, "log_k": 0.0, "logit": np.array([-30.0, 0.0, 0.0])}
    moments = materialize(rows.mapInPandas(_moments(model), _MOMENTS))
    frame = moments.where("label is not null").select("label", "n", "top").toPandas().sort_values(["label", "n", "top"])
    final = {k: v for k, v in model.items() if k not in ("without_other", "without_toxic")}
    if not len(frame):
        return final
    clean = frame[frame["label"] == 0]
    gains = moments.where("value is not null").groupBy("value").agg(F.sum("count").alias("count")).toPandas().sort_values("value")
    losses = int(clean["n"].sum()) - int(gains["count"].sum())
    model["lambda"] = lam = _lambda(np.append(gains["value"], -LOSS), np.append(gains["count"].astype(float), losses)) if losses else 1.0
    top = clean["top"].to_numpy(float)
    hit = top > 0
    size = np.log(np.maximum(clean["n"].to_numpy(float), 1))
    # the mean of an extreme-value variable is (log(K n) + 0.5772) / lambda; K is at least what one hit a sample gives
    model["log_k"] = float(np.mean(lam * top[hit] - size[hit] - 0.5772)) if hit.sum() >= 30 else -float(np.log(clean["n"].sum() + 1))
    found = rows.mapInPandas(_statistics(dict(model)), "label int, best double, total double").toPandas().sort_values(["label", "best", "total"])
    x = np.column_stack([np.ones(len(found)), np.log1p(found["best"]), np.log1p(found["total"])])
    return final | {"lambda": model["lambda"], "log_k": model["log_k"], "logit": _logistic(x, found["label"].to_numpy(float))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, passages) for each row's whole text.

    passages are the significant segments, each with the code points at which it starts and
    ends and its significance. Null and empty texts and texts without a scoring term have no
    passage and get the lowest probability. Very long texts are scanned whole, in linear time.
    Repeated rows each give a row; other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("significance", DoubleType())])
    kind = StructType([StructField("score", DoubleType()), StructField("passages", ArrayType(passage))])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            best, total, passages = np.zeros(len(texts)), np.zeros(len(texts)), []
            for i, text in enumerate(texts):
                best[i], total[i], found = scorer.statistic(scorer.tokens(text))
                ends = [m.end() for m in _WORD.finditer(text)] if found else []
                passages.append(
                    [{"start": int(ends[f - 1]) if f else 0, "end": int(ends[e - 1]), "significance": float(v)} for f, e, v in found]
                )
            yield pd.DataFrame({"score": scorer.probability(best, total), "passages": passages})

    return docs.select("doc_id", scored("text").alias("x")).select("doc_id", "x.score", "x.passages")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", MODULUS, REMAINDER))
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out("doc_id", MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; learned from all labelled rows."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            both = [scorer.statistic(scorer.tokens(t))[:2] for t in texts]
            yield pd.Series(scorer.probability(np.array([x[0] for x in both]), np.array([x[1] for x in both])))

    return docs.where(scored("text") < THRESHOLD)
