"""Quality classifier: similarity-weighted nearest-neighbour voting over latent-semantic vectors.

Every text becomes a vector of hashed character trigrams (of the text and of its shape, where
letters, capitals and digits fall together) and of a few repetition and make-up ratios. The
trigrams are weighted by inverse document frequency, the ratios centred and scaled, and all
are folded into one latent space by a truncated singular value decomposition. The latent vectors of a bounded labelled sample
(SAMPLE rows) are broadcast; every document takes its exact cosine with all of them in
blocks, and its K nearest vote with weights that grow with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sievegrid.llm.common import bounded_ids, held_out, table

MODULUS, REMAINDER = 5, 0
#: Bound of the fitted model: labelled rows sampled by a seeded hash of the id.
SAMPLE = 5000
BUCKETS = 512
LATENT = 48
K = 15
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLOCK = 256
RATIOS = 9
#: Weight of a ratio's standard deviation beside the trigrams' unit norm.
RATIO_WEIGHT = 0.2


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    code = x[:-2].astype(np.uint32) | x[1:-1].astype(np.uint32) << np.uint32(8) | x[2:].astype(np.uint32) << np.uint32(16)
    code = (code + np.uint32(salt)) * np.uint32(0x9E3779B1)
    return np.bincount(code >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)


def features(text: str | None) -> np.ndarray:
    """Counts of the hashed text and shape trigrams, then RATIOS ratios in [0, 1]; zeros without text."""
    out = np.zeros(2 * BUCKETS + RATIOS, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return out
    data = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
    shape = _SHAPE[data]
    out[:BUCKETS] = _hashed(_LOWER[data], 1)
    out[BUCKETS : 2 * BUCKETS] = _hashed(shape, 77)
    words = raw.split()
    n, crc = len(words), zlib.crc32
    marks = np.array([crc(w) for w in words], np.uint32)
    pairs = marks[:-1] * np.uint32(31) + marks[1:]
    lines = [x for x in raw.splitlines() if x.strip()]
    kinds = np.bincount(shape, minlength=256)
    total = len(raw)
    out[2 * BUCKETS :] = (
        (marks[1:] == marks[:-1]).mean() if n > 1 else 0,
        1 - len(np.unique(marks)) / n,
        1 - len(np.unique(pairs)) / max(len(pairs), 1) if n > 1 else 0,
        kinds[ord("A")] / total,
        kinds[ord("0")] / total,
        1 - (kinds[ord("a")] + kinds[ord("A")] + kinds[ord("0")] + kinds[32] + kinds[10] - 2) / total,
        1 - len(set(lines)) / max(len(lines), 1),
        min(n / 100, 1.0),
        min(total / n / 20, 1.0),
    )
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.sqrt(x[:, : 2 * BUCKETS]) * idf
    return tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)


def _centred(x: np.ndarray, model: dict) -> np.ndarray:
    """What is decomposed: weighted trigrams and scaled ratios, both about the sample's means."""
    ratios = (x[:, 2 * BUCKETS :] - model["ratio_mean"]) / model["ratio_scale"]
    return np.hstack([_weighted(x, model["idf"]) - model["mean"], np.clip(ratios, -4, 4) * RATIO_WEIGHT])


def _embed(x: np.ndarray, model: dict) -> np.ndarray:
    """Unit latent vectors; zero for texts without features."""
    v = _centred(x, model) @ model["axes"]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v[~x.any(1)] = 0
    return v.astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Latent space and labelled vectors of the sample's features x and 0/1 labels y."""
    if not len(y):
        return {"labels": y, "rate": 0.5}
    idf = np.log((1 + len(x)) / (1 + (x[:, : 2 * BUCKETS] > 0).sum(0))) + 1
    ratios = x[:, 2 * BUCKETS :]
    model = {
        "idf": idf.astype(np.float32), "mean": _weighted(x, idf).mean(0).astype(np.float32),
        "ratio_mean": ratios.mean(0), "ratio_scale": ratios.std(0) + 1e-3,
        "labels": y.astype(np.float32), "rate": float(y.mean()),
    }
    whole = _centred(x, model)
    _, axes = np.linalg.eigh((whole.T @ whole).astype(np.float64))
    model["axes"] = axes[:, ::-1][:, :LATENT].astype(np.float32)
    return model | {"vectors": np.ascontiguousarray(_embed(x, model).T)}


def vote(x: np.ndarray, model: dict, k: int = K) -> np.ndarray:
    """Share of label 1 among the k nearest labelled vectors, weighted by similarity.

    Of vectors that tie for the k-th place the selection takes some; the labelled vectors lie in
    the order of their ids, so that it always takes the same ones.
    """
    labels, rate = model["labels"], model["rate"]
    if not len(labels):
        return np.full(len(x), rate)
    score = np.empty(len(x))
    k = min(k, len(labels))
    for at in range(0, len(x), _BLOCK):
        v = _embed(x[at : at + _BLOCK], model)
        cosines = v @ model["vectors"]
        near = np.argpartition(cosines, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 8 + 1e-9
        found = (weight * labels[near]).sum(1) / weight.sum(1)
        score[at : at + _BLOCK] = np.where(v.any(1), found, rate)
    return np.clip(score, 0, 1)


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "x": [features(t).tobytes() for t in f["text"]]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` rows of labels (doc_id, label) whose document is in docs.

    Rows without a label, id or document are left out; of repeated ids the greatest label and
    the text with the least features count.
    The sample's vectors, fixed in number and width, are all that reaches the driver.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = known.join(bounded_ids(known, "doc_id", sample).select("doc_id"), "doc_id", "left_semi")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInPandas(_sampled, "doc_id long, label int, x binary")
    frame = rows.toPandas().sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(frame["x"]), np.float32).reshape(len(frame), -1) if len(frame) else np.zeros((0, 1), np.float32)
    return fit(x, frame["label"].to_numpy(np.float32))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row's whole text.

    Null, empty and blank texts have no vector and get the sample's rate of label 1 (0.5 if
    nothing was learned). Very long texts are read whole. Repeated rows each give a row; other
    columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(texts), _BLOCK):
            out.append(vote(np.stack([features(t) for t in texts.iloc[at : at + _BLOCK]]), shared.value))
        return pd.Series(np.concatenate(out))

    return docs.select("doc_id", scored("text").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", MODULUS, REMAINDER))
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out("doc_id", MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
