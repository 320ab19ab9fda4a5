"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, for each slot, one bit per language. The AND of an n-gram's
slots is the set of all languages whose filter holds the n-gram. A document's evidence for a
language is the number of its n-grams with the language's bit (a popcount down the slices),
less what the filter's false positives alone would give, as the share of what is left.

Learning: character n-grams of words of about `per_lang` documents of each language (a bounded
sample by a seeded hash of id and text, see SAMPLE_PER_LANG). A language's filter takes the
n-grams that are at least `share` times as frequent in it as in the language where they are
most frequent, so that stray foreign passages do not set bits, and that are at least RATE of the
language's n-grams: there can be no more than 1 / RATE of them. Slots are set by one OR for all
languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sievegrid.llm.common import held_out, materialize, table

MODULUS, REMAINDER = 4, 2
ORDERS = (2, 3, 4)
#: Bounds of the fitted model: documents sampled for a language, share of a language's n-grams that one must have.
SAMPLE_PER_LANG = 1000
RATE = 1 / 40_000
SHARE = 0.25
SLOTS_LOG2 = 18
HASHES = 2
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = 1 << 19


def _chunks(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, start of each text): texts as ' word word ', joined in bounded chunks."""
    first, parts, sizes, total = 0, [], [], 0
    for i, t in enumerate(texts):
        s = f" {' '.join(_WORD.findall(t.lower()))} " if t else "  "
        parts.append(s)
        sizes.append(len(s))
        total += len(s)
        if total >= _CHUNK or i == len(texts) - 1:
            points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            yield first, i + 1, points, np.concatenate(([0], np.cumsum(sizes)[:-1]))
            first, parts, sizes, total = i + 1, [], [], 0


def _grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hash of the n-gram at every position, and whether it lies within one text."""
    space = points == 32
    border = space[:-1] & space[1:]
    code, inside = points, np.ones(len(points), bool)
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            return
        code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        inside = inside[: len(points) - n + 1] & ~border[n - 2 :]
        if n in ORDERS:
            mixed = (code + np.uint64(n)) * np.uint64(_SALTS[0])
            yield mixed ^ (mixed >> np.uint64(29)), inside


def _slots(code: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS_LOG2)
    return [((code * np.uint64(_SALTS[j])) >> shift).astype(np.int64) for j in range(HASHES)]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, rows in frame.groupby("lang"):
            seen = []
            for _, _, points, _ in _chunks(rows["text"].tolist()):
                seen += [np.unique(code[inside], return_counts=True) for code, inside in _grams(points)]
            if seen:
                part = pd.DataFrame({"gram": np.concatenate([g for g, _ in seen]).view(np.int64), "n": np.concatenate([n for _, n in seen])})
                part = part.groupby("gram", as_index=False)["n"].sum()
                yield part.assign(lang=lang)[["lang", "gram", "n"]]


def learned_grams(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, share: float = SHARE) -> DataFrame:
    """(lang, gram): the n-grams of each language's filter, from a sample of docs (doc_id, text, lang)."""
    sizes = docs.groupBy("lang").agg((per_lang / F.count(F.lit(1))).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.withColumn("draw", draw).join(F.broadcast(sizes), "lang").where("draw < rate").select("lang", "text")
    counts = materialize(sample.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rel = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p")).where(F.col("p") >= RATE)
    best = rel.groupBy("gram").agg(F.max("p").alias("most"))
    return rel.join(best, "gram").where(F.col("p") >= share * F.col("most")).select("lang", "gram")


def _bits(langs: list[str]):
    number = {lang: k for k, lang in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = f["lang"].map(number).to_numpy(np.int64)
            bit = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for at in _slots(f["gram"].to_numpy(np.int64).view(np.uint64)):
                yield pd.DataFrame({"slot": at, "word": k // 64, "bits": bit})

    return run


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, share: float = SHARE) -> dict:
    """Fit filters on docs (doc_id, text, lang) with a language; the caller leaves held-out rows away.

    Every language is learned. The model has 2^SLOTS_LOG2 slots of one bit per language. Of
    languages with equally many documents the first by name is the most frequent.
    """
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = sorted((r["lang"], r["n"]) for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    langs = [x for x, _ in sizes]
    model = {"langs": langs, "prior": langs[int(np.argmax([n for _, n in sizes]))] if langs else UNDETERMINED}
    if not langs:
        return model
    slots = np.zeros((1 << SLOTS_LOG2, (len(langs) + 63) // 64), np.uint64)
    set_ = learned_grams(docs, per_lang, share).mapInPandas(_bits(langs), "slot long, word long, bits long")
    set_ = set_.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    slots[set_["slot"], set_["word"]] = set_["bits"].to_numpy(np.int64).view(np.uint64)
    fill = [float(((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(langs))]
    return model | {"slots": slots, "false": [f**HASHES for f in fill]}


def predict_texts(texts: list, model: dict) -> tuple[list[str], list[float]]:
    """For each text: the language and its share of the corrected popcounts."""
    langs = model["langs"]
    if not langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    hits, total = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    for first, last, points, starts in _chunks(texts):
        for code, inside in _grams(points):
            ends = np.minimum(starts, len(code) - 1)
            total[first:last] += np.add.reduceat(inside, ends, dtype=np.int64)
            first_slot, *more = _slots(code)
            masks = model["slots"][first_slot]
            for at in more:
                masks &= model["slots"][at]
            masks[~inside] = 0
            for k in range(len(langs)):
                bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[first:last, k] += np.add.reduceat(bit, ends, dtype=np.int64)
    false = np.array(model["false"])
    real = np.maximum((hits - total[:, None] * false) / np.maximum(1 - false, 1e-9), 0.0)
    whole = real.sum(1)
    share = np.divide(real, whole[:, None], out=np.zeros_like(real), where=whole[:, None] > 0)
    best = share.argmax(1)
    names, scores = [], []
    for i, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            names.append(UNDETERMINED)
            scores.append(0.0)
        elif whole[i] <= 0:
            names.append(model["prior"])
            scores.append(1.0 / len(langs))
        else:
            names.append(langs[best[i]])
            scores.append(float(min(1.0, share[i, best[i]])))
    return names, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for each row's whole text.

    Null texts and texts without a letter are 'und' with score 0; a text with letters but
    without a known n-gram gets the most frequent learned language; of languages with equal
    shares the first by name is taken. An empty training set gives 'und' everywhere. Very long
    texts are read whole. Repeated rows each give a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(kind)
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict_texts([t or "" for t in texts], shared.value)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select("doc_id", predict("text").alias("x")).select("doc_id", "x.lang_pred", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", MODULUS, REMAINDER)))
    return identify(docs, model).select(
        "doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "lang_pred", "score"
    )
