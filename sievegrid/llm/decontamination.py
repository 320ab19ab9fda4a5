"""Benchmark decontamination: a BM25 inverted index of test items, searched block by block.

Each test item is indexed under its words; the weight of a word in an item is its BM25 part,
divided by the item's score for itself, so that 1 is a passage with all of the item's words.
Items lie in blocks, and each posting keeps a word's highest weight in a block. Every passage
of every document is a query, at the lengths that the items have: cells of L words for items
of up to L, two neighbouring cells a passage, so that an item lies wholly in one of them.
Numbers of items, document frequencies and the mean length are those of all items, in however
many indexes they lie.

As in block-max WAND, the words whose highest weights can't together reach the threshold are
not essential: they only add their bound. A passage is scored against a block's items only if
the block maxima of its essential words, with that bound, reach the threshold; all items
that do reach it are retrieved, and then verified: FIVE-word shingles of the item, and the
words of its question and of its answer (the last sentence), must occur in the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import batched, repeat
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from sievegrid.llm.common import materialize, table

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK = 2
#: Sums held at once while a text is searched.
MOST_SUMS = 1 << 21
FIVE = 5
OVERLAP = 0.8
PART_OVERLAP = 0.5
#: An index is broadcast; beyond this size of the items' texts there are several, and so many are searched in one pass over the documents.
INDEX_BYTES = 16 << 20
TOGETHER = 4

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(seq: list, n: int = FIVE) -> set:
    """The n-word shingles; a shorter sequence is one shingle, none gives none."""
    return {tuple(seq[i : i + n]) for i in range(max(1, len(seq) - n + 1))} if seq else set()


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words before the last sentence, and of it; a single sentence is a question without an answer."""
    parts = [w for w in map(words, _SENTENCE.split((text or "").strip())) if w]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])


class Index:
    """Some of the items by length class; built on the driver, of size INDEX_BYTES at most.

    n, tokens and df (items that hold a word) are those of all items of all indexes.
    """

    def __init__(self, items: list[tuple[int, str]], n: int, tokens: int, df: dict[str, int]):
        kept = sorted(((i, words(t), *question_and_answer(t)) for i, t in items if words(t)), key=lambda x: (len(x[1]), str(x[0])))
        self.items = kept
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws, _, _ in kept for w in ws}))}
        mean = tokens / max(n, 1)
        idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.ids}
        self.shingles = [shingles([self.ids[w] for w in ws]) for _, ws, _, _ in kept]
        self.parts = [({self.ids[w] for w in q}, {self.ids[w] for w in a}) for _, _, q, a in kept]
        sizes = defaultdict(list)
        for k, (_, ws, _, _) in enumerate(kept):
            sizes[max(16, 1 << (len(ws) - 1).bit_length())].append(k)
        self.classes = []
        for length, members in sorted(sizes.items()):
            weight = []
            for k in members:
                ws = kept[k][1]
                raw = {self.ids[w]: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean)) for w, f in Counter(ws).items()}
                whole = sum(raw.values())
                weight.append({t: x / whole for t, x in raw.items()})
            self.classes.append(self._class(length, members, weight))

    def _class(self, length: int, members: list[int], weight: list[dict]) -> dict:
        highest = np.zeros(len(self.ids))
        maxima = defaultdict(dict)
        for j, of in enumerate(weight):
            for t, x in of.items():
                highest[t] = max(highest[t], x)
                b = j // BLOCK
                maxima[t][b] = max(maxima[t].get(b, 0.0), x)
        # words in the order of what their postings cost for each unit of bound they add
        order = sorted(maxima, key=lambda t: (highest[t] / len(maxima[t]), t))
        bound, essential = 0.0, np.zeros(len(self.ids), bool)
        for t in order:
            if bound + highest[t] < THRESHOLD / 2:
                bound += highest[t]
            else:
                essential[t] = True
        postings = [sorted(maxima[t].items()) if essential[t] else [] for t in range(len(self.ids))]
        count = np.array([len(p) for p in postings], np.int64)
        return {
            "length": length, "members": members, "weight": weight, "need": THRESHOLD - bound - 1e-9, "essential": essential,
            "count": count, "start": np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count,
            "block": np.array([b for p in postings for b, _ in p], np.int64), "top": np.array([x for p in postings for _, x in p]),
            "blocks": (len(members) + BLOCK - 1) // BLOCK,
        }

    def _survivors(self, c: dict, cell: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:
        """(cell, block) where the block maxima of the words of this cell and the next reach what is needed.

        cell is sorted. The passage that ends in the first cell with an essential word begins in the
        cell before it. Long texts go by ranges of cells, so that the table of sums stays small.
        """
        nb = c["blocks"]
        step = max(1, MOST_SUMS // nb)
        for low in range(max(int(cell[0]) - 1, 0), int(cell[-1]) + 1, step):
            here = slice(*np.searchsorted(cell, (low, low + step + 1)))
            part, count = t[here], c["count"][t[here]]
            if not len(part):
                continue
            at = np.repeat(c["start"][part] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            rows = step + 1 if int(cell[-1]) >= low + step else int(cell[-1]) - low + 1
            key = np.repeat(cell[here] - low, count) * nb + c["block"][at]
            sums = np.bincount(key, weights=c["top"][at], minlength=rows * nb).reshape(rows, nb)
            pair = sums[: min(step, rows)].copy()
            pair[: rows - 1] += sums[1 : len(pair) + 1]
            for first, block in zip(*np.nonzero(pair >= c["need"]), strict=True):
                yield low + int(first), int(block)

    def search(self, text: str | None) -> list[tuple[int, float, float, bool]]:
        """(item, BM25 score, shingle overlap, verified) of each item that some passage retrieves."""
        found: dict[int, tuple[float, float, bool]] = {}
        ids = np.fromiter(map(self.ids.get, words(text), repeat(-1)), np.int64)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        terms = ids[known]
        for c in self.classes:
            use = c["essential"][terms]
            if not use.any():
                continue
            # a word counts once in a cell
            cell, t = np.divmod(np.unique(known[use] // c["length"] * len(self.ids) + terms[use]), len(self.ids))
            for first, block in self._survivors(c, cell, t):
                low, high = first * c["length"], (first + 2) * c["length"]
                passage = ids[low:high].tolist()
                present = set(passage)
                grams = None
                for j in range(block * BLOCK, min((block + 1) * BLOCK, len(c["members"]))):
                    score = sum(x for t, x in c["weight"][j].items() if t in present)
                    if score < THRESHOLD:
                        continue
                    k = c["members"][j]
                    if grams is None or len(self.items[k][1]) < FIVE:
                        n = min(FIVE, len(self.items[k][1]))
                        grams = shingles(passage, n)
                    own = self.shingles[k]
                    overlap = len(own & grams) / len(own)
                    parts = all(len(p & present) >= PART_OVERLAP * len(p) for p in self.parts[k])
                    if len(self.items[k][1]) < FIVE:
                        grams = None
                    now = (score, overlap, overlap >= OVERLAP and parts)
                    found[k] = max(found.get(k, now), now, key=lambda x: (x[2], x[1], x[0]))
        return [(self.items[k][0], *x) for k, x in sorted(found.items())]


def statistics(items: list[str]) -> tuple[int, int, dict[str, int]]:
    """Items with words, their words, and for each word the items that hold it."""
    all_words = [w for w in map(words, items) if w]
    return len(all_words), sum(map(len, all_words)), Counter(x for w in all_words for x in set(w))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each part and word: the items that hold it; the word '' has the items with words and their words."""
    for f in frames:
        for part, rows in f.groupby("part"):
            n, tokens, df = statistics(rows["text"].tolist())
            names = ["", *df]
            yield pd.DataFrame({"part": part, "word": names, "n": [n, *df.values()], "tokens": [tokens] + [0] * len(df)})


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, key): the key names the item's text, so that a repeated text is searched once."""
    return benchmark.where("text is not null").select("item_id", F.xxhash64("text", F.octet_length("text")).alias("key"), "text")


def indexes(items: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all distinct texts of items (key, text), each of at most about most_bytes of text."""
    texts = items.groupBy("key").agg(F.min("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))
    texts = materialize(texts.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")))
    counted = materialize(texts.mapInPandas(_counted, "part int, word string, n long, tokens long"))
    n, tokens = counted.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = counted.where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))
    for k in range(parts):
        mine = texts.where(F.col("part") == k).select("key", "text").collect()
        of = df.join(counted.where(F.col("part") == k).select("word").distinct(), "word", "left_semi").toPandas()
        yield Index([tuple(r) for r in mine], n, tokens, dict(zip(of["word"], of["n"].tolist(), strict=True)))


_HIT = StructType([StructField("key", LongType()), StructField("bm25", DoubleType()), StructField("overlap", DoubleType()), StructField("verified", BooleanType())])


def _hits(shared):
    @F.pandas_udf(ArrayType(_HIT))
    def hits(texts: pd.Series) -> pd.Series:
        fields = _HIT.names
        return pd.Series([[dict(zip(fields, h, strict=True)) for h in shared.value.search(t) if h[3]] for t in texts])

    return hits


def _clean(shared):
    @F.pandas_udf(BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not any(h[3] for h in shared.value.search(t)) for t in texts], dtype=bool)

    return clean


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25, overlap) of each document row and test item that it contains.

    Rows without text or without words, and items without words, match nothing; repeated rows
    each give their rows, repeated items theirs; ties do not arise, as every item found counts.
    An item of fewer than five words must occur as a whole. Very long texts are searched whole,
    by ranges of cells. An empty table gives no rows. Only doc_id, item_id and the texts are read.
    """
    items = distinct_items(benchmark)
    found = None
    for group in batched(indexes(items), TOGETHER):
        hits = [_hits(docs.sparkSession.sparkContext.broadcast(index)) for index in group]
        part = docs.select("doc_id", F.explode(F.concat(*[h("text") for h in hits])).alias("h")).select("doc_id", "h.key", "h.bm25", "h.overlap")
        found = part if found is None else found.unionAll(part)
    return found.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "bm25", "overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain a test item."""
    for group in batched(indexes(distinct_items(benchmark)), TOGETHER):
        clean = [_clean(docs.sparkSession.sparkContext.broadcast(index))("text") for index in group]
        docs = docs.where(reduce(and_, clean))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
