"""Exact substring dedup over sparse suffix arrays.

A passage of LEAST words has LEAST - PREFIX + 1 places where a prefix of PREFIX words fits.
The place whose short word gram hashes lowest (the minimiser) is chosen by content alone, so
two copies of a passage choose the same place in it. Only the suffixes at chosen places are
kept: a sparse suffix array, of which a few hundredths of all positions remain.

The kept suffixes are sorted over the whole table, by their first PREFIX words (a word block's
place in the order is that of its hash) and then by all the words around them that a passage of
LEAST words over the prefix can reach. Rows are dealt by ranges of that order, so that a prefix
in very many documents is spread over as many ranges as it needs. Neighbours in the order are
then compared: suffixes that share their prefix with another document's are candidates, and
those whose surroundings are shared too are extended left and right as far as a passage can
reach at once. Runs that touch the border of a range are settled over all ranges by partial
minima and maxima. For the candidates that no neighbour settles, every passage of LEAST words
over the prefix is compared. What is shared is merged into maximal spans. No pair of documents
is ever formed, and no run of equal suffixes is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sievegrid.llm.common import materialize, table

LEAST = 50
PREFIX = 15
GRAM = 5
_BASE = 0x9E3779B97F4A7C15
_CACHE = 300_000
_PIECE = 1 << 18
#: Suffixes of one range of the order.
RANGE = 500_000
_INSIDE, _PLACE, _BORDER = 0, 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Grams:
    """Hashes of all n-word runs of a sequence of word hashes, from runs of powers of two."""

    def __init__(self, words: np.ndarray):
        self.by = {1: words}

    def _power(self, n: int) -> np.ndarray:
        if n not in self.by:
            half = self._power(n // 2)
            b = np.uint64(pow(_BASE, n // 2, 1 << 64))
            self.by[n] = half[: len(half) - n // 2] * b + half[n // 2 :] if len(half) > n // 2 else half[:0]
        return self.by[n]

    def of(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of n words from each position (all positions where they fit, if at is None)."""
        out, done = None, 0
        while done < n:
            p = 1 << ((n - done).bit_length() - 1)
            run = self._power(p)
            part = run[done : done + len(self.by[1]) - n + 1] if at is None else run[at + done]
            out = part if out is None else out * np.uint64(pow(_BASE, p, 1 << 64)) + part
            done += p
        return _mixed(out)


class Reader:
    """Word hashes of texts; keeps a bounded cache of words."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        cache, digest = self.cache, xxhash.xxh64_intdigest
        if len(cache) > _CACHE:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def minimisers(words: np.ndarray, least: int = LEAST, prefix: int = PREFIX, gram: int = GRAM) -> np.ndarray:
    """Sorted positions of the chosen suffixes; at least one is in the first least - prefix + 1 words of every run of `least`."""
    n = len(words)
    if n < least:
        return np.zeros(0, np.int64)
    reach = least - prefix + 1
    key = _Grams(words).of(gram)[: n - prefix + 1]
    found = []
    for at in range(0, len(key) - reach + 1, _PIECE):
        piece = key[at : at + _PIECE + reach - 1]
        low = np.lib.stride_tricks.sliding_window_view(piece, reach).argmin(1)
        found.append(np.unique(at + np.arange(len(low)) + low))
    return np.unique(np.concatenate(found))


def suffixes(words: np.ndarray, least: int = LEAST, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, prefix hash and surroundings' hash (0 where the text is too short for them) of each kept suffix."""
    at = minimisers(words, least, prefix)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = _Grams(words)
    around = np.zeros(len(at), np.uint64)
    whole = (at >= least - prefix) & (at + least <= len(words))
    if whole.any():
        around[whole] = grams.of(2 * least - prefix, at[whole] - (least - prefix)) | np.uint64(1)
    return at, grams.of(prefix, at), around


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = Reader()
    for f in frames:
        rows = []
        for key, text in zip(f["key"], f["text"], strict=True):
            at, h, around = suffixes(read(text))
            if len(at):
                rows.append((key, at.astype(np.int32), h.view(np.int64), around.view(np.int64)))
        yield pd.DataFrame(rows, columns=["key", "at", "h", "around"])


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the neighbours in one range of the order (h, around, key, at) say of its suffixes.

    _INSIDE: another document has the same surroundings. _PLACE: another has the prefix, and the
    passages over it are to be compared. _BORDER: what no neighbour in this range can say, as the
    run goes on in another range, and for each run at a border the rows with its extreme keys.
    Suffixes whose prefix no other document has are left out.
    """
    read = list(frames)
    if not sum(map(len, read)):
        return
    f = pd.concat(read, ignore_index=True)
    h, around, key, at = (f[c].to_numpy() for c in ("h", "around", "key", "at"))
    new_run = np.concatenate(([True], h[1:] != h[:-1]))
    new_class = new_run | np.concatenate(([True], around[1:] != around[:-1]))
    run, group = np.cumsum(new_run) - 1, np.cumsum(new_class) - 1
    first, runs = np.flatnonzero(new_class), np.flatnonzero(new_run)
    last = np.append(first[1:], len(f)) - 1
    settled = (key[first] != key[last])[group]
    shared = (np.minimum.reduceat(key, runs) != np.maximum.reduceat(key, runs))[run]
    open_ = np.logical_or.reduceat(~settled, runs)[run]
    # of a class with equal surroundings two documents say all there is to compare
    speaks = np.zeros(len(f), bool)
    speaks[first] = speaks[last] = True
    at_border = (run == 0) | (run == run[-1])
    cut = (group == 0) | (group == group[-1])
    waits = at_border & ~settled & (cut | ~shared)
    border = waits.copy()
    border[[first[0], last[0], first[-1], last[-1]]] = True
    for start, end in ((0, runs[1] if len(runs) > 1 else len(f)), (runs[-1], len(f))):
        border[[start + key[start:end].argmin(), start + key[start:end].argmax()]] = True
    # whether a run at a border has a lone class in another range is not known: its classes always speak
    place = shared & ~waits & (~settled | ((open_ | at_border) & speaks))
    inside = settled
    for kind, chosen in ((_INSIDE, inside), (_PLACE, place), (_BORDER, border)):
        whole = kind == _BORDER
        yield pd.DataFrame(
            {"kind": np.int8(kind), "key": key[chosen], "at": at[chosen], "h": h[chosen] if whole else 0, "around": around[chosen] if whole else 0}
        )


def suffix_order(kept: DataFrame, rows: int, per_range: int) -> DataFrame:
    """kept (key, at, h, around, salt) in ranges of the order of the suffixes, each sorted.

    Rows that are equal in everything differ in the salt, so that repeated documents split as well.
    """
    order = ["h", "around", "key", "at", "salt"]
    return kept.repartitionByRange(max(1, -(-rows // per_range)), *order).sortWithinPartitions(*order)


def _settle(border: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inside, places), each (key, at), of the _BORDER rows of all ranges.

    A class or run that several ranges share has its extreme keys here from each of them. Some
    rows were settled in their range already; what is said of them again changes no span.
    """
    classes = materialize(
        border.groupBy("h", "around").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.min(F.struct("key", "at")).alias("first"), F.max(F.struct("key", "at")).alias("last"))
    )
    # written, so that the joins have exchanges of their own, which can be split where many share a prefix
    runs = materialize(classes.groupBy("h").agg(F.min("a").alias("x"), F.max("z").alias("y")).where("x != y").select("h"))
    said = materialize(classes.join(runs, "h"))
    inside = border.join(said.where("a != z").select("h", "around"), ["h", "around"]).select("key", "at")
    single = border.join(said.where("a = z").select("h", "around"), ["h", "around"]).select("key", "at")
    speakers = said.where("a != z").select(F.explode(F.array("first", "last")).alias("x")).select("x.key", "x.at")
    return inside, single.unionAll(speakers)


def _passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All passages of LEAST words that contain the prefix of one of the given suffixes."""
    read = Reader()
    for f in frames:
        rows = []
        for key, text, places in zip(f["key"], f["text"], f["places"], strict=True):
            words = read(text)
            places = np.unique(np.asarray(places, np.int64))
            start = np.unique((places[:, None] - np.arange(LEAST - PREFIX + 1)).ravel())
            start = start[(start >= 0) & (start + LEAST <= len(words))]
            if len(start):
                rows.append((key, start.astype(np.int32), _Grams(words).of(LEAST, start).view(np.int64)))
        yield pd.DataFrame(rows, columns=["key", "start", "passage"])


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _merged(starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for s, e in zip(starts, ends, strict=True):
        order = np.argsort(s, kind="stable")
        s, e = np.asarray(s)[order], np.maximum.accumulate(np.asarray(e)[order])
        new = np.concatenate(([True], s[1:] > e[:-1]))
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))
        out.append([{"start": int(a), "end": int(b)} for a, b in zip(s[new], e[last], strict=True)])
    return pd.Series(out)


def repeated_spans(docs: DataFrame, per_range: int = RANGE) -> DataFrame:
    """(doc_id, start, end, n_words): the maximal runs of words (from 0; end excluded) of each
    document that are covered by passages of LEAST or more words that another document has too.

    Words are what lies between white space, compared exactly. Rows that are equal in id and
    text are one document; other rows are different documents even if their ids are equal or
    null. Null, empty and shorter texts have no spans. Very long texts are read whole, one at a
    time. Other columns are not read. per_range is about how many suffixes one task sorts.
    """
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    arrays = docs.select("key", "text").mapInPandas(_kept, "key long, at array<int>, h array<long>, around array<long>")
    packed = materialize(arrays.withColumn("salt", (F.monotonically_increasing_id() % 1024).cast("short")))
    rows = packed.agg(F.sum(F.size("at"))).first()[0] or 0
    kept = packed.select("key", "salt", F.explode(F.arrays_zip("at", "h", "around")).alias("x")).select("key", "x.at", "x.h", "x.around", "salt")
    # suffixes without all of their surroundings are in a class of their own
    kept = kept.withColumn("around", F.when(F.col("around") == 0, F.xxhash64("key", "at")).otherwise(F.col("around")))
    found = materialize(suffix_order(kept, rows, per_range).mapInPandas(_neighbours, "kind byte, key long, at int, h long, around long"))
    inside, places = _settle(found.where(F.col("kind") == _BORDER))
    inside = found.where(F.col("kind") == _INSIDE).select("key", "at").unionAll(inside)
    inside = inside.select("key", (F.col("at") - (LEAST - PREFIX)).alias("start"), (F.col("at") + LEAST).alias("end"))
    places = found.where(F.col("kind") == _PLACE).select("key", "at").unionAll(places)
    places = places.groupBy("key").agg(F.collect_list("at").alias("places"))
    texts = docs.select("key", "text")
    packed = materialize(texts.join(places, "key").mapInPandas(_passages, "key long, start array<int>, passage array<long>"))
    passages = packed.select("key", F.explode(F.arrays_zip("start", "passage")).alias("x")).select("key", "x.start", "x.passage")
    common = materialize(passages.groupBy("passage").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z").select("passage"))
    edges = passages.join(common, "passage").select("key", "start", (F.col("start") + LEAST).alias("end"))
    merge = F.pandas_udf(_merged, _SPANS)
    spans = inside.unionAll(edges).groupBy("key").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))
    spans = spans.select("key", F.explode(merge("s", "e")).alias("x"))
    named = docs.select("doc_id", "key").distinct()
    return named.join(spans, "key").select("doc_id", "x.start", "x.end", (F.col("x.end") - F.col("x.start")).alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with docs as (
  select distinct doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') as words from documents where text is not null),
keyed as (select doc_id, words, row_number() over () as key from docs),
windows as (
  select doc_id, key, start, md5(array_to_string(words[start + 1:start + {LEAST}], ' ')) as passage
  from (select doc_id, key, words, unnest(range(len(words) - {LEAST - 1})) as start from keyed where len(words) >= {LEAST})),
shared as (select passage from windows group by passage having min(key) <> max(key)),
marked as (select doc_id, key, start, start - lag(start) over (partition by key order by start) as gap from windows semi join shared using (passage)),
runs as (select doc_id, key, start, sum(case when gap is null or gap > {LEAST} then 1 else 0 end) over (partition by key order by start) as run from marked)
select doc_id, min(start)::int as start, (max(start) + {LEAST})::int as "end", (max(start) + {LEAST} - min(start))::int as n_words from runs group by doc_id, key, run
"""
