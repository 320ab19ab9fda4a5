"""SimHash near-dedup by covering locality-sensitive hashing.

A covering family for radius r over d bits gives every bit position a non-zero code of
r + 1 bits and makes one table for each non-zero vector v of r + 1 bits: the table's mask
keeps the positions whose code has an odd inner product with v. For any r positions some v
is orthogonal to all their codes, so two fingerprints that differ in at most r positions
agree under the mask of at least one table: no pair within the radius is missed.

Fingerprints that share no bucket with another fingerprint are settled at once. The others
are linked without making pairs of a bucket: each emits itself and its one-bit changes over
the positions that its colliding tables leave free. Two fingerprints differ in at most two
positions exactly if these sets meet, and all that meet in one value are linked to the
smallest of them, so that work and links grow with the number of fingerprints.

At a shingle similarity of 0.8, fingerprints of 64 bits differ in some 10 positions, and
covering so many would take thousands of tables. Where near copies by similarity are asked for
(near_links, and so keep_first), they are thus brought together by minima of their shingle
hashes instead: BANDS keys of ROWS minima each, of which a pair at similarity s shares none with
probability (1 - s^ROWS)^BANDS (6e-5 at 0.8). Every candidate is verified by the exact Jaccard
similarity of its sets of shingles. Each key has a centre drawn by hash; all that share the key
are compared with it, for FIRST of the keys and then, where no link joins them yet, for the
others. What is then still apart is compared in cells of bounded size: keys with the same
largest component go together, and the sets outside of that component are compared with all
sets of those keys, however many there are, so that a text is in few cells. Only links leave a
cell, one for each set and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from sievegrid.llm.common import connected_components, materialize, table

RADIUS = 2
BITS = 64
SEED = 42
SHINGLE = 3
#: Near copies by similarity: words of a shingle, the least similarity, and the keys that bring pairs together.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Keys whose centres are compared first; sets a side of a cell; shingle sets that a task keeps.
FIRST = 8
OUTSIDE, INSIDE = 256, 1024
_KEPT = 256
_BLOCK = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """One mask per table; position i has the code 1 + i mod (2^(radius + 1) - 1)."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [
        sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))
    ]


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle (of all words if they are fewer), as big-endian bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) >= shingle:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    else:
        grams = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8)


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted set of the hashes of a text's shingles."""
    return np.unique(_hashes(text, shingle).view(">u8").astype(np.uint64))


def near_keys(grams: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(grams), _BLOCK):
        least = np.minimum(least, (grams[at : at + _BLOCK, None] * _FACTORS[0]).min(axis=0))
    least = (least ^ (least >> np.uint64(32))).reshape(BANDS, ROWS)
    return ((least * _FACTORS[1].reshape(BANDS, ROWS)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) or len(b) else 1.0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 of word shingles; see op3's contract. No word: zero."""
    raw = _hashes(text, shingle).reshape(-1, 8)
    if not len(raw):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row's whole text."""
    return docs.select("doc_id", _fingerprints("text").alias("fp"))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `distinct` (fp) within the radius 2."""
    if radius != 2:
        raise ValueError("the one-bit neighbourhoods link exactly within radius 2")
    masks = covering_masks(BITS, radius)
    tables = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("m")) for t, m in enumerate(masks)])
    )
    keyed = distinct.select("fp", tables.alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("x.m").alias("m"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")
    )
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    free = keyed.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or(F.bitwise_not("m")).alias("free"))
    ball = materialize(
        free.select(
            "fp",
            F.explode(
                F.expr(
                    "concat(array(fp), transform(filter(sequence(0, 63), i -> (shiftrightunsigned(free, i) & 1L) = 1L),"
                    " i -> fp ^ shiftleft(1L, i)))"
                )
            ).alias("near"),
        )
    )
    met = ball.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z").select("near", "a")
    return ball.join(met, "near").where("fp != a").select("a", F.col("fp").alias("b")).distinct()


_MARK = StructType([StructField("fp", LongType()), StructField("set", LongType()), StructField("size", IntegerType()), StructField("keys", ArrayType(LongType()))])


@F.pandas_udf(_MARK)
def _marks(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        grams = shingles(t)
        rows.append((signed(fingerprint(t)), signed(xxhash.xxh64_intdigest(grams.tobytes(), SEED)), len(grams), near_keys(grams)))
    return pd.DataFrame(rows, columns=_MARK.names)


@F.pandas_udf(BooleanType())
def _similar(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    kept: dict[int, np.ndarray] = {}

    def grams(key: int, text: str) -> np.ndarray:
        if key not in kept:
            if len(kept) >= _KEPT:
                kept.clear()
            kept[key] = shingles(text)
        return kept[key]

    for a, b, x, y in batches:
        yield pd.Series([similarity(grams(*p), grams(*q)) >= SIMILARITY for p, q in zip(zip(a, x, strict=True), zip(b, y, strict=True), strict=True)], dtype=bool)


def _across(cell: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of the outside sets of a cell: one to each other component that holds a similar set."""
    outside, inside = cell[cell["outside"]], cell[cell["inside"]]
    out = []
    if len(outside) and len(inside):
        sets = [shingles(t) for t in inside["text"]]
        size = np.array([len(x) for x in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        ids, roots = inside["set"].to_numpy(), inside["root"].to_numpy()
        for a, root, text in zip(outside["set"], outside["root"], outside["text"], strict=True):
            mine = shingles(text)
            low, high = np.searchsorted(grams, mine, "left"), np.searchsorted(grams, mine, "right")
            count = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            found = np.flatnonzero((both >= SIMILARITY * (len(mine) + size - both)) & (roots != root))
            _, first = np.unique(roots[found], return_index=True)
            out += [(a, b) for b in ids[found[first]].tolist()]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _text_hash():
    return F.xxhash64("text", F.octet_length("text"))


def near_links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (a, b) of sets of shingles whose components are those of all verified pairs of SIMILARITY or more.

    marks has (doc_id, hash, set, size, keys) of the rows of docs (doc_id, text), hash naming the
    text. Sets that share a key are candidates.
    """
    source = F.min(F.struct("hash", F.col("doc_id").alias("id"))).alias("source")
    sets = marks.where("size > 0").groupBy("set").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), source)
    keyed = sets.select("set", "size", "source", F.posexplode("keys").alias("band", "key"))
    centre = F.min(F.struct(F.xxhash64("key", "set").alias("h"), "set", "size")).alias("c")
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), centre).where("n > 1").select("key", F.col("c.set").alias("centre"), F.col("c.size").alias("least")))
    met = materialize(keyed.join(shared, "key"))
    # one row's text for each set, written before it is grouped, so that the join can be split where a text has very many copies
    wanted = met.select("set", "source.hash", "source.id").distinct()
    at = (F.col("_hash") == F.col("hash")) & F.col("_id").eqNullSafe(F.col("id"))
    texts = materialize(docs.select("text", _text_hash().alias("_hash"), F.col("doc_id").alias("_id")).join(wanted, at).select("set", "text"))
    texts = materialize(texts.groupBy("set").agg(F.min("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
        return materialize(both.where(_similar("a", "b", "x", "y")).select("a", "b"))

    def named(df: DataFrame, found: DataFrame, column: str, root: str) -> DataFrame:
        """df with the component of the set in a column."""
        found = found.select(F.col("node").alias(column), F.col("component").alias(root))
        return df.join(found, column, "left").withColumn(root, F.coalesce(root, column))

    alike = f"set != centre and least(size, least) >= {SIMILARITY} * greatest(size, least)"
    candidates = met.where(alike).select(F.col("centre").alias("a"), F.col("set").alias("b"), "band")
    links = verified(candidates.where(F.col("band") < FIRST).select("a", "b").distinct())
    found = connected_components(links)
    pairs = candidates.where(F.col("band") >= FIRST).select("a", "b").distinct()
    links = links.unionAll(verified(named(named(pairs, found, "a", "r"), found, "b", "s").where("r != s").select("a", "b")))
    rooted = named(met.select("key", "set"), connected_components(links), "set", "root")
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    rest = materialize(rooted.join(materialize(open_.select("key", F.col("most.root").alias("main"))), "key").select("main", "set", "root").distinct())
    sizes = rest.groupBy("main").agg(F.ceil(F.count_if(F.col("root") != F.col("main")) / OUTSIDE).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / INSIDE).cast("int").alias("columns"))
    place = F.xxhash64(F.lit(7), "set")
    rest = rest.join(materialize(sizes), "main").withColumn("row", F.pmod(place, "rows").cast("int")).withColumn("column", F.pmod(place, "columns").cast("int"))
    cells = F.expr(
        "array_distinct(concat(transform(sequence(0, rows - 1), i -> struct(i as i, column as j)),"
        " if(root != main, transform(sequence(0, columns - 1), j -> struct(row as i, j as j)), array())))"
    )
    rest = rest.withColumn("cell", F.explode(cells)).select(
        "main", "cell.i", "cell.j", "set", "root",
        ((F.col("root") != F.col("main")) & (F.col("row") == F.col("cell.i"))).alias("outside"), (F.col("column") == F.col("cell.j")).alias("inside"),
    )
    return links.unionAll(materialize(rest.join(texts, "set").groupBy("main", "i", "j").applyInPandas(_across, "a long, b long").distinct()))


def components(marks: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): the smallest id reachable by links, itself included."""
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(by_fp, "fp")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have the fingerprint zero and are linked like any other;
    repeated rows each give a row; a null id stays null and never names a component unless
    all its members' ids are null. Other columns of docs are not read. Empty table: no rows.
    """
    marks = materialize(fingerprints(docs))
    return components(marks).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: that with the smallest id (null ids last).

    Near copies are texts whose fingerprints are within the radius, and texts whose sets of
    five-word shingles have a similarity of SIMILARITY or more. It is rows that stay or go: of
    two texts under one id each belongs to its own group, and where the smallest id has several
    texts of a group that with the least hash stays. A row that is there several times stays
    once. Null, empty and blank texts are one group. Other columns go with their row. Very long
    texts are read whole; an empty table stays empty.
    """
    marks = materialize(docs.select("doc_id", _text_hash().alias("hash"), _marks("text").alias("x")).select("doc_id", "hash", "x.*"))
    by_fp = marks.groupBy("fp").agg(F.min("set").alias("first"))
    links = fingerprint_links(by_fp.select("fp"))
    first = lambda fp, name: by_fp.select(F.col("fp").alias(fp), F.col("first").alias(name))
    close = links.join(first("a", "p"), "a").join(first("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    equal = marks.select("fp", "set").distinct().join(by_fp, "fp").where("set != first").select(F.col("set").alias("a"), F.col("first").alias("b"))
    found = connected_components(near_links(docs, marks).unionAll(close).unionAll(equal))
    rows = marks.groupBy("set", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(found.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("group", F.coalesce("component", "set"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "n")
    kept = materialize(rows.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.hash").alias("_hash"), F.col("k.n").alias("_n")))
    clear = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # whatever their names are
    named = docs.select(_text_hash().alias("_text"), F.col("doc_id").alias("_doc"), *[F.col(f"`{c}`").alias(n) for c, n in clear.items()])
    joined = named.join(kept, (F.col("_doc").eqNullSafe(F.col("_id"))) & (F.col("_text") == F.col("_hash")))
    back = [F.col(n).alias(c) for c, n in clear.items()]
    several = joined.where("_n > 1").dropDuplicates(["_id", "_hash"])
    return joined.where("_n = 1").select(back).unionAll(several.select(back))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
