"""Reproducible splits and samples, ordered by seeded hashes of the rows' ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.fingerprints import seeded_order
from sievegrid.operators.ranking import first_rows, hashed_rank
from sievegrid.session import materialize


def stratified_split(rows: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """rows with `part`: of each label the first max(1, round(n * ratio)) are 'val', the others 'train'."""
    ranked = hashed_rank(rows.withColumn("_order", seeded_order(seed, key)), [label], "_order", "_rank", "_n")
    val = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0)).cast("long")
    return ranked.withColumn("part", F.when(F.col("_rank") <= val, "val").otherwise("train")).select(*rows.columns, "part")


def round_robin_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows with distinct keys: one of each stratum in turn, small strata first, until it is full."""
    unique = first_rows(rows, [key], [F.col(stratum)])
    ranked = hashed_rank(unique.withColumn("_order", seeded_order(seed, key)), [stratum], "_order", "_rank")
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, stratum).orderBy("_rank", "_n", stratum).limit(size).select(rows.columns)


def ranked_templates(rows: DataFrame, score: str, key: str, template: str, size: int) -> DataFrame:
    """The `size` best rows by score and key, the best of each template only; fewer is an error."""
    found = first_rows(rows.where(F.col(score) > 0), [template], [F.desc(score), F.col(key)])
    chosen = found.orderBy(F.desc(score), key).limit(size)
    enough = F.when(F.lit(found.count() >= size), F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {size} templates")))
    return chosen.where(enough)


def tune_targets(counts: dict[str, int], size: int) -> dict[str, int]:
    """`size` dealt over labels in proportion to their counts, by largest remainders, ties by name."""
    total = sum(counts.values())
    if not 0 < size < total:
        raise ValueError("the tuning part must be smaller than the whole and not empty")
    share = {k: n * size / total for k, n in counts.items()}
    out = {k: int(v) for k, v in share.items()}
    for k in sorted(counts, key=lambda k: (out[k] - share[k], k))[: size - sum(out.values())]:
        out[k] += 1
    return out


def first_ways(sizes: np.ndarray, target: int) -> np.ndarray | None:
    """Places of the sizes, taken in their order, that add up to target: the first way found for each sum.

    `first` has for each sum the place of the size that first completed it. As long as the sums
    reached leave no gap and the next size makes none, a size adds just the sums above them, and
    all such sizes are settled at once; any other size takes one pass over the sums so far.
    """
    if target == 0:
        return np.empty(0, np.int64)
    places = np.flatnonzero(sizes <= target)
    own = sizes[places].astype(np.int64)
    unit = int(np.gcd.reduce(own)) if len(own) else 0
    if not unit or target % unit or own.sum() < target:
        return None
    own, target = own // unit, target // unit
    first, seen = np.full(target + 1, -1, np.int64), np.zeros(target + 1, bool)
    seen[0] = True
    at, top, reached = 0, 0, 1  # top: all sizes so far; reached: how many sums
    while at < len(own) and not seen[target]:
        if reached == top + 1:
            above = top + np.cumsum(own[at:])
            gaps = own[at:] > above - own[at:] + 1
            n = min(int(gaps.argmax()) if gaps.any() else len(gaps), int(np.searchsorted(above, target)) + 1)
            if n:
                new = np.repeat(np.arange(at, at + n), own[at : at + n])[: target - top]
                first[top + 1 : top + 1 + len(new)], seen[top + 1 : top + 1 + len(new)] = new, True
                at, top, reached = at + n, int(above[n - 1]), int(above[n - 1]) + 1
                continue
        n = int(own[at])
        end = min(top, target - n) + 1
        new = np.flatnonzero(seen[:end] > seen[n : n + end]) + n
        first[new], seen[new] = at, True
        at, top, reached = at + 1, top + n, reached + len(new)
    if not seen[target]:
        return None
    out = []
    while target:
        out.append(int(first[target]))
        target -= int(own[out[-1]])
    return places[out[::-1]]


def exact_subset(sizes: list[tuple[str, int]], target: int) -> list[str] | None:
    """Names, taken in the given order, whose sizes add up to target: the first way found for each sum."""
    found = first_ways(np.array([n for _, n in sizes], np.int64), target)
    return None if found is None else [sizes[i][0] for i in found]


def template_grouped_split(rows: DataFrame, label: str, template: str, key: str, size: int, seed: int) -> DataFrame:
    """rows with `part` ('tune' or 'regress') and `position`: whole templates go to one part, exactly `size` rows to tune.

    The templates of a label are ranked by the engine. The driver gets the counts of each label,
    and of each template of several rows its rank and size; it gives back the last rank of each
    label that is in tune, and the ranks before it that are not.
    """
    spark = rows.sparkSession
    clusters = materialize(rows.groupBy(label, template).agg(F.count(F.lit(1)).alias("_size")))
    sums = clusters.groupBy(label).agg(F.sum("_size"), F.count(F.lit(1)), F.count(template)).collect()
    if any(r[0] in (None, "") for r in sums):
        raise ValueError("a gold row has no verdict")
    if any(r[2] != r[3] for r in sums):
        raise ValueError("a gold row has no template")
    targets, templates = tune_targets({r[0]: r[1] for r in sums}, size), {r[0]: r[2] for r in sums}
    ranked = materialize(hashed_rank(clusters.withColumn("_order", seeded_order(seed, template)), [label], "_order", "_rank").drop("_order"))
    several = ranked.where("_size > 1").select(label, "_rank", "_size").toArrow()
    last, out = [], []
    for name, target in sorted(targets.items()):
        own = several.filter(pc.equal(several[label], name))
        sizes = np.ones(templates[name], np.int64)
        sizes[own["_rank"].to_numpy() - 1] = own["_size"].to_numpy()
        places = first_ways(sizes, target)
        if places is None:
            raise RuntimeError(f"no whole templates of {name} make up {target} rows")
        last.append((name, int(places[-1]) + 1 if len(places) else 0))
        ranks = np.setdiff1d(np.arange(last[-1][1]), places) + 1
        out.append(pa.table({label: pa.array([name] * len(ranks), pa.string()), "_rank": pa.array(ranks, pa.int64())}))
    ends = spark.createDataFrame(last, f"`{label}` string, _last long")
    left_out = spark.createDataFrame(pa.concat_tables(out)).withColumn("_out", F.lit(True))
    tune = F.col("_out").isNull() & (F.col("_rank") <= F.col("_last"))
    chosen = materialize(ranked.join(F.broadcast(ends), label).join(left_out, [label, "_rank"], "left").select(label, template, tune.alias("_tune")))
    if not chosen.groupBy(template).agg(F.min("_tune").alias("_all"), F.max("_tune").alias("_any")).where("_all <> _any").isEmpty():
        raise RuntimeError("a template would be in both parts")
    parted = rows.join(chosen, [label, template], "left").withColumn("part", F.when(F.col("_tune"), "tune").otherwise("regress"))
    ordered = materialize(parted.withColumn("_order", seeded_order(seed, key)))
    return hashed_rank(ordered, ["part"], "_order", "position").select(*rows.columns, "part", "position")
