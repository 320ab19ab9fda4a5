"""Overlap between partitions by identity keys, and hashed lineage of what was learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.fingerprints import membership_key

KINDS = ("id", "exact", "template", "group")


def key_table(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """rows (dataset, sample_id, exact, template, group_id) as (dataset, kind, value), blanks left out."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in zip(KINDS, ("sample_id", "exact", "template", "group_id"), strict=True)]
    )
    long = rows.select(dataset, F.explode(pairs).alias("x")).select(dataset, "x.kind", "x.value")
    return long.where("value is not null and trim(value) != ''")


def key_coverage(keys: DataFrame) -> DataFrame:
    """(dataset, kind, covered, distinct_keys): rows with a key, and different keys."""
    per = keys.groupBy("dataset", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dataset", "kind").agg(F.sum("n").alias("covered"), F.count(F.lit(1)).alias("distinct_keys"))


def pair_overlaps(keys: DataFrame, datasets: list[str]) -> DataFrame:
    """(left, right, kind, shared) for every pair of datasets and kind, zeros too.

    A key's datasets come together in one aggregation; the number of datasets, not of rows,
    bounds what is gathered for a key.
    """
    spark = keys.sparkSession
    spread = keys.groupBy("kind", "value").agg(F.array_sort(F.collect_set("dataset")).alias("in"))
    pairs = spread.where(F.size("in") > 1).select(
        "kind", F.explode(F.flatten(F.transform("in", lambda a: F.transform(F.filter("in", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))).alias("p")
    )
    counts = pairs.groupBy("p.left", "p.right", "kind").agg(F.count(F.lit(1)).alias("shared"))
    names = sorted(datasets)
    every = [(a, b, k) for i, a in enumerate(names) for b in names[i + 1 :] for k in KINDS]
    frame = spark.createDataFrame(every, "`left` string, `right` string, kind string")
    return frame.join(counts, ["left", "right", "kind"], "left").select("left", "right", "kind", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def lineage(keys: DataFrame) -> DataFrame:
    """(dataset, kind, key_hash): the distinct keys, hashed, as an artifact keeps them."""
    return keys.select("dataset", "kind", membership_key("kind", "value").alias("key_hash")).distinct()


def lineage_overlaps(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(dataset, kind, shared) of hashed keys of `incoming` (kind, key_hash) in stored entries.

    The entry '*' unites all: a key in several entries counts once there.
    """
    keys = incoming.select("kind", "key_hash").distinct()
    met = stored.select("dataset", "kind", "key_hash").distinct().join(keys, ["kind", "key_hash"])
    single = met.groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("shared"))
    union = met.select("kind", "key_hash").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("shared"))
    return single.unionByName(union.withColumn("dataset", F.lit("*")))


def split_violations(overlaps: list[dict], specs: dict[str, dict], coverage: dict[str, dict[str, int]]) -> dict:
    """What pair_overlaps() and key_coverage() mean for the claimed purposes of the datasets.

    specs: purpose, independent, provenance and count by dataset. Everything here is a few
    rows per dataset.
    """
    learning = {"train", "development"}
    tests = sorted(n for n, s in specs.items() if s["purpose"] == "independent_test")
    trained = any(s["purpose"] == "train" and s["count"] for s in specs.values())
    out = [
        {"scope": "independent_test", "code": "missing_independence_evidence", "datasets": [n]}
        for n in tests
        if not (specs[n]["independent"] and specs[n]["provenance"].strip() and specs[n]["count"])
    ]
    if tests and not trained:
        out.append({"scope": "independent_test", "code": "missing_training_reference", "datasets": tests})
    for n in sorted(specs) if tests else []:
        missing = [k for k in ("exact", "template") if coverage.get(n, {}).get(k, 0) != specs[n]["count"]]
        if missing:
            out.append({"scope": "independent_test", "code": "incomplete_fingerprint_coverage", "datasets": [n], "keys": missing})
    shared: dict[tuple[str, str], dict[str, int]] = {}
    for r in overlaps:
        shared.setdefault((r["left"], r["right"]), {})[r["kind"]] = r["shared"]
    for (a, b), by_kind in sorted(shared.items()):
        purposes = {specs[a]["purpose"], specs[b]["purpose"]}
        if not any(by_kind.values()):
            continue
        if purposes <= learning:
            scope = "training_selection"
        elif "independent_test" in purposes and len(purposes) == 2:
            scope = "independent_test"
        else:
            continue
        out.append({"scope": scope, "code": "partition_overlap", "datasets": [a, b], "overlaps": by_kind})
    bad = {v["scope"] for v in out}
    return {
        "violations": out, "training_selection_valid": "training_selection" not in bad, "training_reference_present": trained,
        "independent_test_eligible": bool(tests) and "independent_test" not in bad, "valid": not out,
    }


def require(report: dict, *, for_training: bool = False, independent: bool = False) -> None:
    """Fail unless the report allows this use; with neither flag, unless all is valid."""
    if for_training and not report["training_selection_valid"]:
        raise ValueError("training and development partitions overlap")
    if independent and not report["independent_test_eligible"]:
        raise ValueError("no eligible independent test")
    if not for_training and not independent and not report["valid"]:
        raise ValueError("the datasets fail the isolation checks")
