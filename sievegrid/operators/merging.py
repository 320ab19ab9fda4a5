"""Merging annotations by priority, with an audit, and joins that must be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.fingerprints import quoted, stable_hash


def _json(x: str) -> Column:
    return F.when(F.col(x).isNull(), F.lit("null")).otherwise(quoted(x))


def signature() -> Column:
    """What two rows of one id must agree on at the same priority."""
    parts = [F.lit('{"group_id":'), _json("group_id"), F.lit(',"inputs":{"features":[],"text":'), quoted("text"), F.lit('},"label_status":'), quoted("label_status"), F.lit(',"target":'), _json("target"), F.lit("}")]
    return stable_hash(F.concat(*parts))


def canonical_sample() -> Column:
    """The whole sample as canonical JSON: ties of priority go to the smallest."""
    parts = []
    for name in ("group_id", "inputs", "label_status", "metadata", "sample_id", "source", "target"):
        value = (
            F.concat(F.lit('{"features":[],"text":'), quoted("text"), F.lit("}")) if name == "inputs" else F.lit("{}") if name == "metadata" else _json(name)
        )
        parts += [F.lit(("{" if not parts else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def equal_priority_conflicts(rows: DataFrame) -> DataFrame:
    """(sample_id, priority) whose rows disagree; a merge of such rows is an error."""
    seen = rows.groupBy("sample_id", "priority").agg(F.min(signature()).alias("a"), F.max(signature()).alias("z"))
    return seen.where("a != z").select("sample_id", "priority")


def merge_by_priority(rows: DataFrame) -> DataFrame:
    """The row of highest priority of each id; ties go to the smallest canonical JSON."""
    best = F.struct((-F.col("priority")).alias("p"), canonical_sample().alias("json"))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("sample_id").agg(F.min_by(whole, best).alias("row")).select("row.*")


def checked_merge(rows: DataFrame) -> DataFrame:
    """merge_by_priority(), after a job that looks for conflicts."""
    bad = equal_priority_conflicts(rows).orderBy("sample_id").first()
    if bad is not None:
        raise ValueError(f"Conflicting samples at equal priority: {bad['sample_id']}")
    return merge_by_priority(rows)


def merge_audit(rows: DataFrame) -> DataFrame:
    """Of each id with several rows: what was chosen, how many there were, and whether targets disagree."""
    best = F.struct((-F.col("priority")).alias("p"), canonical_sample().alias("json"))
    target = F.coalesce(F.concat(F.lit("="), F.col("target")), F.lit("null"))
    out = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max("priority").alias("selected_priority"),
        F.min_by("source", best).alias("selected_source"),
        (F.min(target) != F.max(target)).alias("target_conflict"),
    )
    return out.where(F.col("candidates") > 1)


def override(base: DataFrame, gold: DataFrame, key: str, ordinal: str) -> DataFrame:
    """gold rows over base rows of the same key; of several in one the last counts."""
    every = base.withColumn("_p", F.lit(10)).unionByName(gold.withColumn("_p", F.lit(20)))
    whole = F.struct(*[F.col(c) for c in base.columns])
    return every.groupBy(key).agg(F.max_by(whole, F.struct("_p", ordinal)).alias("row"), F.max("_p").alias("priority")).select("row.*", "priority")


def aligned_join(events: DataFrame, labels: DataFrame, key: str, label: str, ordinal: str) -> DataFrame:
    """events with their labels; every row must have its counterpart and repeated labels must agree.

    Of repeated events the last counts. A missing side or a disagreement fails the query.
    """
    whole = F.struct(*[F.col(c) for c in events.columns])
    last = events.groupBy(key).agg(F.max_by(whole, F.col(ordinal)).alias("row"))
    agreed = labels.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_z"))
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col(key).cast("string")))
    checked = (
        F.when(F.col("row").isNull(), fail("label without event"))
        .when(F.col("_a").isNull(), fail("event without label"))
        .when(F.col("_a") != F.col("_z"), fail("labels disagree"))
        .otherwise(F.col("_a"))
    )
    return last.join(agreed, key, "full_outer").withColumn("_label", checked).select("row.*", F.col("_label").alias(label))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).select(F.lit("left").alias("side"), key).unionAll(b.exceptAll(a).select(F.lit("right").alias("side"), key))


def in_order(samples: DataFrame, predictions: DataFrame, ordinal: str = "ordinal", key: str = "sample_id") -> DataFrame:
    """samples with their predictions, place by place; another number, order or id is an error."""
    right = predictions.withColumnRenamed(key, "_key")
    same = F.col(key).isNotNull() & F.col("_key").isNotNull() & (F.col(key) == F.col("_key"))
    fail = F.raise_error(F.concat(F.lit("samples and predictions differ at "), F.col(ordinal).cast("string")))
    joined = samples.join(right, ordinal, "full_outer")
    return joined.where(F.when(same, F.lit(True)).otherwise(fail)).drop("_key")
