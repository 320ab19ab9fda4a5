"""Which samples may be learned from, and why the others may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("labeled", "unlabeled", "unresolved", "conflict")
PURPOSES = ("train", "development", "historical_regression", "independent_test")


def check_samples(samples: DataFrame) -> DataFrame:
    """(ordinal, problem) of samples that break the contract; empty if all are valid."""
    problem = (
        F.when(F.coalesce(F.trim("sample_id"), F.lit("")) == "", "sample_id must be a non-blank string")
        .when(F.col("source").isNull(), "source must be a string")
        .when(F.col("group_id").isNotNull() & (F.trim("group_id") == ""), "group_id must be non-blank or null")
        .when(~F.coalesce(F.col("label_status").isin(*STATUSES), F.lit(False)), "unknown label_status")
    )
    return samples.select("ordinal", problem.alias("problem")).where("problem is not null")


def repeated_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def exclusion_reasons(samples: DataFrame, mapping: dict[str, str] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """samples with `reason` (null: used) and `training_target`.

    Without a mapping every target stands for itself. A target that is neither mapped nor
    excluded is an error on any row, also on one that would be left out for its status.
    """
    if mapping and set(mapping) & set(excluded):
        raise ValueError("a target is both mapped and excluded")
    target, status = F.col("target"), F.col("label_status")
    if mapping is None:
        mapped = target
    else:
        mapped = F.lit(None).cast("string")
        for k, v in mapping.items():
            mapped = F.when(target == k, F.lit(v)).otherwise(mapped)
        legal = target.isNull() | target.isin(*mapping, *excluded)
        mapped = F.when(legal, mapped).otherwise(F.raise_error(F.concat(F.lit("unrecognized target of sample "), F.col("sample_id"))))
    out = F.lit(False) if not excluded else target.isin(*excluded)
    reason = (
        F.when(status.isin("unresolved", "conflict"), F.concat(F.lit("status:"), status))
        .when(target.isNull() | (status == "unlabeled"), "unlabeled")
        .when(out, F.concat(F.lit("target:"), target))
    )
    return samples.withColumn("training_target", mapped).withColumn("reason", reason)


def preparation_counts(reasoned: DataFrame) -> DataFrame:
    """(measure, value, rows): rows by reason, and used rows by training target."""
    why = reasoned.where("reason is not null").groupBy(F.col("reason").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    used = reasoned.where("reason is null").groupBy(F.col("training_target").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return why.select(F.lit("reason").alias("measure"), "value", "rows").unionAll(used.select(F.lit("class").alias("measure"), "value", "rows"))
