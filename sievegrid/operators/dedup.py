"""Deduplication that drops what is labelled in conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ranking import first_rows


def label_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, labels): keys with more than one distinct label, the labels sorted.

    A set of the distinct labels is all that is gathered for a key.
    """
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return found.where(F.size("labels") > 1)


def exact_unique(rows: DataFrame, key: str, label: str, ordinal: str) -> DataFrame:
    """The first row of each key without a label conflict, by one partial aggregation."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    firsts = rows.groupBy(key).agg(
        F.min_by(whole, F.col(ordinal)).alias("row"), F.min(label).alias("_low"), F.max(label).alias("_high")
    )
    return firsts.where("_low <=> _high").select("row.*")


def template_capped(rows: DataFrame, key: str, label: str, ordinal: str, cap: int, exclude_conflicts: bool) -> DataFrame:
    """At most `cap` rows of each template, or of each template and label.

    With exclude_conflicts, templates with several labels are dropped and all rows of a
    template share its cap; otherwise each label of a template has its own.
    """
    if cap < 1:
        return rows
    if exclude_conflicts:
        rows = rows.join(label_conflicts(rows, key, label).select(key), key, "left_anti").select(rows.columns)
        return first_rows(rows, [key], [F.col(ordinal)], cap)
    return first_rows(rows, [key, label], [F.col(ordinal)], cap)


def conflict_audit(rows: DataFrame, exact: str, template: str, label: str, ordinal: str) -> DataFrame:
    """(fingerprint_type, fingerprint, labels, resolution) of exact keys, and of templates of what they leave."""
    unique = exact_unique(rows, exact, label, ordinal)
    parts = [(rows, exact, "exact"), (unique, template, "template")]
    out = [label_conflicts(df, k, label).select(F.lit(t).alias("fingerprint_type"), F.col(k).alias("fingerprint"), "labels") for df, k, t in parts]
    return out[0].unionByName(out[1]).withColumn("resolution", F.lit("unknown_excluded"))


def without_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among the blocked ones."""
    return rows.join(blocked.select(key).distinct(), key, "left_anti").select(rows.columns)
