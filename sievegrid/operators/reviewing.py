"""Sampling strata, candidates and mismatches for reviewing gold labels."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import CONFIRMED, FAILED, LIKELY, SCRIPT_EXTENSIONS, UNKNOWN, text_or_empty

# What a candidate for a failure says, and what each adds to its score.
CANDIDATE = (
    (5, r"上传失败|保存失败|解析文件失败|invalid file|file too large|forbidden|unauthorized"),
    (3, r'["\']success["\']\s*:\s*false'),
    (2, r'["\'](?:code|status)["\']\s*:\s*["\']?(?:401|403|404|500)\b'),
    (1, r"失败|不支持|拒绝|未登录|异常|无法|error|not found"),
)
NEVER = ("FalseAlarmDetection", "/3dpModelMall/")
RESOURCES = ("returned_path", "returned_file_id", "returned_filename", "created_location", "filename_echo")
ALIKE = 0.85


def failure_score(uri, body) -> Column:
    """How likely a response is a failure, from 0 to 11."""
    score = sum((F.when(text_or_empty(body).rlike("(?idU)" + p), n).otherwise(0) for n, p in CANDIDATE), F.lit(0))
    return F.when(F.contains(text_or_empty(uri), F.lit(NEVER[0])) | F.contains(text_or_empty(uri), F.lit(NEVER[1])), 0).otherwise(score)


def _some(evidence: str, kinds: tuple[str, ...]) -> Column:
    return F.exists(evidence, lambda e: e["type"].isin(*kinds))


def baseline() -> Column:
    """Of a ruled event with source_label: the rule's verdict, or what the evidence alone suggests."""
    success, stored = _some("evidence", ("success_field",)), _some("evidence", RESOURCES)
    guess = F.when(success & stored, CONFIRMED).when(success, LIKELY).when(F.col("source_label") == FAILED, FAILED).otherwise(UNKNOWN)
    return F.coalesce("rule.verdict", guess)


def stratum() -> Column:
    """baseline|source label|format|status family|extension group of a ruled event."""
    form = F.when(F.col("f.body_empty"), "empty").when(F.col("f.is_json"), "json").when(F.col("f.is_html"), "html").otherwise("text")
    family = F.concat(F.floor(F.col("f.status_code") / 100).cast("string"), F.lit("xx"))
    group = F.when(F.col("f.file_ext").isin(*SCRIPT_EXTENSIONS), "script").otherwise("other")
    return F.concat_ws("|", baseline(), text_or_empty("source_label"), form, family, group)


def mismatch(gold: str = "gold_verdict") -> Column:
    """Whether a gold verdict contradicts the evidence."""
    success, stored = _some("evidence", ("success_field",)), _some("evidence", RESOURCES)
    failed = _some("negative_evidence", ("failure_field",))
    v = F.col(gold)
    return (
        ((v == CONFIRMED) & ~(success & stored)) | ((v == LIKELY) & (failed | ~success)) | ((v == FAILED) & ~failed) | ((v == UNKNOWN) & success & stored & ~failed)
    )


def annotated(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """rows, their label kept as source_label, with the annotations' columns, not yet reviewed."""
    kept = rows.withColumnRenamed("label", "source_label")
    own = [c for c in kept.columns if c == key or c not in annotations.columns]
    return kept.select(own).join(annotations, key).withColumn("review_status", F.lit("unreviewed"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to annotate."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def repaired_ids(expected: Iterable[str], returned: Iterable[str]) -> dict[str, str]:
    """Wrong ids of one batch with the id each must mean; empty unless every one is beyond doubt.

    A wrong id means the missing id most alike, if that is alike enough and no other is as much.
    """
    missing, wrong = sorted(set(expected) - set(returned)), sorted(set(returned) - set(expected))
    if len(missing) != len(wrong):
        return {}
    out = {}
    for w in wrong:
        alike = sorted(((difflib.SequenceMatcher(None, w, m).ratio(), m) for m in missing), reverse=True)
        if alike[0][0] < ALIKE or (len(alike) > 1 and alike[0][0] == alike[1][0]):
            return {}
        out[w] = alike[0][1]
        missing.remove(alike[0][1])
    return out
