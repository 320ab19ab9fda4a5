"""From evidence and a probability to one of four verdicts, as one ordered expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import CONFIRMED, FAILED, LIKELY, SAFE_EXTENSIONS, UNKNOWN, bare_extension


@dataclass(frozen=True)
class Thresholds:
    confirmed: float = 0.85
    likely: float = 0.60
    failed: float = 0.85

    def __post_init__(self):
        if not (0 <= self.likely <= self.confirmed <= 1 and 0 <= self.failed <= 1):
            raise ValueError("need 0 <= likely <= confirmed <= 1 and 0 <= failed <= 1")


def decide(p: Column, t: Thresholds | None = None) -> Column:
    """A struct (verdict, confidence, source) from the probability p and the columns of the evidence:
    has_success, has_failure, strong_failure, nested_false, file_ext, success_text,
    filename_in_response, evidence_grade, filename_context and processed_form.
    """
    t = t or Thresholds()
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p.cast("double")))
    q = 1.0 - p
    on = F.col
    half = F.least(p, F.lit(0.5))

    def out(verdict: str, confidence: Column, source: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), confidence.alias("confidence"), F.lit(source).alias("source"))

    high, grade = p >= t.confirmed, on("evidence_grade")
    return (
        F.when(on("has_failure") & on("strong_failure"), out(FAILED, F.greatest(q, F.lit(0.97)), "evidence_strong_failure"))
        .when(on("has_failure") & on("has_success"), out(UNKNOWN, F.lit(0.5), "evidence_conflict"))
        .when(on("has_failure"), out(FAILED, F.greatest(q, F.lit(0.9)), "evidence_failure"))
        .when(on("nested_false") & on("has_success"), out(UNKNOWN, F.lit(0.5), "nested_evidence_conflict"))
        .when(bare_extension("file_ext").isin(*SAFE_EXTENSIONS) & (p >= t.likely), out(UNKNOWN, half, "safe_ext_downgrade"))
        .when(high & on("success_text") & on("filename_in_response"), out(CONFIRMED, p, "model_confirmed_success_text_filename_echo"))
        .when(high & (grade == "STRONG"), out(CONFIRMED, p, "model_confirmed_strong"))
        .when(high & (grade == "WEAK"), out(LIKELY, p, "model_likely_weak"))
        .when(high & on("has_success") & on("filename_context"), out(LIKELY, p, "model_likely_success_context"))
        .when(high & on("processed_form") & on("filename_context"), out(LIKELY, p, "model_likely_processed_form_ack"))
        .when(high, out(UNKNOWN, half, "model_no_evidence"))
        .when((p >= t.likely) & grade.isin("STRONG", "WEAK"), out(LIKELY, p, "model_likely_evidence"))
        .when(q >= t.failed, out(UNKNOWN, q, "model_failed_without_evidence"))
        .otherwise(out(UNKNOWN, F.greatest(p, q), "model_unknown"))
    )


def judged(events: DataFrame, p: str = "p_success", thresholds: Thresholds | None = None) -> DataFrame:
    """events with verdict, confidence (4 places), p_success (6 places) and source."""
    x = events.withColumn("_d", decide(F.col(p), thresholds))
    return x.select(
        *[c for c in events.columns if c != p], F.bround(F.col(p), 6).alias(p),
        F.col("_d.verdict").alias("verdict"), F.bround("_d.confidence", 4).alias("confidence"), F.col("_d.source").alias("source"),
    )


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two runs, or that only one has."""
    columns = left.columns
    differ = left.exceptAll(right.select(columns)).select(key).union(right.select(columns).exceptAll(left).select(key))
    return differ.distinct()
