"""Conversion and judgement over streams: both are stateless, so the batch expressions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import http
from sievegrid.operators import evidence


def alert_stream(spark: SparkSession, path: str, label: str, files_per_trigger: int = 100) -> DataFrame:
    """Upload events of alert files as they arrive in a folder, one JSON record a line.

    Lines of a stream have no number: an alert without an id gets a hash of itself for one.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where("trim(value) != ''")
    return http.alerts(lines.select(F.col("value").alias("json"), F.substring(F.sha2("value", 256), 1, 16).alias("line")), label)


def judged_stream(events: DataFrame, probability) -> DataFrame:
    """Verdicts of a stream of upload events; `probability` is a column over their features."""
    featured = evidence.with_features(http.flat(events))
    ruled = evidence.with_rule(featured.withColumn("p_success", probability))
    return evidence.judge(ruled).select("event_id", "verdict", "confidence", "p_success", "decided_by")
