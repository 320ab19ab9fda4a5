"""Building training, validation and final windows of upload events, isolated from each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions import http
from sievegrid.functions import text as tx
from sievegrid.operators import dedup, evidence, leakage, model, splitting
from sievegrid.session import materialize

SEED = 42
VALIDATION, FINAL_CAP, LEAST_FINAL = 0.10, 50, 3300


@dataclass
class Build:
    """Partitions of events with their fingerprints, the conflicts left out, and counts."""

    partitions: dict[str, DataFrame]
    conflicts: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    def leakage(self) -> DataFrame:
        """(left, right, kind, shared) of exact and template keys between the partitions."""
        rows = [p.select(F.lit(k).alias("dataset"), F.col("event_id").alias("sample_id"), "exact", "template", F.lit(None).cast("string").alias("group_id")) for k, p in self.partitions.items()]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        return leakage.pair_overlaps(leakage.key_table(every), list(self.partitions)).where("kind in ('exact', 'template')")

    def profile(self) -> DataFrame:
        """(partition, measure, value, rows) by label, response format, status family and extension group."""
        out = None
        for name, p in self.partitions.items():
            r = F.col("response")
            measures = {
                "label": F.col("label"), "format": tx.response_format(r["body"], r["content_type"]), "family": tx.status_family(r["status_code"]),
                "extension": tx.profile_extension_group(F.col("request")["file_ext"]),
            }
            long = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()])).alias("x"))
            part = long.groupBy("x.measure", "x.value").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("partition"), "measure", "value", "rows")
            out = part if out is None else out.unionByName(part)
        return out


def fingerprinted(events: DataFrame) -> DataFrame:
    """Standard events with exact and template fingerprints; they must have a column ordinal."""
    q, p = F.col("request"), F.col("response")
    head = (q["method"], q["uri"], p["status_code"], p["content_type"], p["body"])
    return http.standardised(events).withColumn("exact", fp.upload_exact(*head)).withColumn("template", fp.upload_template(*head))


def _deduped(rows: DataFrame, cap: int, exclude: bool) -> tuple[DataFrame, DataFrame]:
    """rows without exact copies and templates beyond the cap, and the conflicts found."""
    unique = materialize(dedup.exact_unique(rows, "exact", "label", "ordinal"))
    conflicts = dedup.conflict_audit(rows, "exact", "template", "label", "ordinal")
    return materialize(dedup.template_capped(unique, "template", "label", "ordinal", cap, exclude)), conflicts


def build(training: DataFrame, final: DataFrame, seed: int = SEED) -> Build:
    """train, val and final_test of events (event_id, label, request, response, ordinal).

    One row of a template in training, up to FINAL_CAP per label in the final window, whose
    exact copies of training rows go. Any exact overlap that is left is an error.
    """
    pool, conflicts = _deduped(materialize(fingerprinted(training)), 1, True)
    parted = materialize(splitting.stratified_split(pool, "label", "event_id", VALIDATION, seed))
    clean = dedup.without_blocked(fingerprinted(final), pool, "exact")
    last, more = _deduped(materialize(clean), FINAL_CAP, False)
    out = Build(
        {"train": parted.where("part = 'train'").drop("part"), "val": parted.where("part = 'val'").drop("part"), "final_test": last}, conflicts.unionByName(more)
    )
    out.counts = {k: p.count() for k, p in out.partitions.items()}
    met = out.leakage().where("kind = 'exact' and shared > 0").first()
    if met is not None:
        raise RuntimeError(f"exact copies in {met['left']} and {met['right']}")
    return out


def final_window(incoming: DataFrame, history: DataFrame, least: int = LEAST_FINAL) -> DataFrame:
    """New events whose exact and template fingerprints are not in history (exact, template), one of a template."""
    rows = fingerprinted(incoming)
    fair = F.col("label").isin(tx.CONFIRMED, tx.FAILED)
    rows = rows.where(F.when(fair, F.lit(True)).otherwise(F.raise_error(F.lit("a label is neither confirmed nor failed"))))
    for key in ("exact", "template"):
        rows = dedup.without_blocked(rows, history, key)
    out, _ = _deduped(materialize(rows), 1, True)
    n = out.count()
    if n < least:
        raise RuntimeError(f"only {n} rows are left")
    return out


def after_gold(final: DataFrame, gold: DataFrame, least: int = 3000, key: str = "event_id") -> DataFrame:
    """final without the gold rows, all of which must have been in it, and enough left."""
    out = final.join(gold.select(key).distinct(), key, "left_anti").select(final.columns)
    left, taken = out.count(), final.count()
    if taken - left != gold.select(key).distinct().count():
        raise RuntimeError("gold rows are not all from the final window")
    if left < least:
        raise RuntimeError(f"only {left} rows are left")
    return out


def binary_target(label) -> Column:
    """1 for a success, 0 for a failure, null for what no model learns from."""
    x = F.lower(tx._c(label))
    return F.when(x.isin("success", tx.LIKELY, tx.CONFIRMED), 1).when(x.isin("failed", "failure"), 0)


def core_rows(events: DataFrame, source: str) -> DataFrame:
    """What training keeps of an event; a label that is no verdict is an error."""
    legal = F.col("label").isin(*tx.VERDICTS)
    fail = F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce("label", F.lit("null"))))
    kept = events.select("event_id", "request", "response", "label", F.lit(source).alias("v4_source"))
    return kept.where(F.when(legal, F.lit(True)).otherwise(fail))


def training_counts(rows: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """(measure, value, rows) by label, by source and by binary target."""
    measures = {"label": F.col(label), "source": F.col(source), "binary": F.coalesce(binary_target(label).cast("string"), F.lit("excluded"))}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()])).alias("x"))
    return long.groupBy("x.measure", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def fit_judge_model(events: DataFrame, label: str = "label", settings: model.Settings | None = None) -> model.Classifier:
    """The probability model of the judge, from flat events with labels: their text and 24 numbers."""
    return model.fit(represented(events).withColumn("target", binary_target(label)).where("target is not null"), "model_text", "target", "numbers", settings)


def represented(events: DataFrame) -> DataFrame:
    f = evidence.with_features(events)
    return materialize(f.select(*events.columns, evidence.model_text().alias("model_text"), evidence.numeric_features().alias("numbers")))


def success_probability(events: DataFrame, fitted: model.Classifier) -> DataFrame:
    """events with p_success, the probability of class 1."""
    out = fitted.predict(represented(events), "model_text", "numbers")
    return out.withColumn("p_success", F.element_at("probabilities", fitted.classes.index(1) + 1)).select(*events.columns, "p_success")
