"""The tasks that the four commands work on: classes of texts, and outcomes of uploads.

A task says how records become samples, which of them teach what, how a model is fitted and
opened, what it predicts, and how predictions are scored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions import text as tx
from sievegrid.operators import evidence, metrics, parsing, prepare
from sievegrid.operators.decisions import Thresholds
from sievegrid.operators.model import Classifier, Settings, fit
from sievegrid.plans import datasets, runs
from sievegrid.session import materialize
from sievegrid.sources.records import write_json

MODES = ("semantic", "tdp_v2")


def _all_labelled(predicted: DataFrame) -> None:
    if predicted.isEmpty():
        raise ValueError("evaluation needs samples")
    if not predicted.where("target is null or label_status != 'labeled'").isEmpty():
        raise ValueError("evaluation needs labelled samples")


class TextTask:
    """Classes of texts, with numeric features if the samples have them."""

    task_id = "text_classification"

    def samples(self, records: DataFrame) -> DataFrame:
        rows = parsing.text_samples(records)
        return rows.withColumn("exact", fp.inputs_exact("text", "features")).withColumn("template", fp.text_template("text"))

    def prepared(self, samples: DataFrame) -> DataFrame:
        return prepare.exclusion_reasons(samples)

    def fit(self, ready: DataFrame, spec: runs.Task) -> Classifier:
        width = ready.agg(F.max(F.size("features"))).first()[0] or 0
        return fit(ready, "text", "training_target", "features" if width else None, Settings(backend=spec.backend, seed=spec.seed, **spec.parameters))

    def open(self, spark: SparkSession, path: Path) -> Classifier:
        return Classifier.load(spark, path)

    def predict(self, model: Classifier, samples: DataFrame) -> DataFrame:
        return model.predict(samples, "text", "features" if model.width else None)

    def output(self, predicted: DataFrame) -> DataFrame:
        return predicted.select("sample_id", F.col("predicted").alias("label"), "probabilities")

    def evaluate(self, predicted: DataFrame, mode: str | None = None) -> dict:
        """The classification report of predictions whose samples are all labelled."""
        if mode is not None:
            raise ValueError("texts have no evaluation modes")
        _all_labelled(predicted)
        counted = metrics.confusion(predicted, gold="target", predicted="predicted")
        report = {r["name"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.classification_report(counted).collect()}
        return {"report": report, "confusion": sorted([r["gold"], r["predicted"], r["n"]] for r in counted.collect())}

    def slices(self, predicted: DataFrame, mode: str | None = None) -> DataFrame | None:
        return None


@dataclass
class UploadModel:
    """The probability model of the judge, and the thresholds that its verdicts take."""

    classifier: Classifier
    thresholds: Thresholds

    def save(self, path: str | Path) -> None:
        self.classifier.save(path)
        write_json(asdict(self.thresholds), Path(path) / "thresholds.json")

    @staticmethod
    def load(spark: SparkSession, path: str | Path) -> UploadModel:
        text = (Path(path) / "thresholds.json").read_text(encoding="utf-8")
        return UploadModel(Classifier.load(spark, path), Thresholds(**json.loads(text)))


_EVENT = """request struct<method: string, uri: string, headers: map<string, string>, content_type: string, filename: string, file_ext: string, field_name: string, body_excerpt: string>,
  response struct<status_code: int, headers: map<string, string>, content_type: string, body: string>"""
_BINARY = {tx.CONFIRMED: "success", tx.LIKELY: "success", "success": "success", tx.FAILED: "failed", "failure": "failed"}


class UploadTask:
    """Outcomes of uploads: learned as success or failure, judged as one of four verdicts."""

    task_id = "upload"

    def samples(self, records: DataFrame) -> DataFrame:
        """Samples with the fields of their events, defaults filled in; request and response must be there."""
        x = parsing.upload_samples(records).withColumn("_e", F.from_json("json", _EVENT))
        q, p = (lambda n: tx.text_or_empty(f"_e.request.{n}")), (lambda n: tx.text_or_empty(f"_e.response.{n}"))
        missing = F.col("_e.request").isNull() | F.col("_e.response").isNull()
        return x.select(
            *[c for c in x.columns if c not in ("_e", "problem")], F.coalesce("problem", F.when(missing, "request and response must be objects")).alias("problem"),
            F.coalesce("_e.request.method", F.lit("POST")).alias("method"), *[q(n).alias(n) for n in ("uri", "filename", "file_ext", "field_name")], q("body_excerpt").alias("request_body"),
            F.coalesce("_e.response.status_code", F.lit(0)).alias("status_code"), F.col("_e.response.headers").alias("headers"), p("content_type").alias("content_type"), p("body").alias("body"),
        )

    def prepared(self, samples: DataFrame) -> DataFrame:
        """An unknown outcome is a label, but teaches neither success nor failure."""
        return prepare.exclusion_reasons(samples, _BINARY, (tx.UNKNOWN,))

    def fit(self, ready: DataFrame, spec: runs.Task) -> UploadModel:
        more = set(spec.parameters) - {"thresholds"}
        if more:
            raise ValueError(f"unknown parameters: {sorted(more)}")
        thresholds = Thresholds(**spec.parameters.get("thresholds", {}))
        return UploadModel(datasets.fit_judge_model(ready, "training_target", Settings(backend=spec.backend, seed=spec.seed)), thresholds)

    def open(self, spark: SparkSession, path: Path) -> UploadModel:
        return UploadModel.load(spark, path)

    def predict(self, model: UploadModel, samples: DataFrame) -> DataFrame:
        scored = datasets.success_probability(samples, model.classifier)
        return self.judged(scored, model.thresholds)

    def judged(self, scored: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
        """Verdicts, computed once: scores and slices read them several times, and the evidence makes large plans."""
        out = evidence.judge(evidence.with_rule(evidence.with_features(scored)), thresholds=thresholds)
        return materialize(out.select(*[c for c in out.columns if c not in ("f", "file_ext")], F.col("f.file_ext").alias("file_ext")))

    def output(self, predicted: DataFrame) -> DataFrame:
        return predicted.select(F.col("sample_id").alias("event_id"), "verdict", "confidence", "p_success", "decided_by", "evidence", "negative_evidence")

    def _judged(self, predicted: DataFrame, mode: str | None) -> tuple[DataFrame, bool]:
        """predicted with gold and predicted verdicts; `failure` is an alias that only the binary mode knows."""
        mode = mode or "tdp_v2"
        if mode not in MODES:
            raise ValueError(f"unknown evaluation mode: {mode}")
        binary = mode == "tdp_v2"
        gold = F.when(F.col("target") == "failure", tx.FAILED).otherwise(F.col("target")) if binary else F.col("target")
        return predicted.withColumn("gold", gold).withColumn("predicted", F.col("verdict")), binary

    def evaluate(self, predicted: DataFrame, mode: str | None = None) -> dict:
        """Scores by class and in sum, of predictions whose samples are all labelled."""
        judged, binary = self._judged(predicted, mode)
        _all_labelled(judged)
        counted = metrics.confusion(judged)
        by_class = metrics.compatible_per_class(counted) if binary else metrics.semantic_per_class(counted)
        summary = metrics.all_gates(metrics.compatible_summary(counted) if binary else metrics.semantic_summary(counted))
        return {
            "mode": mode or "tdp_v2", "excluded_unlabeled": 0, "summary": summary.first().asDict(),
            "classes": {r["name"]: {k: r[k] for k in ("precision", "recall", "f1", "support", "predicted")} for r in by_class.collect()},
        }

    def slices(self, predicted: DataFrame, mode: str | None = None) -> DataFrame | None:
        """The summary by status, status family, extension and cluster of equal bodies: a table, as extensions have no bound."""
        judged, binary = self._judged(predicted, mode)
        keys = {
            "status_code": F.col("status_code").cast("string"), "status_family": tx.status_family("status_code"),
            "extension": F.when(F.col("file_ext") == "", "<none>").otherwise(tx.bare_extension("file_ext")), "template_cluster": fp.cluster_key("body"),
        }
        counted = metrics.sliced(judged, keys, top={"template_cluster": 100})
        return (metrics.compatible_summary if binary else metrics.semantic_summary)(counted, ["slice", "key"])


TEXT, UPLOAD = TextTask(), UploadTask()
#: By the names that a configuration may give.
TASKS = {"text": TEXT, TEXT.task_id: TEXT, UPLOAD.task_id: UPLOAD}


def resolve(task_id: str) -> TextTask | UploadTask:
    if task_id not in TASKS:
        raise ValueError(f"unknown task: {task_id}")
    return TASKS[task_id]
