"""JSON records as samples: which key counts, what is missing and what is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions.text import text_or_empty
from sievegrid.operators.prepare import STATUSES

_TEXT_INPUTS = ("text", "features")


class _Record:
    """Access to one column of JSON objects."""

    def __init__(self, json: str):
        self.json, self.value = F.col(json), F.try_parse_json(json)
        self.keys = F.json_object_keys(json)

    def has(self, key: str) -> Column:
        return F.coalesce(F.array_contains(self.keys, key), F.lit(False))

    def text(self, key: str) -> Column:
        """The value as text; null if it is missing or null."""
        return F.get_json_object(self.json, f"$.{key}")

    def kind(self, key: str) -> Column:
        """STRING, BIGINT, ...; null if it is missing, VOID if it is null."""
        return F.schema_of_variant(F.try_variant_get(self.value, f"$.{key}", "variant"))

    def is_string(self, key: str) -> Column:
        return F.coalesce(self.kind(key) == "STRING", F.lit(False))


def _problem(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def _common(status: Column, sample_id: Column, group: Column) -> list[tuple[Column, str]]:
    return [
        (F.coalesce(F.trim(sample_id), F.lit("")) == "", "sample_id must be a non-blank string"),
        (~status.isin(*STATUSES), "unknown label_status"),
        (group.isNotNull() & (F.trim(group) == ""), "group_id must be non-blank or null"),
    ]


def text_samples(records: DataFrame, json: str = "json") -> DataFrame:
    """records with the sample's columns and `problem`, null where the record is valid.

    `inputs` is used if the key is there, else the record itself; `target` if the key is
    there, even as null, else `label`; `sample_id` likewise before `id`. A sample without a
    status is labeled exactly if it has a target.
    """
    r = _Record(json)
    nested = r.has("inputs")
    text = F.when(nested, r.text("inputs.text")).otherwise(r.text("text"))
    features = F.from_json(F.coalesce(F.when(nested, r.text("inputs.features")).otherwise(r.text("features")), F.lit("[]")), "array<double>")
    target = F.when(r.has("target"), r.text("target")).otherwise(r.text("label"))
    target_text = F.when(r.has("target"), r.is_string("target")).otherwise(r.is_string("label"))
    sample_id = F.when(r.has("sample_id"), F.when(r.is_string("sample_id"), r.text("sample_id"))).otherwise(F.when(r.is_string("id"), r.text("id")))
    status = F.when(r.has("label_status"), r.text("label_status")).otherwise(F.when(target.isNotNull(), "labeled").otherwise("unlabeled"))
    group = r.text("group_id")
    extra = F.size(F.array_except(F.json_object_keys(F.coalesce(r.text("inputs"), F.lit("{}"))), F.array(*[F.lit(k) for k in _TEXT_INPUTS]))) > 0
    finite = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = _problem(
        (F.coalesce(F.trim(text), F.lit("")) == "", "text must be a non-blank string"),
        (nested & F.coalesce(extra, F.lit(False)), "inputs has unknown keys"),
        (features.isNull() | ~finite, "features must be finite numbers"),
        (target.isNotNull() & (~target_text | (F.trim(target) == "")), "class labels must be non-blank strings"),
        *_common(F.coalesce(status, F.lit("")), sample_id, group),
    )
    return records.select(
        "*", sample_id.alias("sample_id"), text.alias("text"), features.alias("features"), target.alias("target"), F.coalesce(r.text("source"), F.lit("")).alias("source"),
        group.alias("group_id"), status.alias("label_status"), F.coalesce(r.text("metadata"), F.lit("{}")).alias("metadata"), problem.alias("problem"),
    )


def upload_samples(records: DataFrame, json: str = "json") -> DataFrame:
    """records with the sample's columns and `problem`, of upload events.

    The target is `label`, or `gold_verdict` where that is missing or null. The source is the
    first of v4_source, v3_source and source that is not empty. Fingerprints come from the
    record as it is, before defaults.
    """
    r = _Record(json)
    target = F.coalesce(r.text("label"), r.text("gold_verdict"))
    is_text = F.when(r.text("label").isNotNull(), r.is_string("label")).otherwise(r.is_string("gold_verdict"))
    group = F.when(r.has("group_id"), r.text("group_id")).otherwise(F.coalesce(r.text("metadata.group_id"), r.text("metadata.group")))
    status = F.when(r.has("label_status"), r.text("label_status")).otherwise(F.when(target.isNull(), "unlabeled").otherwise("labeled"))
    source = F.coalesce(*[F.nullif(r.text(k), F.lit("")) for k in ("v4_source", "v3_source", "source")], F.lit(""))
    event_id = F.when(r.is_string("event_id"), r.text("event_id"))
    head = (r.text("request.method"), r.text("request.uri"), F.coalesce(r.text("response.status_code"), F.lit("0")), r.text("response.content_type"), r.text("response.body"))
    problem = _problem((target.isNotNull() & ~is_text, "label must be a string or null"), *_common(F.coalesce(status, F.lit("")), event_id, group))
    return records.select(
        "*", event_id.alias("sample_id"), target.alias("target"), source.alias("source"), group.alias("group_id"), status.alias("label_status"),
        fp.upload_exact(*head).alias("exact"), fp.upload_template(*head).alias("template"), problem.alias("problem"),
    )


def legacy_label(json: str = "json") -> Column:
    """The label of a lenient file: `label` if the key is there, else gold_verdict; a null label reads 'None'."""
    r = _Record(json)
    return F.when(r.has("label"), F.coalesce(r.text("label"), F.lit("None"))).otherwise(text_or_empty(r.text("gold_verdict")))
