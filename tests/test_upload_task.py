"""The upload task through the four commands, and the task registry."""

import json

import pytest

from sievegrid.plans import runs, tasks, workflow

BODIES = {
    "confirmed_upload_success": '{"success":true,"url":"/files/%s/report.txt"}',
    "failed": '{"success":false,"message":"quota %s reached"}',
    "unknown": "<p>queue %s</p>",
}


def write(path, first, n, labels=tuple(BODIES)):
    rows = []
    for k in range(n):
        for label in labels:
            name = "abcdefghijklmnopqrstuvwxyz"[k % 26] * (1 + k // 26) + path.stem
            rows.append(
                {
                    "event_id": f"{path.stem}-{first}-{label}-{k}", "label": label,
                    "request": {"method": "POST", "uri": "/api/upload", "filename": f"{name}.txt", "file_ext": "txt", "body_excerpt": name},
                    "response": {"status_code": 200, "content_type": "application/json", "body": BODIES[label] % name},
                }
            )
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    write(d / "train.jsonl", 0, 12)
    write(d / "dev.jsonl", 0, 3)
    write(d / "fresh.jsonl", 0, 4)
    sets = {"a": {"path": "train.jsonl", "purpose": "train"}, "b": {"path": "dev.jsonl", "purpose": "development"}}
    config = {"task_id": "upload", "run_root": "runs", "datasets": sets, "parameters": {"thresholds": {"confirmed": 0.8}}, "evaluation_mode": "semantic"}
    (d / "c.json").write_text(json.dumps(config))
    return d, workflow.train(spark, runs.Task.load(d / "c.json"))


def test_training_leaves_unknown_outcomes_out(trained):
    d, result = trained
    summary = json.loads((d / "runs").joinpath(result["artifact"], "data_summary.json").read_text())
    assert summary == {"reason": {"target:unknown": 12}, "class": {"success": 12, "failed": 12}}
    classes = result["development_metrics"]["b"]["classes"]
    assert classes["failed"]["recall"] == 1.0 and classes["confirmed_upload_success"]["support"] == 3


def test_thresholds_are_kept(spark, trained):
    _, result = trained
    model = tasks.UPLOAD.open(spark, runs.Path(result["artifact"]) / "model")
    assert model.thresholds.confirmed == 0.8 and model.classifier.classes == [0, 1]


def test_predictions_and_independent_evaluation(spark, trained):
    d, result = trained
    out = workflow.predict(spark, result["artifact"], str(d / "fresh.jsonl"), str(d / "runs"))
    rows = spark.read.json(out["predictions"]).collect()
    assert len(rows) == 12 and {r["verdict"] for r in rows if "failed" in r["event_id"]} == {"failed"}
    fresh = runs.Dataset(str(d / "fresh.jsonl"), "independent_test", "written for this test", True)
    scored = workflow.evaluate(spark, result["artifact"], fresh, str(d / "runs"))
    assert scored["independent_test_eligible"] and scored["metrics"]["mode"] == "semantic" and scored["metrics"]["summary"]["failed_to_success"] == 0
    binary = workflow.evaluate(spark, result["artifact"], fresh, str(d / "runs"), "tdp_v2")
    assert binary["metrics"]["mode"] == "tdp_v2" and "gate_false_success" in binary["metrics"]["summary"]
    slices = spark.read.json(binary["slices"]).collect()
    assert {(r["slice"], r["key"]): r["total"] for r in slices}[("status_family", "2xx")] == 12


def test_what_is_refused(spark, trained, tmp_path):
    _, result = trained
    with pytest.raises(ValueError, match="unknown task"):
        tasks.resolve("image")
    with pytest.raises(ValueError, match="unknown parameters"):
        tasks.UPLOAD.fit(None, runs.Task("upload", "x", parameters={"iterations": 3}))
    write(tmp_path / "open.jsonl", 0, 1, ("failed",))
    text = (tmp_path / "open.jsonl").read_text()
    (tmp_path / "open.jsonl").write_text(text.replace('"label": "failed"', '"label": null'))
    model = tasks.UPLOAD.open(spark, runs.Path(result["artifact"]) / "model")
    predicted = tasks.UPLOAD.predict(model, workflow.load(spark, str(tmp_path / "open.jsonl"), tasks.UPLOAD))
    with pytest.raises(ValueError, match="labelled"):
        tasks.UPLOAD.evaluate(predicted)
    with pytest.raises(ValueError, match="mode"):
        tasks.UPLOAD.evaluate(predicted, "loose")
