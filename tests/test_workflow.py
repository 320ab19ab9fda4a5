"""The four commands end to end, acceptance, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from sievegrid.plans import acceptance, runs, workflow
from sievegrid.streaming import judging

WORDS = {"food": "soup bread cheese butter", "travel": "train hotel ticket beach"}


def write(path, start, n, **more):
    rows = [{"id": f"s{start + i}", "text": f"{' '.join(WORDS[c].split()[i % 3 :])} {c} number{start + i}", "label": c, **more} for i, c in enumerate(list(WORDS) * n)]
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("flow")
    # texts differ in letters, as a number alone would make the same template
    for name, start, n in (("train", 0, 12), ("dev", 100, 3), ("test", 200, 3)):
        write(d / f"{name}.jsonl", start, n)
        text = (d / f"{name}.jsonl").read_text().replace("number", f"{name} ")
        (d / f"{name}.jsonl").write_text("\n".join(json.dumps(json.loads(x) | {"text": json.loads(x)["text"] + " " + "abcdefghijklmnopqrstuvwxyz"[k % 26] * (1 + k // 26)}) for k, x in enumerate(text.splitlines())))
    sets = {"a": {"path": "train.jsonl", "purpose": "train"}, "b": {"path": "dev.jsonl", "purpose": "development"}, "c": {"path": "missing.jsonl", "purpose": "independent_test"}}
    (d / "c.json").write_text(json.dumps({"task_id": "text", "run_root": "runs", "datasets": sets}))
    return d, workflow.train(spark, runs.Task.load(d / "c.json"))


def test_train_never_opens_the_test(setting):
    d, result = setting
    assert result["status"] == "succeeded" and result["development_metrics"]["b"]["report"]["accuracy"]["support"] == 6
    assert runs.open_artifact(result["artifact"])["task_id"] == "text"


def test_predict(spark, setting):
    d, result = setting
    out = workflow.predict(spark, result["artifact"], str(d / "test.jsonl"), str(d / "runs"))
    rows = spark.read.json(out["predictions"])
    assert rows.count() == 6 and set(rows.columns) == {"sample_id", "label", "probabilities"}


def test_independent_evaluation_and_its_refusal(spark, setting):
    d, result = setting
    fresh = runs.Dataset(str(d / "test.jsonl"), "independent_test", "written for this test", True)
    out = workflow.evaluate(spark, result["artifact"], fresh, str(d / "runs"))
    assert out["independent_test_eligible"]
    with pytest.raises(runs.Ineligible, match="lineage_overlap"):
        workflow.evaluate(spark, result["artifact"], runs.Dataset(str(d / "train.jsonl"), "independent_test", "x", True), str(d / "runs"))
    with pytest.raises(runs.Ineligible, match="training_development_overlap"):
        workflow.evaluate(spark, result["artifact"], runs.Dataset(str(d / "train.jsonl"), "development"), str(d / "runs"))


def test_validation_and_commands(spark, setting, capsys):
    d, _ = setting
    sets = {"a": {"path": "train.jsonl", "purpose": "train"}, "b": {"path": "train.jsonl", "purpose": "development"}}
    (d / "bad.json").write_text(json.dumps({"task_id": "text", "run_root": "runs", "datasets": sets}))
    assert workflow.main(["validate-data", "--config", str(d / "bad.json")], spark) == 1
    (d / "twice.jsonl").write_text('{"id":"1","text":"a"}\n{"id":"1","text":"b"}\n')
    with pytest.raises(ValueError, match="repeated"):
        workflow.load(spark, str(d / "twice.jsonl"))
    (d / "broken.jsonl").write_text('{"id":"1","text":""}\n')
    with pytest.raises(ValueError, match="broken.jsonl:1: text"):
        workflow.load(spark, str(d / "broken.jsonl"))


def test_acceptance_is_used_once(spark, tmp_path):
    labels = ["confirmed_upload_success", "likely_upload_success", "failed", "unknown"]
    gold = spark.range(200).select(F.concat(F.lit("g"), "id").alias("event_id"), F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("id") % 4 + 1).cast("int")).alias("label"))
    gold = gold.withColumn("verdict", F.col("label")).withColumn("confidence", F.lit(0.9))
    other = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("event_id"), F.when(F.col("id") % 2 == 0, "failed").otherwise("confirmed_upload_success").alias("label"))
    other = other.withColumn("verdict", F.col("label")).withColumn("confidence", F.lit(0.9))
    assert acceptance.accept(gold.limit(4), other.limit(2), gold.limit(4), tmp_path, smoke=True)["inputs"]["passed"] is False
    with pytest.raises(ValueError):
        acceptance.accept(gold.limit(4), other, gold.limit(4), tmp_path)
    assert acceptance.accept(gold, other, gold, tmp_path)["status"] == "passed"
    with pytest.raises(RuntimeError):
        acceptance.accept(gold, other, gold, tmp_path)
    changed = gold.withColumn("confidence", F.when(F.col("event_id") == "g7", 0.1).otherwise(F.col("confidence")))
    assert acceptance.parity(gold, changed) == {"mismatches": 1, "first": ["g7"], "passed": False}
    late = changed.withColumn("confidence", F.lit(0.9)).withColumn("verdict", F.when(F.col("event_id") == "g99", "none").otherwise(F.col("verdict")))
    assert not acceptance.parity(gold, late)["passed"] and acceptance.parity(gold, late, first=50)["passed"]
    assert acceptance.accept(gold, other, late, tmp_path, smoke=True)["gates"]["parity"]["no_mismatch"]
    assert "| a | 0.5000 |" in acceptance.to_markdown("T", {"x": [{"n": "a", "v": 0.5}]})


def test_stream(spark, tmp_path):
    body = {"method": "POST", "url": "/api/upload", "reqs_header": "", "reqs_body": 'name="f"; filename="a.pdf"', "resp_header": "Content-Type: application/json", "resp_body": '{"success":false}', "status": "200"}
    record = {"detail": {"data": {"detail": {"alert": {"net": {"http": body}}}}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(json.dumps(record) + "\n\n" + json.dumps({"detail": {}}) + "\n")
    stream = judging.judged_stream(judging.alert_stream(spark, str(tmp_path / "in"), "failed"), F.lit(0.5))
    query = stream.writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("select * from judged").collect()
    assert [(r["verdict"], r["decided_by"]) for r in rows] == [("failed", "rule:strong_failure")]
