"""Parsing, reviewing, runs, artifacts and evaluation history."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import parsing, reviewing
from sievegrid.plans import runs
from sievegrid.sources.records import write_json


def parsed(spark, function, *records):
    frame = spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(records)], "json string, n int")
    return [r for r in function(frame).orderBy("n").collect()]


def test_text_samples(spark):
    rows = parsed(
        spark, parsing.text_samples,
        {"id": "1", "text": "x", "label": "a"}, {"sample_id": "2", "id": "9", "inputs": {"text": "y", "features": [1, 2.5]}, "target": None, "label": "a"},
        {"id": 3, "text": "x"}, {"id": "4", "text": " "}, {"id": "5", "text": "x", "label": 7}, {"id": "6", "inputs": {"text": "x", "z": 1}},
        {"id": "7", "text": "x", "label_status": "odd"}, {"id": "8", "text": "x", "group_id": " "}, {"id": "9", "text": "x", "label": "a", "label_status": "conflict", "source": "s", "group_id": "g"},
    )
    assert [(r["sample_id"], r["target"], r["label_status"]) for r in rows[:2]] == [("1", "a", "labeled"), ("2", None, "unlabeled")]
    assert rows[1]["features"] == [1.0, 2.5] and rows[1]["text"] == "y" and rows[0]["problem"] is None and rows[1]["problem"] is None
    assert all(r["problem"] for r in rows[2:8])
    assert (rows[8]["problem"], rows[8]["source"], rows[8]["group_id"], rows[8]["label_status"]) == (None, "s", "g", "conflict")


def test_upload_samples(spark):
    event = {"event_id": "e", "request": {"method": "post", "uri": "http://h/a"}, "response": {"status_code": 200, "body": "b"}}
    rows = parsed(
        spark, parsing.upload_samples,
        event | {"label": None, "gold_verdict": "failed", "v3_source": "", "source": "s"}, event | {"label": 5}, event | {"metadata": {"group": "g"}}, event | {"group_id": None, "metadata": {"group": "g"}}, {"event_id": 4},
    )
    assert (rows[0]["target"], rows[0]["source"], rows[0]["label_status"], rows[0]["problem"]) == ("failed", "s", "labeled", None)
    assert rows[1]["problem"] and rows[4]["problem"]
    assert (rows[2]["group_id"], rows[3]["group_id"], rows[2]["label_status"]) == ("g", None, "unlabeled")
    import hashlib

    assert rows[0]["exact"] == hashlib.sha256(b"POST|/a|200||b").hexdigest()


def test_legacy_labels(spark):
    frame = spark.createDataFrame([('{"label":null,"gold_verdict":"x"}',), ('{"gold_verdict":"x"}',), ('{"label":"y"}',)], "json string")
    assert [r[0] for r in frame.select(parsing.legacy_label()).collect()] == ["None", "x", "y"]


def test_reviewing(spark):
    rows = spark.createDataFrame([("/u", '{"success":false,"message":"上传失败"}'), ("/FalseAlarmDetection", "上传失败"), ("/u", "fine")], "u string, b string")
    assert [r[0] for r in rows.select(reviewing.failure_score("u", "b")).collect()] == [9, 0, 0]
    kinds = "type string, value string"
    events = spark.createDataFrame(
        [("confirmed_upload_success", [("success_field", "x")], []), ("failed", [], [("failure_field", "x")]), ("unknown", [("success_field", "x"), ("returned_path", "/p")], [])],
        f"gold_verdict string, evidence array<struct<{kinds.replace(' ', ':')}>>, negative_evidence array<struct<{kinds.replace(' ', ':')}>>".replace(",:", ","),
    )
    assert [r[0] for r in events.select(reviewing.mismatch()).collect()] == [True, False, True]
    assert reviewing.repaired_ids(["event-0001", "event-0002"], ["event-0001", "event-00o2"]) == {"event-00o2": "event-0002"}
    assert reviewing.repaired_ids(["aaaaaaaa1", "aaaaaaaa2"], ["aaaaaaaa3", "zzz"]) == {}
    labels = spark.createDataFrame([("1", "a", "l")], "id string, v string, label string")
    notes = spark.createDataFrame([("1", "gold")], "id string, gold_verdict string")
    assert reviewing.annotated(labels, notes, "id").first().asDict() == {"id": "1", "v": "a", "source_label": "l", "gold_verdict": "gold", "review_status": "unreviewed"}
    assert reviewing.pending(labels, notes, "id").count() == 0


def test_config_paths_and_purposes(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"task_id": "t", "run_root": "runs", "datasets": {"a": {"path": "a.jsonl", "purpose": "train"}, "z": {"path": "z.jsonl", "purpose": "independent_test"}}}))
    task = runs.Task.load(tmp_path / "c.json")
    assert task.datasets["a"].path == str(tmp_path / "a.jsonl") and list(task.for_training()) == ["a"]
    with pytest.raises(ValueError):
        runs.Dataset("x", "other")


def trained(root):
    def work(folder):
        (folder / "model").mkdir()
        (folder / "model" / "part").write_text("weights")
        write_json({}, folder / "lineage.json")
        runs.seal(folder, "t", "logistic")
        return {}

    return runs.run(root, "train", {"a": 1}, work)["run_dir"]


def test_artifacts_are_checked(tmp_path):
    folder = runs.Path(trained(tmp_path))
    assert runs.open_artifact(folder)["task_id"] == "t"
    (folder / "model" / "extra").write_text("x")
    with pytest.raises(ValueError, match="cover"):
        runs.open_artifact(folder)
    (folder / "model" / "extra").unlink()
    (folder / "model" / "part").write_text("other")
    with pytest.raises(ValueError, match="not as it was"):
        runs.open_artifact(folder)


def test_failed_runs_are_recorded(tmp_path):
    with pytest.raises(RuntimeError):
        runs.run(tmp_path, "train", {}, lambda folder: (_ for _ in ()).throw(RuntimeError("broken")))
    state = json.loads(next(tmp_path.glob("*/run.json")).read_text())
    assert state["status"] == "failed" and state["details"]["error"] == "broken"
    with pytest.raises(ValueError):
        runs.guarded(tmp_path / "x" / "y", (tmp_path / "x",))


def test_evaluation_is_reserved_before_use(tmp_path):
    folder = trained(tmp_path)
    fine = lambda earlier: {"eligible": True, "violations": [], "earlier": len(earlier)}
    with pytest.raises(RuntimeError), runs.evaluation(folder, "r1", fine, {"purpose": "development"}):
        raise RuntimeError("scoring broke")
    with runs.evaluation(folder, "r2", fine, {"purpose": "independent_test"}) as report:
        assert report["earlier"] == 1
        with pytest.raises(TimeoutError), runs.evaluation(folder, "r3", fine, {"purpose": "development"}, timeout=0.1):
            pass
    with pytest.raises(runs.Ineligible), runs.evaluation(folder, "r4", lambda e: {"eligible": False, "violations": ["lineage_overlap"]}, {"purpose": "development"}):
        pass
    with runs.evaluation(folder, "r5", fine, {"purpose": "development"}) as report:
        assert report["earlier"] == 1
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(_use(folder, f"t{k}", fine))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [2, 3, 4, 5]


def _use(folder, run_id, check):
    with runs.evaluation(folder, run_id, check, {"purpose": "development"}) as report:
        return report["earlier"]


def test_use_is_checked_against_lineage(spark):
    keys = spark.createDataFrame([("a", "id", "1"), ("a", "exact", "2")], "dataset string, kind string, key_hash string")
    entries = {"a": {"purpose": "train", "count": 1, "coverage": {"exact": 1, "template": 1}}}
    test = runs.Dataset("p", "independent_test", "made by hand", True)
    met = runs.check_use(keys.select("kind", "key_hash"), 1, {"exact": 1, "template": 1}, test, keys, entries)
    assert met["violations"] == ["lineage_overlap"] and met["overlaps"]["id"] == 1
    fresh = keys.select("kind", F.concat("key_hash", F.lit("x")).alias("key_hash"))
    assert runs.check_use(fresh, 1, {"exact": 1, "template": 1}, test, keys, entries)["independent_test_eligible"]
    assert "incomplete_evaluation_fingerprint_coverage" in runs.check_use(fresh, 1, {"exact": 0}, test, keys, entries)["violations"]
    assert runs.check_use(keys, 1, {}, runs.Dataset("p", "development"), keys, entries)["violations"] == ["training_development_overlap"]
