"""Validate, train, predict and evaluate: the four commands over the samples of any task."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import leakage, prepare
from sievegrid.plans import runs, tasks
from sievegrid.sources import records

FIRST_PROBLEMS = 20
#: Hashed keys are as many as the samples: a table beside the records, never on the driver.
KEYS = "lineage_keys"


def load(spark: SparkSession, path: str, kind=tasks.TEXT) -> DataFrame:
    """The samples of a JSON or JSONL file with their fingerprints; the first problems of an invalid one are an error."""
    read = records.read_jsonl if Path(path).suffix.lower() in (".jsonl", ".ndjson") else records.read_json
    rows = kind.samples(records.require_valid(read(spark, path)))
    bad = rows.where("problem is not null").select("path", "line", "problem").orderBy("path", "line").limit(FIRST_PROBLEMS).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']}:{r['line']}: {r['problem']}" for r in bad))
    twice = prepare.repeated_ids(rows).orderBy("sample_id").limit(FIRST_PROBLEMS).collect()
    if twice:
        raise ValueError("repeated sample_id: " + ", ".join(r["sample_id"] for r in twice))
    return rows


def hashes(spark: SparkSession, datasets: dict[str, runs.Dataset]) -> dict[str, str]:
    return {k: records.snapshot(spark, d.path).select("sha256").first()["sha256"] for k, d in datasets.items()}


def isolation(samples: dict[str, DataFrame], specs: dict[str, runs.Dataset]) -> tuple[dict, DataFrame]:
    """What the datasets share, against what their purposes allow; and all their keys."""
    every = reduce(DataFrame.unionByName, [s.select("sample_id", "exact", "template", "group_id").withColumn("dataset", F.lit(k)) for k, s in samples.items()])
    keys = leakage.key_table(every)
    coverage: dict[str, dict[str, int]] = {k: {} for k in samples}
    for r in leakage.key_coverage(keys).collect():
        coverage[r["dataset"]][r["kind"]] = r["covered"]
    known = {k: asdict(d) | {"count": samples[k].count()} for k, d in specs.items()}
    overlaps = [r.asDict() for r in leakage.pair_overlaps(keys, list(samples)).collect()]
    report = leakage.split_violations(overlaps, known, coverage)
    return report | {"overlaps": overlaps, "datasets": {k: {"purpose": v["purpose"], "count": v["count"], "coverage": coverage[k]} for k, v in known.items()}}, keys


def counts(samples: DataFrame, kind=tasks.TEXT) -> dict:
    rows = prepare.preparation_counts(kind.prepared(samples)).collect()
    return {m: {r["value"]: r["rows"] for r in rows if r["measure"] == m} for m in ("reason", "class")}


def validate(spark: SparkSession, task: runs.Task) -> dict:
    if not task.datasets:
        raise ValueError("no datasets configured")
    kind = tasks.resolve(task.task_id)

    def work(folder: Path) -> dict:
        samples = {k: load(spark, d.path, kind) for k, d in task.datasets.items()}
        summary = {k: counts(s, kind) for k, s in samples.items()}
        report, _ = isolation(samples, task.datasets)
        for name, value in (("data_summary", summary), ("split_report", report), ("input_hashes", hashes(spark, task.datasets))):
            records.write_json(value, folder / f"{name}.json")
        leakage.require(report)
        return {"datasets": len(samples), "data_summary": summary}

    return runs.run(task.run_root, "validate-data", asdict(task), work, _protected(task))


def _protected(task: runs.Task, *more: str) -> tuple:
    return (*task.protected_paths, *(d.path for d in task.datasets.values()), *([task.artifact_path] if task.artifact_path else []), *more)


def train(spark: SparkSession, task: runs.Task) -> dict:
    """Train on the training set and report on development sets; test sets are not opened."""
    used = task.for_training()
    kind = tasks.resolve(task.task_id)

    def work(folder: Path) -> dict:
        samples = {k: load(spark, d.path, kind) for k, d in used.items()}
        report, keys = isolation(samples, used)
        records.write_json(report, folder / "split_report.json")
        records.write_json(hashes(spark, used), folder / "input_hashes.json")
        leakage.require(report, for_training=True)
        name = next(k for k, d in used.items() if d.purpose == "train")
        records.write_json(counts(samples[name], kind), folder / "data_summary.json")
        model = kind.fit(kind.prepared(samples[name]).where("reason is null"), task)
        model.save(folder / "model")
        leakage.lineage(keys).write.parquet(str(folder / KEYS))
        records.write_json({"version": 1, "entries": report["datasets"], "keys": KEYS}, folder / "lineage.json")
        tested = {k: kind.evaluate(kind.predict(model, s), task.evaluation_mode) for k, s in samples.items() if used[k].purpose == "development"}
        records.write_json(tested, folder / "development_metrics.json")
        runs.seal(folder, task.task_id, task.backend)
        return {"artifact": str(folder), "development_metrics": tested}

    return runs.run(task.run_root, "train", asdict(task), work, _protected(task))


def _opened(spark: SparkSession, artifact: str) -> tuple:
    """The task of an artifact, its model, its lineage, and the configuration that it was trained with."""
    manifest = runs.open_artifact(artifact)
    kind = tasks.resolve(manifest["task_id"])
    lineage, config = (json.loads((Path(artifact) / manifest[k]).read_text(encoding="utf-8")) for k in ("lineage_path", "config_path"))
    return kind, kind.open(spark, Path(artifact) / manifest["model_path"]), lineage, config


def predict(spark: SparkSession, artifact: str, path: str, run_root: str) -> dict:
    def work(folder: Path) -> dict:
        kind, model, _, _ = _opened(spark, artifact)
        out = kind.predict(model, load(spark, path, kind))
        records.write_jsonl(kind.output(out), str(folder / "predictions"))
        return {"predictions": str(folder / "predictions")}

    return runs.run(run_root, "predict", {"artifact": artifact, "input": path}, work, (artifact, path))


def evaluate(spark: SparkSession, artifact: str, dataset: runs.Dataset, run_root: str, mode: str | None = None) -> dict:
    """Check the data against all that the artifact has seen, put its use on record, then score it; the mode is the configured one unless given."""
    if dataset.purpose == "train":
        raise ValueError("training data is not for evaluation")

    def work(folder: Path) -> dict:
        kind, model, lineage, config = _opened(spark, artifact)
        chosen = mode or config.get("evaluation_mode")
        samples = load(spark, dataset.path, kind)
        report, keys = isolation({"evaluation": samples}, {"evaluation": dataset})
        own, incoming = report["datasets"]["evaluation"], leakage.lineage(keys)
        records.write_json(asdict(dataset), folder / "evaluation_spec.json")
        name = f"evaluation_history/{KEYS}-{folder.name}"
        usage = {"purpose": dataset.purpose, "provenance": dataset.provenance, "count": own["count"], "coverage": own["coverage"], "keys": name}
        incoming.write.parquet(str(Path(artifact) / name))

        def check(earlier: list[dict]) -> dict:
            entries, stored = dict(lineage["entries"]), spark.read.parquet(str(Path(artifact) / lineage["keys"]))
            for k, use in enumerate(earlier):
                entries[f"evaluation:{k}"] = {x: use[x] for x in ("purpose", "count", "coverage")}
                seen = spark.read.parquet(str(Path(artifact) / use["keys"]))
                stored = stored.unionByName(seen.withColumn("dataset", F.lit(f"evaluation:{k}")))
            return runs.check_use(incoming, own["count"], own["coverage"], dataset, stored, entries)

        try:
            with runs.evaluation(artifact, folder.name, check, usage) as allowed:
                records.write_json(allowed, folder / "lineage_report.json")
                out = kind.predict(model, samples)
                result = kind.evaluate(out, chosen)
        except runs.Ineligible as e:
            shutil.rmtree(Path(artifact) / name)
            records.write_json(e.report, folder / "lineage_report.json")
            raise
        records.write_jsonl(kind.output(out), str(folder / "predictions"))
        slices = kind.slices(out, chosen)
        result = {"purpose": dataset.purpose, "independent_test_eligible": allowed["independent_test_eligible"], "metrics": result}
        if slices is not None:
            records.write_jsonl(slices, str(folder / "slices"))
            result["slices"] = str(folder / "slices")
        records.write_json(result, folder / "metrics.json")
        return result

    return runs.run(run_root, "evaluate", {"artifact": artifact, "dataset": asdict(dataset)}, work, (artifact, dataset.path))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done. 1: refused or failed. 130: interrupted."""
    parser = argparse.ArgumentParser(prog="sievegrid")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-data", "train"):
        commands.add_parser(name).add_argument("--config", required=True)
    for name in ("predict", "evaluate"):
        p = commands.add_parser(name)
        p.add_argument("--artifact", required=True)
        p.add_argument("--input", required=True)
        p.add_argument("--run-root", required=True)
        if name == "evaluate":
            p.add_argument("--purpose", required=True)
            p.add_argument("--provenance", default="")
            p.add_argument("--independent", action="store_true")
            p.add_argument("--mode")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("sievegrid").getOrCreate()
    try:
        if a.command in ("validate-data", "train"):
            result = (validate if a.command == "validate-data" else train)(spark, runs.Task.load(a.config))
        elif a.command == "predict":
            result = predict(spark, a.artifact, a.input, a.run_root)
        else:
            result = evaluate(spark, a.artifact, runs.Dataset(a.input, a.purpose, a.provenance, a.independent), a.run_root, a.mode)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
