"""Formal acceptance of a judge: inputs, both metrics, parity and gates, once."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import CONFIRMED, FAILED, VERDICTS
from sievegrid.operators import decisions, metrics
from sievegrid.sources.records import write_json

LEAST_ROWS, LEAST_GOLD, LISTED, SMOKE_ROWS = 3000, 30, 100, 50


def input_checks(gold: DataFrame, compatible: DataFrame, key: str = "event_id", label: str = "label") -> dict:
    """Sizes, label sets and disjoint ids of the two inputs, and whether all is as it must be."""
    g = {r[label]: r["n"] for r in gold.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    c = {r[label]: r["n"] for r in compatible.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = gold.select(key).distinct().join(compatible.select(key).distinct(), key, "left_semi").count()
    checks = {
        "compatible_rows": sum(c.values()) >= LEAST_ROWS, "compatible_labels": set(c) <= {CONFIRMED, FAILED}, "gold_classes": set(g) == set(VERDICTS),
        "gold_class_sizes": all(g.get(v, 0) >= LEAST_GOLD for v in VERDICTS), "gold_not_in_compatible": shared == 0,
    }
    return {"checks": checks, "passed": all(checks.values()), "gold": g, "compatible": c, "shared_ids": shared}


def parity(one: DataFrame, other: DataFrame, key: str = "event_id", first: int | None = None) -> dict:
    """Whether two runs agree in every row (or in the `first` rows of one by id), and the first ids where they don't."""
    if first is not None:
        one = one.orderBy(key).limit(first)
        other = other.join(one.select(key), key, "left_semi")
    differ = decisions.mismatches(one, other, key)
    n = differ.count()
    return {"mismatches": n, "first": [r[key] for r in differ.orderBy(key).limit(LISTED).collect()], "passed": n == 0}


def gates(summary: DataFrame) -> dict[str, bool]:
    row = summary.first()
    return {k: bool(row[k]) for k in summary.columns if k.startswith("gate_")}


def accept(gold: DataFrame, compatible: DataFrame, again: DataFrame, folder: str | Path, smoke: bool = False) -> dict:
    """Judge rows (event_id, label, verdict, confidence) of both inputs; `again` are gold rows judged anew.

    A formal acceptance leaves a mark before it reads a verdict and refuses to run twice; a
    smoke run leaves none, may start with small inputs, and compares the first SMOKE_ROWS rows
    by id only.
    """
    folder = Path(folder)
    integrity = input_checks(gold, compatible)
    if not smoke:
        if not integrity["passed"]:
            raise ValueError(f"the inputs fail their checks: {integrity['checks']}")
        try:
            write_json({"status": "running", "started_at": datetime.now(UTC).isoformat()}, folder / ".acceptance_consumed.json")
        except FileExistsError as e:
            raise RuntimeError("the formal acceptance has been used already") from e
    judged = lambda df: metrics.confusion(df, gold="label", predicted="verdict")
    columns = ["event_id", "verdict", "confidence"]
    groups = {
        "semantic_gold": gates(metrics.semantic_summary(judged(gold))), "compatibility": gates(metrics.compatible_summary(judged(compatible))),
        "parity": {"no_mismatch": parity(gold.select(columns), again.select(columns), first=SMOKE_ROWS if smoke else None)["passed"]},
    }
    passed = all(v for g in groups.values() for v in g.values())
    report = {"mode": "smoke" if smoke else "formal_one_shot", "status": "passed" if passed else "failed", "inputs": integrity, "gates": groups}
    if not smoke:
        write_json(report, folder / "acceptance.json")
    return report


def to_markdown(title: str, tables: dict[str, list[dict]]) -> str:
    """Small reports as Markdown: a heading and a table for each list of rows."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "/")
    lines = [f"# {title}", ""]
    for name, rows in tables.items():
        columns = list(rows[0]) if rows else []
        lines += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        lines += ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows] + [""]
    return "\n".join(lines)
