"""The library's own operators on small rows, and every oracle against its query."""

import hashlib
import json
import random
import time
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions import text as tx
from sievegrid.operators import decisions, dedup, leakage, merging, metrics, prepare, splitting
from sievegrid.operators.ranking import first_rows, hashed_rank
from sievegrid.plans import registry
from sievegrid.sources import records

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("https://h.example/a/b?x=1#f", "/a/b?x=1"), ("http://h.example", "/"), ("http://h?x=1", "/?x=1"), ("  /a/b?c  ", "/a/b?c"),
        ("http://[bad/a", "http://[bad/a"), ("", ""), ("mailto:x", "mailto:x"), ("http://h/a?", "/a"),
    ],
)
def test_normalize_uri(spark, uri, want):
    assert one(spark, tx.normalize_uri("u"), u=uri) == want


def test_text_functions(spark):
    assert one(spark, tx.file_extension("f"), f="a.tar.GZ") == "gz"
    assert one(spark, tx.file_extension("f"), f="noext") == ""
    assert one(spark, tx.status_family("c"), c=404) == "4xx"
    assert one(spark, tx.status_family("c"), c=0) == "unknown"
    assert one(spark, tx.extension_group("e"), e=".STL") == "safe_extension"
    assert one(spark, tx.response_format("b", "c"), b=" {}", c="") == "json"
    assert one(spark, tx.response_format("b", "c"), b="<Body x>", c="") == "html"
    assert one(spark, tx.response_format("b", "c"), b="  ", c="text/html") == "empty"


def test_headers(spark):
    got = one(spark, tx.redact_headers(tx.parse_headers("h")), h="Cookie: a=b\r\nX-My-Token: z\nAccept: */*\nbroken\n: none\nAccept: text/html: x")
    assert got == {"Cookie": "<redacted>", "X-My-Token": "<redacted>", "Accept": "text/html: x"}
    assert one(spark, tx.header(tx.parse_headers("h"), "LOCATION"), h="location: /x") == "/x"
    assert one(spark, tx.header(tx.parse_headers("h"), "none"), h="location: /x") == ""


def test_fingerprints_match_hashlib(spark):
    text = 'Line "1"\n tab\t12 \\ ü 345'
    canonical = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, fp.text_exact("t"), t=text) == sha(canonical({"text": text, "features": []}))
    assert one(spark, fp.text_template("t"), t=text) == sha(canonical(re.sub(r"\d+", "<N>", " ".join(text.lower().split()))))
    assert one(spark, fp.membership_key("k", "v"), k="id", v='a"b') == sha(canonical({"kind": "id", "value": 'a"b'}))
    body = "id 123e4567-e89b-12d3-a456-426614174000 at 2024-01-02T03:04:05 n 1700000000 x deadbeefdeadbeef 7"
    want = "POST|/a|200|text/html|id <uuid> at <timestamp> n <timestamp> x <hex> <num>"
    columns = dict(m="post", u="http://h/a", s=200, c="Text/HTML; x", b=body)
    assert one(spark, fp.upload_template("m", "u", "s", "c", "b"), **columns) == sha(want)


def test_ranks_and_firsts(spark):
    rows = spark.createDataFrame([(i, i % 3, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(500)], "i long, g long, h string")
    for r in hashed_rank(rows, ["g"], "h", "rank").groupBy("g").agg(F.collect_list(F.struct("rank", "h")).alias("x")).collect():
        ranks = sorted((x["rank"], x["h"]) for x in r["x"])
        assert [k for k, _ in ranks] == list(range(1, len(ranks) + 1)) and [h for _, h in ranks] == sorted(h for _, h in ranks)
    assert sorted(r["i"] for r in first_rows(rows, ["g"], [F.col("i")], 2).collect()) == [0, 1, 2, 3, 4, 5]


def test_conflicting_labels_go(spark):
    rows = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("b", "x", 2), ("b", "y", 4), ("c", None, 5)], "k string, l string, o int")
    assert sorted((r["k"], r["o"]) for r in dedup.exact_unique(rows, "k", "l", "o").collect()) == [("a", 1), ("c", 5)]
    capped = dedup.template_capped(rows, "k", "l", "o", 1, exclude_conflicts=False)
    assert sorted((r["k"], r["o"]) for r in capped.collect()) == [("a", 1), ("b", 2), ("b", 4), ("c", 5)]


def samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, text string, target string, source string, group_id string, label_status string, priority int")


def test_merge_prefers_priority_and_reports_conflicts(spark):
    rows = samples(spark, [("1", "t", "a", "s2", None, "labeled", 10), ("1", "t", "a", "s1", None, "labeled", 10), ("1", "t", "b", "s3", None, "labeled", 20), ("2", "u", None, "s", "g", "unlabeled", 10)])
    got = {r["sample_id"]: (r["target"], r["source"]) for r in merging.checked_merge(rows).collect()}
    assert got == {"1": ("b", "s3"), "2": (None, "s")}
    audit = merging.merge_audit(rows).collect()
    assert [(r["sample_id"], r["candidates"], r["selected_source"], r["target_conflict"]) for r in audit] == [("1", 3, "s3", True)]
    with pytest.raises(ValueError, match="equal priority: 1"):
        merging.checked_merge(rows.withColumn("priority", F.lit(1)))


def test_aligned_join_must_be_complete(spark):
    events = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "id int, v string, o int")
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, l string")
    got = merging.aligned_join(events, labels, "id", "l", "o").collect()
    assert sorted((r["id"], r["v"], r["l"]) for r in got) == [(1, "b", "x"), (2, "c", "y")]
    for bad in ([(1, "x")], [(1, "x"), (2, "y"), (3, "z")], [(1, "x"), (1, "q"), (2, "y")]):
        with pytest.raises(PySparkException):
            merging.aligned_join(events, spark.createDataFrame(bad, "id int, l string"), "id", "l", "o").collect()


def test_unknown_targets_are_errors(spark):
    rows = spark.createDataFrame([("1", "q", "unresolved")], "sample_id string, target string, label_status string")
    with pytest.raises(PySparkException):
        prepare.exclusion_reasons(rows, {"a": "b"}).collect()
    assert prepare.exclusion_reasons(rows).first()["reason"] == "status:unresolved"


def test_exact_subset_and_targets():
    assert splitting.exact_subset([("a", 3), ("b", 3), ("c", 2)], 5) == ["a", "c"]
    assert splitting.exact_subset([("a", 3), ("b", 3)], 4) is None
    assert splitting.tune_targets({"x": 5, "y": 5, "z": 1}, 6) == {"x": 3, "y": 3, "z": 0}


def test_gold_split_is_exact_and_keeps_templates(spark):
    rows = spark.createDataFrame([(str(i), "pass" if i % 2 else "fail", f"{i % 2}-{i // 4}") for i in range(40)], "id string, v string, t string")
    out = splitting.template_grouped_split(rows, "v", "t", "id", 20, 7).collect()
    assert sum(r["part"] == "tune" for r in out) == 20
    assert len({(r["t"], r["part"]) for r in out}) == len({r["t"] for r in out})


def plain_subset(sizes, target):
    ways = {0: ()}
    for name, n in sizes:
        for total, way in sorted(ways.items(), reverse=True):
            if total + n <= target and total + n not in ways:
                ways[total + n] = (*way, name)
    return list(ways[target]) if target in ways else None


def test_exact_subset_is_the_first_way_of_a_plain_search():
    r = random.Random(5)
    pools = [1], [1, 2], [2, 4], [2, 3], [1, 1, 1, 7], [3, 6, 50], [4, 4, 5], [10, 15, 6], [1] * 20 + [90], range(1, 30)
    for _ in range(2000):
        pool = r.choice(pools)
        sizes = [(str(i), r.choice(pool)) for i in range(r.randint(0, 30))]
        target = r.randint(0, sum(n for _, n in sizes) + 2)
        assert splitting.exact_subset(sizes, target) == plain_subset(sizes, target)


def test_exact_subset_of_many_templates():
    """Sizes mostly one, as the templates of a large table: no pass over all sums for each."""
    sizes = [(str(i), 2 if i % 50 == 3 else 1) for i in range(20_000)]
    began = time.process_time()
    found = splitting.exact_subset(sizes, 11_220)
    assert time.process_time() - began < 5
    assert sum(dict(sizes)[name] for name in found) == 11_220


def test_gold_split_takes_the_first_way_of_each_label(spark):
    r = random.Random(9)
    clusters = [(f"v{i % 3}", f"t{i}", r.choice([1, 1, 1, 2, 5, 40 if i % 3 == 1 else 3])) for i in range(120)]
    rows = spark.createDataFrame([(f"{t}.{j}", v, t) for v, t, n in clusters for j in range(n)], "id string, v string, t string")
    counts = {v: sum(n for w, _, n in clusters if w == v) for v, _, _ in clusters}
    digest = lambda x: hashlib.sha256(f"7:{x}".encode()).hexdigest()
    tune = set()
    for v, target in splitting.tune_targets(counts, rows.count() * 55 // 100).items():
        tune |= set(plain_subset(sorted(((t, n) for w, t, n in clusters if w == v), key=lambda x: digest(x[0])), target))
    got = splitting.template_grouped_split(rows, "v", "t", "id", rows.count() * 55 // 100, 7).collect()
    assert len(got) == rows.count() and {x["t"] for x in got if x["part"] == "tune"} == tune and not any(x["part"] == "tune" for x in got if x["t"] not in tune)
    for part in ("tune", "regress"):
        ids = [x["id"] for x in sorted(got, key=lambda x: x["position"]) if x["part"] == part]
        assert ids == sorted(ids, key=digest)


def test_gold_split_errors(spark):
    def split(rows, size):
        return splitting.template_grouped_split(spark.createDataFrame(rows, "id string, v string, t string"), "v", "t", "id", size, 7)

    with pytest.raises(RuntimeError, match="make up"):
        split([(str(i), "a", f"t{i // 2}") for i in range(6)], 3)
    with pytest.raises(RuntimeError, match="both parts"):
        split([("1", "a", "t"), ("2", "a", "u"), *[(f"b{i}", "b", "t" if i < 3 else "w") for i in range(5)]], 3)
    with pytest.raises(ValueError, match="verdict"):
        split([("1", None, "t"), ("2", "a", "u")], 1)
    with pytest.raises(ValueError, match="template"):
        split([("1", "a", None), ("2", "a", "u")], 1)


def test_independence_violations():
    specs = {n: {"purpose": p, "independent": i, "provenance": "x", "count": 3} for n, p, i in (("a", "train", False), ("b", "development", False), ("c", "independent_test", True))}
    full = {n: {"exact": 3, "template": 3} for n in specs}
    clean = [{"left": a, "right": b, "kind": "exact", "shared": 0} for a, b in (("a", "b"), ("a", "c"), ("b", "c"))]
    assert leakage.split_violations(clean, specs, full)["valid"]
    met = leakage.split_violations([*clean, {"left": "a", "right": "c", "kind": "id", "shared": 1}], specs, full)
    assert met["training_selection_valid"] and not met["independent_test_eligible"]
    with pytest.raises(ValueError):
        leakage.require(met, independent=True)
    leakage.require(met, for_training=True)


def test_metric_edges(spark):
    empty = spark.createDataFrame([], "gold string, predicted string")
    counted = metrics.confusion(empty)
    row = metrics.compatible_summary(counted).first()
    assert row["confirmed_precision"] == 0 and not row["gate_unknown"] or row["total"] is None
    rows = spark.createDataFrame([("success", "confirmed_upload_success"), ("failed", "likely_upload_success"), ("weird", "unknown")], "gold string, predicted string")
    got = metrics.compatible_summary(metrics.confusion(rows)).first()
    assert (got["false_success_count"], got["false_success_rate"], got["confirmed_precision"]) == (1, 1.0, 1.0)
    with pytest.raises(PySparkException):
        metrics.semantic_summary(metrics.confusion(rows)).collect()


def test_thresholds_are_checked():
    with pytest.raises(ValueError):
        decisions.Thresholds(confirmed=0.5, likely=0.6)


def test_jsonl_reading(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('﻿{"a":1}\r\n\r\n{"b":"x y"}\r{"c":NaN}\n[1]\n{"d":1e999}\n{"e":2}'.encode())
    got = {r["line"]: r for r in records.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 7]
    assert [got[k]["json"] for k in (1, 3, 7)] == ['{"a":1}', '{"b":"x y"}', '{"e":2}']
    assert all(got[k]["problem"] for k in (4, 5, 6))
    with pytest.raises(PySparkException):
        records.require_valid(records.read_jsonl(spark, str(tmp_path / "a.jsonl"))).collect()
    (tmp_path / "b.json").write_text('[{"a":1},{"b":2}]')
    assert [r["json"] for r in records.read_json(spark, str(tmp_path / "b.json")).orderBy("line").collect()] == ['{"a":1}', '{"b":2}']
    assert records.snapshot(spark, str(tmp_path / "b.json")).first()["sha256"] == hashlib.sha256((tmp_path / "b.json").read_bytes()).hexdigest()


def test_writing_is_exclusive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ü", None)], "a int, b string, c string")
    records.write_jsonl(rows, str(tmp_path / "out"), ["b", "a", "c"])
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size] == ['{"b":"ü","a":1,"c":null}\n']
    with pytest.raises(PySparkException):
        records.write_jsonl(rows, str(tmp_path / "out"))
    records.write_json({"x": 1}, tmp_path / "m.json")
    with pytest.raises(FileExistsError):
        records.write_json({"x": 2}, tmp_path / "m.json")
    records.write_json({"x": 3}, tmp_path / "m.json", overwrite=True)
    assert json.loads((tmp_path / "m.json").read_text()) == {"x": 3}
    with pytest.raises(ValueError):
        records.write_json(float("nan"), tmp_path / "n.json")


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("events", "documents", "pages", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = db.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert plain(want) == plain(got)


def test_gold_split_query(spark):
    out = registry.queries()["gold_split"](spark, SF)
    assert out.where("part = 'tune'").count() == out.count() * 55 // 100


def test_predictions_must_be_in_order(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "ordinal int, sample_id string")
    good = spark.createDataFrame([(1, "y", "b"), (0, "x", "a")], "ordinal int, sample_id string, output string")
    assert sorted((r["sample_id"], r["output"]) for r in merging.in_order(a, good).collect()) == [("x", "a"), ("y", "b")]
    for bad in ([(0, "x", "a")], [(0, "y", "a"), (1, "x", "b")], [(0, "x", "a"), (1, "y", "b"), (2, "z", "c")]):
        with pytest.raises(PySparkException):
            merging.in_order(a, spark.createDataFrame(bad, "ordinal int, sample_id string, output string")).collect()


def test_core_rows_need_a_verdict(spark):
    from sievegrid.plans import datasets

    rows = spark.createDataFrame([("e", "r", "p", "failed", 1)], "event_id string, request string, response string, label string, more int")
    assert datasets.core_rows(rows, "new").first().asDict() == {"event_id": "e", "request": "r", "response": "p", "label": "failed", "v4_source": "new"}
    with pytest.raises(PySparkException):
        datasets.core_rows(rows.withColumn("label", F.lit("odd")), "new").collect()
