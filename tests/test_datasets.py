"""Building isolated partitions, and the judge's model on them."""

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import http
from sievegrid.operators import evidence, model
from sievegrid.plans import datasets


@pytest.fixture(scope="module")
def events(spark):
    def make(start, n, tail=""):
        rows = spark.range(start, start + n)
        i = F.col("id")
        request = F.struct(*[F.lit(v).alias(k) for k, v in dict(method="POST", uri="http://h/u", content_type="", filename="a.php", file_ext="php", field_name="f", body_excerpt="x").items()], F.lit(None).cast("map<string,string>").alias("headers"))
        word = F.element_at(F.array(*[F.lit(w) for w in "ant bee cat dog eel fox gnu hen".split()]), (i / 5 % 8 + 1).cast("int"))
        body = F.when(i % 2 == 0, F.concat(F.lit('{"success":true,"name":"'), word, F.lit(tail + '"}'))).otherwise(F.concat(F.lit('{"success":false,"name":"'), word, F.lit(tail + '"}')))
        response = F.struct(F.lit(200).alias("status_code"), F.lit("application/json").alias("content_type"), body.alias("body"), F.lit(None).cast("map<string,string>").alias("headers"))
        return rows.select(F.concat(F.lit("e"), i).alias("event_id"), i.alias("ordinal"), F.when(i % 2 == 0, "success").otherwise("failure").alias("label"), request.alias("request"), response.alias("response"))

    return make


def test_build_isolates(spark, events):
    built = datasets.build(events(0, 60), events(20, 30).unionByName(events(100, 40, " new")))
    rows = {k: p.collect() for k, p in built.partitions.items()}
    assert sorted(built.counts.items()) == sorted((k, len(v)) for k, v in rows.items())
    keys = {k: {r["exact"] for r in v} for k, v in rows.items()}
    assert len(rows["train"]) + len(rows["val"]) == 16 and len(rows["val"]) >= 2 and rows["final_test"]
    assert not keys["train"] & keys["val"] and not (keys["train"] | keys["val"]) & keys["final_test"]
    assert built.leakage().where("kind = 'exact' and shared > 0").count() == 0
    assert {r["value"] for r in built.profile().where("measure = 'label'").collect()} == {"confirmed_upload_success", "failed"}
    assert built.conflicts.count() == 0


def test_final_windows(spark, events):
    history = datasets.fingerprinted(events(0, 40)).select("exact", "template")
    out = datasets.final_window(events(0, 40).unionByName(events(200, 40, " late")), history, least=5)
    assert out.join(history, "template", "left_semi").count() == 0 and out.count() == 16
    with pytest.raises(RuntimeError):
        datasets.final_window(events(0, 40), history, least=5)
    gold = out.orderBy("event_id").limit(3)
    assert datasets.after_gold(out, gold, least=5).count() == 13
    with pytest.raises(RuntimeError):
        datasets.after_gold(out, gold.withColumn("event_id", F.lit("other")), least=5)


def test_judge_model(spark, events):
    rows = http.flat(http.standardised(events(0, 60))).drop("ordinal", "exact", "template")
    fitted = datasets.fit_judge_model(rows, settings=model.Settings(iterations=20))
    assert fitted.classes == [0, 1] and fitted.width == 24
    scored = datasets.success_probability(rows, fitted)
    out = evidence.judge(evidence.with_rule(evidence.with_features(scored))).collect()
    wrong = [(r["label"], r["verdict"], r["decided_by"], r["body"]) for r in out if (r["verdict"] == "failed") != (r["label"] == "failed")]
    assert not wrong, wrong[:3]
