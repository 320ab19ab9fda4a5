"""Samples, partitions, judged pairs and upload events derived from the standard tables.

Each view exists twice: as a DataFrame, and as the SQL that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions.text import CONFIRMED, FAILED, LIKELY, UNKNOWN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SAMPLES = """
samples as (
  select cast(doc_id as varchar) as sample_id, text, lang as target, source, source as group_id,
         case when quality is not null then 'labeled' else 'unlabeled' end as label_status, doc_id as ordinal
  from documents left join labels using (doc_id))"""


def _labelled(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("sample_id"), *more, F.col("lang").alias("target"), "source", F.col("source").alias("group_id"),
        F.when(F.col("quality").isNotNull(), "labeled").otherwise("unlabeled").alias("label_status"), F.col("doc_id").alias("ordinal"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "text")


KEYED = (
    SAMPLES
    + """,
keyed as (
  select *, sha256('{"features":[],"text":' || to_json(text)::varchar || '}') as exact,
         sha256(to_json(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\d+', '<N>', 'g'))::varchar) as template
  from samples)"""
)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their fingerprints and the length of their text, but without it: hashed before the join, so that no text is shuffled."""
    docs = table(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", "lang", "source", fp.text_exact("text").alias("exact"), fp.text_template("text").alias("template"), F.length("text").alias("chars"))
    return _labelled(hashed, table(spark, sf_dir, "labels"), "exact", "template", "chars")


SOURCES = (
    SAMPLES
    + """,
sources as (
  select *, 10 as priority from samples
  union all by name
  select * replace (case when ordinal % 6 = 0 then 'xx' else target end as target, 'review' as source), 20 as priority from samples where ordinal % 3 = 0
  union all by name
  select * replace ('late' as source), 10 as priority from samples where ordinal % 5 = 0)"""
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping annotations of the samples, at two priorities."""
    base, n = samples(spark, sf_dir), F.col("ordinal")

    def version(target, source, priority: int):
        return F.struct(F.col(target).alias("target") if isinstance(target, str) else target.alias("target"), source.alias("source"), F.lit(priority).alias("priority"))

    corrected = F.when(n % 6 == 0, "xx").otherwise(F.col("target"))
    late = F.when(n % 5 == 0, version("target", F.lit("late"), 10))
    versions = F.array_compact(F.array(version("target", F.col("source"), 10), F.when(n % 3 == 0, version(corrected, F.lit("review"), 20)), late))
    kept = [c for c in base.columns if c not in ("target", "source")]
    return base.withColumn("_v", F.explode(versions)).select(*kept, "_v.*")


FLAWED = (
    SAMPLES
    + """,
flawed as (
  select ordinal, case when ordinal % 97 = 0 then ' ' else sample_id end as sample_id, case when ordinal % 89 = 1 then null else source end as source,
         case when ordinal % 83 = 2 then '' else group_id end as group_id, case when ordinal % 79 = 3 then 'odd' else label_status end as label_status
  from samples)"""
)


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of which some break the contract."""
    n, own = F.col("ordinal"), F.col
    return samples(spark, sf_dir).select(
        "ordinal", F.when(n % 97 == 0, " ").otherwise(own("sample_id")).alias("sample_id"), F.when(n % 89 != 1, own("source")).alias("source"),
        F.when(n % 83 == 2, "").otherwise(own("group_id")).alias("group_id"), F.when(n % 79 == 3, "odd").otherwise(own("label_status")).alias("label_status"),
    )


PARTITIONS = (
    KEYED
    + """,
partitions as (
  select *, case ordinal % 10 when 0 then 'b_dev' when 1 then 'c_hist' when 2 then 'd_test' else 'a_train' end as dataset from keyed
  union all by name
  select *, 'd_test' as dataset from keyed where ordinal % 70 = 3)"""
)
DATASETS = ["a_train", "b_dev", "c_hist", "d_test"]


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partitions by id, some training rows also in the test."""
    o = F.col("ordinal") % 10
    name = F.when(o == 0, "b_dev").when(o == 1, "c_hist").when(o == 2, "d_test").otherwise("a_train")
    names = F.array_compact(F.array(name, F.when(F.col("ordinal") % 70 == 3, "d_test")))
    return keyed(spark, sf_dir).withColumn("dataset", F.explode(names))


PAIRS = f"""
pairs as (
  select doc_id, source, case when quality = 0 then '{FAILED}' when doc_id % 3 = 0 then '{LIKELY}' when doc_id % 17 = 0 then '{UNKNOWN}' else '{CONFIRMED}' end as gold,
         case when toxic = 1 then '{UNKNOWN}' when doc_id % 13 = 0 then '{LIKELY}' when quality = 0 and doc_id % 5 > 0 then '{FAILED}' else '{CONFIRMED}' end as predicted
  from documents join labels using (doc_id))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = F.when(F.col("quality") == 0, FAILED).when(F.col("doc_id") % 3 == 0, LIKELY).when(F.col("doc_id") % 17 == 0, UNKNOWN).otherwise(CONFIRMED)
    predicted = (
        F.when(F.col("toxic") == 1, UNKNOWN).when(F.col("doc_id") % 13 == 0, LIKELY)
        .when((F.col("quality") == 0) & (F.col("doc_id") % 5 > 0), FAILED).otherwise(CONFIRMED)
    )
    return x.select("doc_id", "source", gold.alias("gold"), predicted.alias("predicted"))


UPLOADS = f"""
uploads as (
  select cast(page_id as varchar) as event_id, page_id as ordinal, 'post' as method, url as uri,
         ([200, 200, 302, 404, 500, 0])[page_id % 6 + 1]::int as status_code,
         ([' Text/HTML; charset=utf-8', 'text/html', ''])[page_id % 3 + 1] as content_type, html as body,
         (['php', '.STL', 'png', 'jsp', 'step', ''])[page_id % 6 + 1] as file_ext,
         (['success', 'failed', 'likely_upload_success', 'failure', 'unknown'])[page_id % 5 + 1] as label,
         case when page_id % 7 < 3 then '{CONFIRMED}' when page_id % 7 < 5 then '{FAILED}' else '{UNKNOWN}' end as predicted
  from pages)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events whose responses are the pages."""

    def pick(n: int, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % n + 1).cast("int"))

    m = F.col("page_id") % 7
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("event_id"), F.col("page_id").alias("ordinal"), F.lit("post").alias("method"), F.col("url").alias("uri"),
        pick(6, 200, 200, 302, 404, 500, 0).alias("status_code"), pick(3, " Text/HTML; charset=utf-8", "text/html", "").alias("content_type"),
        F.col("html").alias("body"), pick(6, "php", ".STL", "png", "jsp", "step", "").alias("file_ext"),
        pick(5, "success", "failed", "likely_upload_success", "failure", "unknown").alias("label"),
        F.when(m < 3, CONFIRMED).when(m < 5, FAILED).otherwise(UNKNOWN).alias("predicted"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole upload events: the pages as HTML answers, and JSON answers composed from the events."""
    e = F.col("event_id")
    variants = [
        F.concat(F.lit('{"success":true,"url":"/uploads/'), e.cast("string"), F.lit('.php"}')), F.lit('{"success":false,"message":"文件上传失败"}'),
        F.concat(F.lit('{"code":0,"fileId":"'), e.cast("string"), F.lit('"}')), F.concat(F.lit('{"status":"'), F.col("event_type"), F.lit('"}')),
        F.lit('{"data":{"success":false},"success":true}'), F.concat(F.lit("props "), F.coalesce("props", F.lit(""))),
    ]
    none = F.lit(None).cast("map<string,string>")
    json = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), e.cast("string")).alias("event_id"), F.lit("POST").alias("method"), F.lit("/api/upload").alias("uri"),
        F.concat(e.cast("string"), F.lit(".php")).alias("filename"), F.lit("php").alias("file_ext"), F.lit("file").alias("field_name"), F.lit("").alias("request_body"),
        F.lit(200).alias("status_code"), none.alias("headers"), F.lit("application/json").alias("content_type"),
        F.element_at(F.array(*variants), (e % len(variants) + 1).cast("int")).alias("body"), (e * 37 % 101 / F.lit(100.0)).alias("p_success"),
    )
    pages = uploads(spark, sf_dir).select(
        F.concat(F.lit("p"), F.col("event_id")).alias("event_id"), "method", "uri", F.concat(F.lit("file."), F.col("file_ext")).alias("filename"), "file_ext",
        F.lit("file").alias("field_name"), F.lit("").alias("request_body"), "status_code", none.alias("headers"), "content_type", "body", F.lit(0.7).alias("p_success"),
    )
    return json.unionByName(pages)


ALERTS = """
alerts as (
  select event_id as line, case event_id % 3 when 0 then 'https://h.example/upload?e=' || event_id when 1 then 'http://h.example' else '/local/' || event_id end as url,
         case event_id % 4 when 0 then 'name="file"; filename="a' || event_id || '.PHP"' when 1 then 'filename=b%20' || event_id || '.txt' else 'none' end as reqs_body,
         case event_id % 5 when 0 then '2x0' else (200 + event_id % 5)::varchar end as status, event_type as resp_body from events)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform alert records, one JSON object a row, with line numbers."""
    e = F.col("event_id")
    n = e.cast("string")
    http = F.struct(
        F.lit("POST").alias("method"),
        F.when(e % 3 == 0, F.concat(F.lit("https://h.example/upload?e="), n)).when(e % 3 == 1, "http://h.example").otherwise(F.concat(F.lit("/local/"), n)).alias("url"),
        F.lit("Content-Type: multipart/form-data\r\nCookie: a=b").alias("reqs_header"),
        F.when(e % 4 == 0, F.concat(F.lit('name="file"; filename="a'), n, F.lit('.PHP"'))).when(e % 4 == 1, F.concat(F.lit("filename=b%20"), n, F.lit(".txt"))).otherwise("none").alias("reqs_body"),
        F.lit("Content-Type: text/plain").alias("resp_header"), F.col("event_type").alias("resp_body"),
        F.when(e % 5 == 0, "2x0").otherwise((200 + e % 5).cast("string")).alias("status"),
    )
    for name in ("http", "net", "alert", "detail", "data", "detail"):
        http = F.struct(http.alias(name))
    return table(spark, sf_dir, "events").select(F.to_json(http).alias("json"), e.alias("line"))
