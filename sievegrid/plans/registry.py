"""All queries over the library's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import fingerprints as fp
from sievegrid.functions import http
from sievegrid.functions import text as tx
from sievegrid.operators import decisions, dedup, evidence, leakage, merging, metrics, model, prepare, reviewing, splitting
from sievegrid.plans import datasets, views
from sievegrid.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


# --- Identity


@query("text_fingerprints", f"with {views.KEYED} select sample_id, exact, template from keyed")
def text_fingerprints(spark, sf):
    return views.keyed(spark, sf).select("sample_id", "exact", "template")


_URI = r"""case when regexp_extract(trim(uri), '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]+)', 2) = '' then trim(uri) else
  case when regexp_extract(trim(uri), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(trim(uri), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^?#]*)', 1) end
  || case when regexp_extract(trim(uri), '^[^?#]*[?]([^#]*)', 1) = '' then '' else '?' || regexp_extract(trim(uri), '^[^?#]*[?]([^#]*)', 1) end end"""


def _replaced(x: str, rules) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_HEAD = f"upper(method) || '|' || ({_URI}) || '|' || status_code || '|' || trim(split_part(lower(content_type), ';', 1)) || '|'"
_CLUSTER = f"substring(trim(regexp_replace({_replaced('lower(body)', fp.CLUSTER)}, '\\s+', ' ', 'g')), 1, 4000)"


@query(
    "upload_fingerprints",
    f"""with {views.UPLOADS} select event_id, {_URI} as path, sha256({_HEAD} || body) as exact,
    sha256({_HEAD} || {_replaced("body", fp.TEMPLATE)}) as template,
    substring(sha256({_CLUSTER}), 1, 12) || ':' || substring({_CLUSTER}, 1, 60) as cluster from uploads""",
)
def upload_fingerprints(spark, sf):
    head = ("method", "uri", "status_code", "content_type", "body")
    return views.uploads(spark, sf).select(
        "event_id", tx.normalize_uri("uri").alias("path"), fp.upload_exact(*head).alias("exact"), fp.upload_template(*head).alias("template"), fp.cluster_key("body").alias("cluster")
    )


@query(
    "event_text_functions",
    f"""with {views.UPLOADS} select event_id,
    case when status_code = 0 then 'unknown' else (status_code // 100) || 'xx' end as family,
    case when trim(lower(file_ext), '.') in {tx.SCRIPT_EXTENSIONS} then 'script' when trim(lower(file_ext), '.') in {tx.SAFE_EXTENSIONS} then 'safe_extension' else 'other' end as extension_group,
    case when trim(body) = '' then 'empty' when contains(lower(content_type), 'json') or trim(body)[1] in ('{{', '[') then 'json'
         when contains(lower(content_type), 'html') or regexp_matches(body, '(?i)<(html|body|form)\\b') then 'html' else 'text' end as format,
    case when contains(uri, '.') then substring(lower(split_part(uri, '.', -1)), 1, 32) else '' end as uri_extension,
    case when label in ('success', 'likely_upload_success', 'confirmed_upload_success') then 'confirmed_upload_success' when label in ('failed', 'failure') then 'failed' else label end as verdict,
    case when label in ('success', 'likely_upload_success', 'confirmed_upload_success') then 'success' else label end as gold
    from uploads""",
)
def event_text_functions(spark, sf):
    return views.uploads(spark, sf).select(
        "event_id", tx.status_family("status_code").alias("family"), tx.extension_group("file_ext").alias("extension_group"),
        tx.response_format("body", "content_type").alias("format"), tx.file_extension("uri").alias("uri_extension"),
        tx.normalize_label("label").alias("verdict"), tx.normalize_gold("label").alias("gold"),
    )


# --- Preparation


_TARGETS = {"en": "english", "de": "german", "fr": "french"}


@query(
    "target_preparation",
    f"""with {views.SAMPLES}, reasoned as (
      select *, case target when 'en' then 'english' when 'de' then 'german' when 'fr' then 'french' end as training_target,
        case when label_status = 'unlabeled' then 'unlabeled' when target = 'es' then 'target:es' end as reason from samples)
    select 'reason' as measure, reason as value, count(*) as rows from reasoned where reason is not null group by reason
    union all select 'class', training_target, count(*) from reasoned where reason is null group by training_target""",
)
def target_preparation(spark, sf):
    return prepare.preparation_counts(prepare.exclusion_reasons(views.samples(spark, sf), _TARGETS, ("es",)))


@query(
    "sample_contract",
    f"""with {views.FLAWED}, checked as (select ordinal, case when trim(sample_id) = '' then 'sample_id must be a non-blank string' when source is null then 'source must be a string'
      when trim(group_id) = '' then 'group_id must be non-blank or null' when label_status not in {prepare.STATUSES} then 'unknown label_status' end as problem from flawed)
    select ordinal, problem from checked where problem is not null""",
)
def sample_contract(spark, sf):
    return prepare.check_samples(views.flawed(spark, sf))


@query("repeated_ids", f"with {views.SOURCES} select sample_id, count(*) as rows from sources group by sample_id having count(*) > 1")
def repeated_ids(spark, sf):
    return prepare.repeated_ids(views.sources(spark, sf))


# --- Deduplication

_CONFLICTS = "select exact from keyed group by exact having count(distinct target) > 1"
_UNIQUE = f"""unique_rows as (
  select * from keyed where exact not in ({_CONFLICTS}) qualify row_number() over (partition by exact order by ordinal) = 1)"""


def _keys(spark, sf):
    """Samples without their texts: what dedup needs to shuffle."""
    return views.keyed(spark, sf).select("sample_id", "exact", "template", "target", "ordinal")


@query("exact_dedup_counts", f"with {views.KEYED}, {_UNIQUE} select target as lang, count(*) as kept from unique_rows group by target")
def exact_dedup_counts(spark, sf):
    unique = dedup.exact_unique(_keys(spark, sf), "exact", "target", "ordinal")
    return unique.groupBy(F.col("target").alias("lang")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "label_conflicts",
    f"""with {views.KEYED.replace("keyed as (", "first_keyed as (")},
    keyed as (select * replace (case when ordinal % 6 = 0 then 'xx' else target end as target) from first_keyed), {_UNIQUE}
    select 'exact' as fingerprint_type, exact as fingerprint, array_to_string(list_sort(list(distinct target)), ',') as labels, 'unknown_excluded' as resolution from keyed group by exact having count(distinct target) > 1
    union all select 'template', template, array_to_string(list_sort(list(distinct target)), ','), 'unknown_excluded' from unique_rows group by template having count(distinct target) > 1""",
)
def label_conflicts(spark, sf):
    """Every sixth sample has another label than its copies."""
    rows = _keys(spark, sf).withColumn("target", F.when(F.col("ordinal") % 6 == 0, "xx").otherwise(F.col("target")))
    audit = dedup.conflict_audit(rows, "exact", "template", "target", "ordinal")
    return audit.withColumn("labels", F.concat_ws(",", "labels"))


_CAP = 3


@query(
    "template_cap",
    f"""with {views.UPLOADS}, e as (select *, sha256({_HEAD} || {_replaced("body", fp.TEMPLATE)}) as template from uploads)
    select event_id from e qualify row_number() over (partition by template, label order by ordinal) <= {_CAP}""",
)
def template_cap(spark, sf):
    head = ("method", "uri", "status_code", "content_type", "body")
    rows = views.uploads(spark, sf).withColumn("template", fp.upload_template(*head)).select("event_id", "template", "label", "ordinal")
    return dedup.template_capped(rows, "template", "label", "ordinal", _CAP, exclude_conflicts=False).select("event_id")


@query(
    "template_unique",
    f"""with {views.KEYED}, {_UNIQUE}, clean as (select template from unique_rows group by template having count(distinct target) = 1)
    select sample_id from unique_rows where template in (select template from clean) qualify row_number() over (partition by template order by ordinal) = 1""",
)
def template_unique(spark, sf):
    unique = dedup.exact_unique(_keys(spark, sf), "exact", "target", "ordinal").select("sample_id", "template", "target", "ordinal")
    return dedup.template_capped(unique, "template", "target", "ordinal", 1, exclude_conflicts=True).select("sample_id")


@query("blocked_history", f"with {views.KEYED}, blocked as (select exact from keyed where ordinal % 9 = 0) select sample_id from keyed where exact not in (select exact from blocked)")
def blocked_history(spark, sf):
    rows = views.keyed(spark, sf).select("sample_id", "exact", "ordinal")
    return dedup.without_blocked(rows, rows.where("ordinal % 9 = 0"), "exact").select("sample_id")


# --- Splits and samples


@query(
    "stratified_split",
    f"""with {views.SAMPLES}, ranked as (
      select sample_id, target, row_number() over (partition by target order by sha256('42:' || sample_id)) as r, count(*) over (partition by target) as n from samples)
    select sample_id, target, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'val' else 'train' end as part from ranked""",
)
def stratified_split(spark, sf):
    return splitting.stratified_split(views.samples(spark, sf).select("sample_id", "target"), "target", "sample_id", 0.1, 42)


@query(
    "round_robin_sample",
    f"""with {views.SAMPLES}, s as (select sample_id, target || '|' || source as stratum from samples), ranked as (
      select *, row_number() over (partition by stratum order by sha256('42:' || sample_id)) as r, count(*) over (partition by stratum) as n from s)
    select sample_id, stratum from ranked order by r, n, stratum limit 300""",
)
def round_robin_sample(spark, sf):
    rows = views.samples(spark, sf).select("sample_id", F.concat_ws("|", "target", "source").alias("stratum"))
    return splitting.round_robin_sample(rows, "stratum", "sample_id", 300, 42)


@query(
    "ranked_templates",
    f"""with {views.KEYED}, scored as (select sample_id, template, length(text) % 17 as score from keyed)
    select * from (select * from scored where score > 0 qualify row_number() over (partition by template order by score desc, sample_id) = 1) order by score desc, sample_id limit 50""",
)
def ranked_templates(spark, sf):
    rows = views.keyed(spark, sf).select("sample_id", "template", (F.col("chars") % 17).cast("long").alias("score"))
    return splitting.ranked_templates(rows, "score", "sample_id", "template", 50)


@query("gold_split")
def gold_split(spark, sf):
    """Gold rows: the labelled documents; the tuning part is 55 % of them."""
    rows = materialize(views.keyed(spark, sf).where("label_status = 'labeled'").select("sample_id", "target", "template"))
    clean = materialize(dedup.without_blocked(rows, dedup.label_conflicts(rows, "template", "target"), "template"))
    return splitting.template_grouped_split(clean, "target", "template", "sample_id", clean.count() * 55 // 100, 42)


# --- Merges and joins


_BEST = "row_number() over (partition by sample_id order by priority desc, source)"


@query("priority_merge", f"with {views.SOURCES} select sample_id, target, source, priority from sources qualify {_BEST} = 1")
def priority_merge(spark, sf):
    """Rows of one id at one priority differ in source only, so the source decides ties."""
    return merging.checked_merge(views.sources(spark, sf)).select("sample_id", "target", "source", "priority")


@query(
    "merge_audit",
    f"""with {views.SOURCES}, best as (select sample_id, source from sources qualify {_BEST} = 1)
    select sample_id, count(*) as candidates, max(priority) as selected_priority, any_value(best.source) as selected_source, count(distinct target) > 1 as target_conflict
    from sources join best using (sample_id) group by sample_id having count(*) > 1""",
)
def merge_audit(spark, sf):
    return merging.merge_audit(views.sources(spark, sf))


@query(
    "override_join",
    f"""with {views.SAMPLES}, u as (select sample_id, target, ordinal, 10 as priority from samples union all select sample_id, 'gold', ordinal, 20 from samples where ordinal % 4 = 0)
    select sample_id, target, ordinal, priority from u qualify row_number() over (partition by sample_id order by priority desc, ordinal desc) = 1""",
)
def override_join(spark, sf):
    base = views.samples(spark, sf).select("sample_id", "target", "ordinal")
    return merging.override(base, base.where("ordinal % 4 = 0").withColumn("target", F.lit("gold")), "sample_id", "ordinal")


@query("aligned_join", "select doc_id, source, quality from documents join labels using (doc_id)")
def aligned_join(spark, sf):
    labels = views.table(spark, sf, "labels").select("doc_id", "quality")
    docs = views.table(spark, sf, "documents").select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_semi")
    return merging.aligned_join(docs, labels, "doc_id", "quality", "doc_id")


@query(
    "alignment_gaps",
    "select 'left' as side, doc_id from documents where doc_id not in (select doc_id from labels) union all select 'right', doc_id from labels where doc_id not in (select doc_id from documents)",
)
def alignment_gaps(spark, sf):
    return merging.alignment(views.table(spark, sf, "documents"), views.table(spark, sf, "labels"), "doc_id")


# --- Leakage and lineage

_KEYS = f"""{views.PARTITIONS}, keys as (
  select dataset, kind, value from (
    select dataset, unnest(['id', 'exact', 'template', 'group']) as kind, unnest([sample_id, exact, template, group_id]) as value from partitions)
  where value is not null and trim(value) <> '')"""


@query("key_coverage", f"with {_KEYS} select dataset, kind, count(*) as covered, count(distinct value) as distinct_keys from keys group by dataset, kind")
def key_coverage(spark, sf):
    return leakage.key_coverage(leakage.key_table(views.partitions(spark, sf)))


@query(
    "split_overlaps",
    f"""with {_KEYS}, d as (select distinct dataset, kind, value from keys), names as (select distinct dataset from d), kinds as (select distinct kind from d),
    every as (select a.dataset as l, b.dataset as r, kind from names a join names b on a.dataset < b.dataset cross join kinds),
    met as (select a.dataset as l, b.dataset as r, a.kind, count(*) as n from d a join d b on a.kind = b.kind and a.value = b.value and a.dataset < b.dataset group by all)
    select l as "left", r as "right", kind, coalesce(n, 0) as shared from every left join met using (l, r, kind)""",
)
def split_overlaps(spark, sf):
    return leakage.pair_overlaps(leakage.key_table(views.partitions(spark, sf)), views.DATASETS)


_HASH = """sha256('{"kind":"' || kind || '","value":' || to_json(value)::varchar || '}')"""


@query("lineage_keys", f"with {_KEYS} select distinct dataset, kind, {_HASH} as key_hash from keys")
def lineage_keys(spark, sf):
    return leakage.lineage(leakage.key_table(views.partitions(spark, sf)))


@query(
    "lineage_overlaps",
    f"""with {_KEYS}, hashed as (select distinct dataset, kind, {_HASH} as key_hash from keys),
    met as (select s.dataset, s.kind, s.key_hash from hashed s join hashed i using (kind, key_hash) where i.dataset = 'd_test' and s.dataset <> 'd_test')
    select dataset, kind, count(*) as shared from met group by dataset, kind union all select '*', kind, count(distinct key_hash) from met group by kind""",
)
def lineage_overlaps(spark, sf):
    keys = leakage.lineage(leakage.key_table(views.partitions(spark, sf)))
    return leakage.lineage_overlaps(keys.where("dataset = 'd_test'"), keys.where("dataset != 'd_test'"))


@query(
    "partition_profile",
    f"""with {views.UPLOADS}, p as (select
      case when label in ('success', 'likely_upload_success') then 'confirmed_upload_success' when label = 'failure' then 'failed' else label end as label,
      case when status_code = 0 then 'unknown' else (status_code // 100) || 'xx' end as family,
      case when trim(lower(file_ext), '.') in ('php', 'jsp', 'aspx') then 'php_jsp_aspx' when trim(lower(file_ext), '.') in ('step', 'stp', 'stl') then 'step_stl' else 'other' end as extension from uploads)
    select 'label' as measure, label as value, count(*) as rows from p group by label union all select 'family', family, count(*) from p group by family
    union all select 'extension', extension, count(*) from p group by extension""",
)
def partition_profile(spark, sf):
    rows = views.uploads(spark, sf).select(
        tx.normalize_label("label").alias("label"), tx.status_family("status_code").alias("family"), tx.profile_extension_group("file_ext").alias("extension")
    )
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in rows.columns])
    return rows.select(F.explode(measures).alias("x")).groupBy("x.measure", "x.value").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "training_counts",
    f"""with {views.UPLOADS}, t as (select label, file_ext as source, case when label in ('success', 'likely_upload_success') then '1' when label in ('failed', 'failure') then '0' else 'excluded' end as target from uploads)
    select 'label' as measure, label as value, count(*) as rows from t group by label union all select 'source', source, count(*) from t group by source
    union all select 'binary', target, count(*) from t group by target""",
)
def training_counts(spark, sf):
    return datasets.training_counts(views.uploads(spark, sf), source="file_ext")


@query(
    "candidate_templates",
    f"""with {views.UPLOADS} select event_id, sha256(uri || '|' || regexp_replace(lower(body), '{fp.NUMBER}', '<num>', 'g')) as template from uploads""",
)
def candidate_templates(spark, sf):
    return views.uploads(spark, sf).select("event_id", fp.candidate_template("uri", "body").alias("template"))


@query("paired_predictions", f"with {views.PAIRS} select doc_id, gold, predicted from pairs")
def paired_predictions(spark, sf):
    rows = views.pairs(spark, sf).withColumn("sample_id", F.col("doc_id").cast("string"))
    return merging.in_order(rows.select("doc_id", "sample_id", "gold"), rows.select("doc_id", "sample_id", "predicted"), "doc_id").select("doc_id", "gold", "predicted")


# --- Metrics


def _gold2(x: str) -> str:
    return f"case when {x} in ('success', 'likely_upload_success', 'confirmed_upload_success') then 'success' else {x} end"


def _score_sql(source: str, by: str = "") -> str:
    """Per-class scores from rows (by..., name, support, predicted, hits)."""
    p = "case when predicted = 0 then 0.0::double else hits::double / predicted end"
    r = "case when support = 0 then 0.0::double else hits::double / support end"
    return f"""select {by} name, support, predicted, hits, round_even(p, 6) as precision, round_even(r, 6) as recall,
      round_even(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from (select *, {p} as p, {r} as r from ({source}))"""


_NAMES = "(values ('confirmed_upload_success', 'success'), ('likely_upload_success', 'success'), ('failed', 'failed'), ('unknown', null)) as v(name, expected)"


@query(
    "compatible_per_class",
    f"""with {views.PAIRS}, g as (select {_gold2("gold")} as gold, predicted from pairs) """
    + _score_sql(f"""select name, count(*) filter (gold = expected) as support, count(*) filter (predicted = name) as predicted,
       count(*) filter (gold = expected and predicted = name) as hits from g cross join {_NAMES} group by name"""),
)
def compatible_per_class(spark, sf):
    return metrics.compatible_per_class(metrics.confusion(views.pairs(spark, sf)))


_SUMMARY = """select {by} total, round_even(case when c = 0 then 0.0::double else ch::double / c end, 6) as confirmed_precision,
  round_even(case when f = 0 then 0.0::double else fh::double / f end, 6) as failed_precision, round_even(u::double / total, 6) as unknown_rate,
  false_success_count, round_even(case when gf = 0 then 0.0::double else false_success_count::double / gf end, 6) as false_success_rate,
  round_even(case when c = 0 then 0.0::double else ch::double / c end, 6) >= 0.9 as gate_confirmed,
  round_even(case when f = 0 then 0.0::double else fh::double / f end, 6) >= 0.95 as gate_failed, u::double / total <= 0.3 as gate_unknown,
  case when gf = 0 then 1.0::double else false_success_count::double / gf end <= 0.01 as gate_false_success
  from (select {by} count(*) as total, count(*) filter (predicted = 'confirmed_upload_success') as c,
    count(*) filter (predicted = 'confirmed_upload_success' and gold = 'success') as ch, count(*) filter (predicted = 'failed') as f,
    count(*) filter (predicted = 'failed' and gold = 'failed') as fh, count(*) filter (predicted = 'unknown') as u, count(*) filter (gold = 'failed') as gf,
    count(*) filter (gold = 'failed' and predicted in ('confirmed_upload_success', 'likely_upload_success')) as false_success_count from g {group})"""


@query("compatible_summary", f"with {views.PAIRS}, g as (select source, {_gold2('gold')} as gold, predicted from pairs) " + _SUMMARY.format(by="source,", group="group by source"))
def compatible_summary(spark, sf):
    return metrics.compatible_summary(metrics.confusion(views.pairs(spark, sf), ["source"]), ["source"])


@query(
    "semantic_per_class",
    f"with {views.PAIRS}, names as (select unnest({list(tx.VERDICTS)}) as name) "
    + _score_sql("""select name, count(*) filter (gold = name) as support, count(*) filter (predicted = name) as predicted,
       count(*) filter (gold = name and predicted = name) as hits from pairs cross join names group by name"""),
)
def semantic_per_class(spark, sf):
    return metrics.semantic_per_class(metrics.confusion(views.pairs(spark, sf)))


@query(
    "semantic_summary",
    f"""with {views.PAIRS}, s as (select count(*) as total, count(*) filter (gold = predicted) as ok, count(*) filter (predicted = 'confirmed_upload_success') as c,
      count(*) filter (predicted = 'confirmed_upload_success' and gold = predicted) as ch,
      count(*) filter (gold = 'failed' and predicted in ('confirmed_upload_success', 'likely_upload_success')) as failed_to_success from pairs),
    r as (select *, ok::double / total as a, case when c = 0 then 0.0::double else ch::double / c end as p from s)
    select total, failed_to_success, round_even(a, 6) as accuracy_4, round_even(p, 6) as confirmed_precision, a >= 0.85 as gate_accuracy, p >= 0.9 as gate_confirmed,
      failed_to_success = 0 as gate_failed_to_success, a >= 0.85 and p >= 0.9 and failed_to_success = 0 as passed from r""",
)
def semantic_summary(spark, sf):
    return metrics.all_gates(metrics.semantic_summary(metrics.confusion(views.pairs(spark, sf))))


@query(
    "sliced_metrics",
    f"""with {views.UPLOADS}, s as (select label as gold, predicted, unnest(['status_code', 'status_family', 'extension', 'template_cluster']) as slice,
      unnest([status_code::varchar, case when status_code = 0 then 'unknown' else (status_code // 100) || 'xx' end, case when file_ext = '' then '<none>' else trim(lower(file_ext), '.') end,
              substring(sha256({_CLUSTER}), 1, 12) || ':' || substring({_CLUSTER}, 1, 60)]) as key from uploads),
    top as (select slice, key from s where slice = 'template_cluster' group by slice, key having count(*) >= 2 order by count(*) desc, key limit 100),
    g as (select slice, key, {_gold2("gold")} as gold, predicted from s where slice <> 'template_cluster' or key in (select key from top)) """
    + _SUMMARY.format(by="slice, key,", group="group by slice, key"),
)
def sliced_metrics(spark, sf):
    extension = tx.bare_extension("file_ext")
    rows = views.uploads(spark, sf).withColumnRenamed("label", "gold")
    counted = metrics.sliced(
        rows,
        {
            "status_code": F.col("status_code").cast("string"), "status_family": tx.status_family("status_code"),
            "extension": F.when(F.col("file_ext") == "", "<none>").otherwise(extension), "template_cluster": fp.cluster_key("body"),
        },
        top={"template_cluster": 100},
    )
    return metrics.compatible_summary(counted, ["slice", "key"])


@query(
    "classification_report",
    f"""with {views.PAIRS}, names as (select gold as name from pairs union select predicted from pairs),
    c as (select name, count(*) filter (gold = name) as support, count(*) filter (predicted = name) as n, count(*) filter (gold = name and predicted = name) as hits from pairs cross join names group by name),
    s as (select *, case when n = 0 then 0.0::double else hits::double / n end as p, case when support = 0 then 0.0::double else hits::double / support end as r from c),
    x as (select name, p, r, case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end as f, support, hits from s),
    every as (select name, p, r, f, support from x union all select 'macro avg', avg(p), avg(r), avg(f), sum(support)::bigint from x
      union all select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::bigint from x
      union all select 'accuracy', sum(hits)::double / sum(support), sum(hits)::double / sum(support), sum(hits)::double / sum(support), sum(support)::bigint from x)
    select name, round_even(p, 6) as precision, round_even(r, 6) as recall, round_even(f, 6) as f1, support from every""",
)
def classification_report(spark, sf):
    return metrics.classification_report(metrics.confusion(views.pairs(spark, sf)))


@query("transitions", f"with {views.PAIRS} select gold || '->' || predicted as transition, gold = predicted as agreed, count(*) as rows from pairs group by all")
def transitions(spark, sf):
    return metrics.transitions(views.pairs(spark, sf), "gold", "predicted")


@query("cross_table", f"with {views.PAIRS} select source, " + ", ".join(f"count(*) filter (gold = '{v}') as {v}" for v in tx.VERDICTS) + " from pairs group by source")
def cross_table(spark, sf):
    return metrics.cross_table(views.pairs(spark, sf), "source", "gold")


# --- Decisions

_EVIDENCE = """evidence as (
  select event_id, (event_id * 37 % 101) / 100.0::double as p_success, event_id % 2 = 0 as has_success, event_id % 5 = 0 as has_failure, event_id % 15 = 0 as strong_failure,
    event_id % 7 = 0 as nested_false, (['php', 'stl', 'png'])[event_id % 3 + 1] as file_ext, event_id % 4 = 0 as success_text, event_id % 8 < 3 as filename_in_response,
    (['STRONG', 'WEAK', 'NONE', 'NONE'])[event_id % 4 + 1] as evidence_grade, event_id % 6 < 3 as filename_context, event_id % 11 = 0 as processed_form from events)"""


def _evidence(spark, sf):
    e = F.col("event_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (e % len(v) + 1).cast("int"))
    return views.table(spark, sf, "events").select(
        "event_id", (e * 37 % 101 / F.lit(100.0)).alias("p_success"), (e % 2 == 0).alias("has_success"), (e % 5 == 0).alias("has_failure"), (e % 15 == 0).alias("strong_failure"),
        (e % 7 == 0).alias("nested_false"), pick("php", "stl", "png").alias("file_ext"), (e % 4 == 0).alias("success_text"), (e % 8 < 3).alias("filename_in_response"),
        pick("STRONG", "WEAK", "NONE", "NONE").alias("evidence_grade"), (e % 6 < 3).alias("filename_context"), (e % 11 == 0).alias("processed_form"),
    )


@query(
    "decisions",
    f"""with {_EVIDENCE}, d as (select *, 1 - p_success as q, case
        when has_failure and strong_failure then 'evidence_strong_failure' when has_failure and has_success then 'evidence_conflict' when has_failure then 'evidence_failure'
        when nested_false and has_success then 'nested_evidence_conflict' when file_ext = 'stl' and p_success >= 0.6 then 'safe_ext_downgrade'
        when p_success >= 0.85 and success_text and filename_in_response then 'model_confirmed_success_text_filename_echo'
        when p_success >= 0.85 and evidence_grade = 'STRONG' then 'model_confirmed_strong' when p_success >= 0.85 and evidence_grade = 'WEAK' then 'model_likely_weak'
        when p_success >= 0.85 and has_success and filename_context then 'model_likely_success_context' when p_success >= 0.85 and processed_form and filename_context then 'model_likely_processed_form_ack'
        when p_success >= 0.85 then 'model_no_evidence' when p_success >= 0.6 and evidence_grade in ('STRONG', 'WEAK') then 'model_likely_evidence'
        when 1 - p_success >= 0.85 then 'model_failed_without_evidence' else 'model_unknown' end as source from evidence)
    select event_id, round_even(p_success, 6) as p_success, source,
      case when source like 'model_confirmed%' then 'confirmed_upload_success' when source like 'model_likely%' then 'likely_upload_success'
           when source in ('evidence_strong_failure', 'evidence_failure') then 'failed' else 'unknown' end as verdict,
      round_even(case source when 'evidence_strong_failure' then greatest(q, 0.97) when 'evidence_failure' then greatest(q, 0.9) when 'evidence_conflict' then 0.5 when 'nested_evidence_conflict' then 0.5
        when 'safe_ext_downgrade' then least(p_success, 0.5) when 'model_no_evidence' then least(p_success, 0.5) when 'model_failed_without_evidence' then q
        when 'model_unknown' then greatest(p_success, q) else p_success end::double, 4) as confidence from d""",
)
def decided(spark, sf):
    return decisions.judged(_evidence(spark, sf)).select("event_id", "p_success", "source", "verdict", "confidence")


@query("parity_mismatches", f"with {_EVIDENCE} select event_id from evidence where event_id % 500 = 7")
def parity_mismatches(spark, sf):
    """Two runs of which one differs in some rows."""
    one = decisions.judged(_evidence(spark, sf)).select("event_id", "verdict", "confidence")
    other = one.withColumn("confidence", F.when(F.col("event_id") % 500 == 7, F.col("confidence") + 0.5).otherwise(F.col("confidence")))
    return decisions.mismatches(one, other, "event_id")


@query("upload_features")
def upload_features(spark, sf):
    f = evidence.with_features(views.responses(spark, sf))
    return f.select("event_id", "f.success_fields", "f.fail_fields", "f.paths", "f.file_ids", "f.resource_score", "f.success_strength", "f.evidence_grade", "f.strong_failure", evidence.numeric_features().alias("numbers"))


@query("judged_uploads")
def judged_uploads(spark, sf):
    ruled = evidence.with_rule(evidence.with_features(views.responses(spark, sf)))
    return evidence.judge(ruled).select("event_id", "verdict", "confidence", "p_success", "decided_by", "evidence", "negative_evidence")


@query(
    "alert_conversion",
    f"""with {views.ALERTS}, a as (select *, url as uri from alerts)
    select 'tdp_failed_' || line as event_id, 'POST' as method, {_URI} as uri, case line % 4 when 0 then 'a' || line || '.PHP' when 1 then 'b ' || line || '.txt' else '' end as filename,
      case line % 4 when 0 then 'php' when 1 then 'txt' else '' end as file_ext, case line % 4 when 0 then 'file' when 1 then 'b%20' || line || '.txt' else '' end as field_name,
      case when line % 5 = 0 then 0 else 200 + line % 5 end::int as status_code, 'text/plain' as content_type, resp_body as body, 'failed' as label from a""",
)
def alert_conversion(spark, sf):
    events = http.standardised(http.alerts(views.alerts(spark, sf), "failed"))
    return http.flat(events).select("event_id", "method", "uri", "filename", "file_ext", "field_name", "status_code", "content_type", "body", "label")


@query("review_sample")
def review_sample(spark, sf):
    """Upload events by sampling stratum, 200 of them in turn from each."""
    ruled = evidence.with_rule(evidence.with_features(views.responses(spark, sf))).withColumn("source_label", F.lit("failed"))
    rows = materialize(ruled.select("event_id", reviewing.stratum().alias("stratum"), reviewing.failure_score("uri", "body").alias("score")))
    return splitting.round_robin_sample(rows, "stratum", "event_id", 200, 42)


@query("text_classifier")
def text_classifier(spark, sf):
    """Who speaks in a conversation turn, learned from the even conversations and predicted for all turns."""
    rows = views.table(spark, sf, "conversations").where("text is not null and role is not null").select("conv_id", "turn", "role", "text")
    fitted = model.fit(rows.where("conv_id % 2 = 0"), "text", "role")
    return fitted.predict(rows, "text").select("conv_id", "turn", "role", "predicted", "probabilities")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_counts(spark, sf_dir)
