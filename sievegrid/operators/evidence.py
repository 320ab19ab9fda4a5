"""From upload events to evidence, a rule's verdict, numeric features and model text.

An event is a row with method, uri, filename, file_ext, field_name, request_body, status_code,
headers (the response's map), content_type and body. All patterns run as column expressions
over the body's first 20 000 characters; only the JSON tree, page text and percent escapes go
through one Arrow function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import patterns as pt
from sievegrid.functions.bodies import body_facts
from sievegrid.functions.text import CONFIRMED, FAILED, SCRIPT_EXTENSIONS, bare_extension, collapse_space, header, text_or_empty
from sievegrid.operators.decisions import Thresholds, decide

_FLAGS = "(?idU)"
_EMPTY = "array<string>"


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(_FLAGS + pattern)


def _strings(*values: Column) -> Column:
    return F.array(*values).cast(_EMPTY) if values else F.array().cast(_EMPTY)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _found(body: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of the patterns (their group, if they have one), trimmed, empty words left out, each once."""
    parts = [F.regexp_extract_all(body, F.lit(_FLAGS + p), F.lit(int("(" in p.replace("(?", "").replace(r"\(", "")))) for p in patterns]
    values = F.transform(F.concat(*parts), _stripped)
    return F.array_distinct(F.filter(values, lambda v: (v != "") & ~F.lower(v).isin(*pt.NO_VALUES)))


def _forward(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\\\"), F.lit("/")), F.lit("\\"), F.lit("/"))


def _real_path(v: Column) -> Column:
    """Not empty, not a bare drive, and not in a temporary folder."""
    return (_stripped(v) != "") & ~v.rlike(r"(?i)^[a-z]:[\\/]*$") & ~F.lower(_forward(v)).rlike(r"(?:^|/)(?:tmp|temp)(?:/|$)")


def _saved_path(v: Column) -> Column:
    x = _forward(v)
    return (
        F.contains(x, F.lit("/")) & _has(x, r"\.[a-z0-9]{1,16}(?:$|[?#\s])") & _has(x, r"(?:^|/)(?:webapps?|uploads?|files?|attachments?)(?:/|$)") & _real_path(v)
    )


def _storage_key(v: Column) -> Column:
    """16 or more characters with a slash or an extension, or with a part that is base64 of something with a slash."""

    def decodes(t: Column) -> Column:
        padded = F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)).cast("int")))
        text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return (F.length(t) >= 12) & t.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & F.coalesce(text.rlike(r"[/\\]"), F.lit(False))

    direct = v.rlike(r"[/\\]") | _has(v, r"\.[a-z0-9]{1,16}(?:$|[?#])")
    return (F.length(v) >= 16) & (direct | F.exists(F.split(v, "[-_]"), decodes))


def _names(table: tuple, body: Column) -> list[Column]:
    return [F.when(_has(body, pattern), F.lit(name)) for name, pattern in table]


def _present(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda v: v.isNotNull())


def _any_of(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]))


def with_features(events: DataFrame) -> DataFrame:
    """events with the struct column `f` of everything that rules, scores and reports use."""
    c = F.col
    x = events.withColumn("_body", F.substring(text_or_empty("body"), 1, 20000)).withColumn("_name", text_or_empty("filename"))
    x = x.withColumn("_uri", text_or_empty("uri")).withColumn("_facts", body_facts(c("_body"), c("_uri"), c("_name")))
    x = x.withColumn("_open", F.replace(F.replace(c("_body"), F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'")))
    x = x.withColumn("_location", F.coalesce(header("headers", "location"), F.lit("")))
    x = x.withColumn("_type", F.when(text_or_empty("content_type") != "", c("content_type")).otherwise(F.coalesce(header("headers", "content-type"), F.lit(""))))
    body, opened, fact = c("_body"), c("_open"), lambda n: c(f"_facts.{n}")
    parsed, json_type = fact("parsed"), F.contains(F.lower(c("_type")), F.lit("json"))

    kept = F.array_distinct(F.concat(F.filter(_found(opened, pt.PATHS), _real_path), F.filter(_found(opened, pt.MESSAGES), _saved_path)))
    links = F.filter(_found(opened, pt.HTML_LINKS), lambda v: _has(v, pt.HTML_RESOURCE_EXTENSION) | _has(v, pt.HTML_RESOURCE_SEGMENT))
    x = x.withColumn("_paths", F.array_distinct(F.concat(kept, links)))
    x = x.withColumn("_waiting", _has(body, pt.NONTERMINAL)).withColumn("_preview", _has(c("_uri"), pt.PREVIEW) & _has(body, pt.ROW_CONTAINER))
    silent = c("_waiting") | c("_preview")
    x = x.withColumn("_names", F.when(silent, _strings()).otherwise(_found(opened, pt.RETURNED_FILENAMES))).withColumn("_echo", fact("echo") & ~silent)
    x = x.withColumn("_context", F.trim(c("_name")) != "")

    address = c("_context") & _has(c("_uri"), pt.UPLOAD_ADDRESS)
    word = F.lower(F.regexp_replace(_stripped(body), "^[\"']+|[\"']+$", ""))
    plain = F.coalesce(fact("plain"), body)
    success = _present(
        [
            *_names(pt.SUCCESS, plain), F.when(address & (word == "upload"), "upload_ack"), F.when(address & (word == "1"), "scalar_upload_ack"),
            F.when(parsed & fact("upload_status"), "upload_status=success"),
        ]
    )
    first = F.when(fact("root_true") & ~F.array_contains(success, "success=true"), _strings(F.lit("success=true"))).otherwise(_strings())
    x = x.withColumn("_success", F.concat(first, success))

    loose = F.transform(F.regexp_extract_all(body, F.lit(_FLAGS + pt.JSON_LIKE_FAILURE), F.lit(1)), _stripped)
    like = ~parsed & json_type & ~_has(body, pt.ROW_CONTAINER)
    odd = F.transform(F.regexp_extract_all(body, F.lit(_FLAGS + pt.NONSTANDARD_FAILURE), F.lit(1)), _stripped)
    odd = F.filter(odd, lambda v: _has(v, pt.FAILURE_VALUE))
    strange = ~parsed & ~_has(body, pt.ROW_CONTAINER_LOOSE) & (F.size(odd) > 0)
    failure = _present(
        [
            F.when(F.when(parsed, fact("nested_false")).otherwise(_has(body, r'["\']success["\']\s*:\s*false\b')), "nested_success=false"),
            F.when(fact("root_false"), "success=false"),
            *_names(pt.FAILURE, body),
            F.when((parsed & fact("failure_text")) | (like & F.exists(loose, lambda v: _has(v, pt.FAILURE_VALUE))), "failure_text"),
            F.when((parsed & fact("upload_failure")) | (like & F.exists(loose, lambda v: _has(v, pt.UPLOAD_FAILURE_VALUE))), "upload_failure_text"),
            F.when(parsed & fact("status_false"), "status=false"),
            F.when(~parsed & ~json_type & fact("failure_page"), "failure_page"),
            F.when(strange, "failure_text"),
            F.when(strange & _has(F.get(odd, F.lit(0)), pt.UPLOAD_FAILURE_VALUE), "upload_failure_text"),
            F.when(~parsed & _has(body, r'["\']status["\']\s*:\s*false\b'), "status=false"),
        ]
    )
    x = x.withColumn("_failure", failure)

    keys = F.when(parsed, fact("data_keys")).otherwise(
        F.array_distinct(F.filter(F.transform(F.regexp_extract_all(opened, F.lit("(?s)" + _FLAGS + pt.DATA_KEY), F.lit(1)), _stripped), lambda v: v != ""))
    )
    x = x.withColumn("_keys", keys)
    coded = _any_of(c("_success"), ("code=0", "code=100000", "code=2xx"))
    more = F.concat(F.when(coded, F.filter(c("_keys"), _storage_key)).otherwise(_strings()), fact("coded_ids"))
    x = x.withColumn("_ids", F.array_distinct(F.concat(_found(opened, pt.FILE_IDS), more)))
    x = x.withColumn("_resources", F.array_distinct(F.concat(_found(opened, pt.RESOURCE_IDS), more))).withColumn("_hashes", _found(opened, pt.FILE_HASHES))

    strength = (
        F.when(F.array_contains("_success", "upload_success_text") | (c("_context") & _any_of(c("_success"), pt.CONTEXT_SUCCESS)), "explicit")
        .when(F.size("_success") > 0, "generic").otherwise("none")
    )
    located = c("_location") != ""
    signs = [F.size("_paths") > 0, F.size("_resources") > 0, located, (F.size("_names") > 0) | c("_echo"), F.size("_hashes") > 0]
    x = x.withColumn("_score", reduce(lambda a, b: a + b, [s.cast("int") for s in signs])).withColumn("_strength", strength)
    code = F.coalesce(c("status_code").cast("int"), F.lit(0))
    explicit = c("_strength") == "explicit"
    grade = (
        F.when((c("_score") >= 2) | ((c("_score") == 1) & explicit), "STRONG")
        .when((c("_score") == 1) | (explicit & code.between(200, 299)), "WEAK").otherwise("NONE")
    )
    strong = _any_of(c("_failure"), pt.STRONG_FAILURES)
    all_paths = F.when(located & ~F.array_contains("_paths", c("_location")), F.concat(F.array("_location"), c("_paths"))).otherwise(c("_paths"))
    f = {
        "status_code": code, "body": body, "body_empty": _stripped(body) == "", "content_type": c("_type"), "is_json": json_type | parsed,
        "is_html": F.contains(F.lower(c("_type")), F.lit("html")) | _has(body, pt.HTML_RESPONSE), "paths": all_paths, "file_ids": c("_ids"),
        "resource_ids": c("_resources"), "file_hashes": c("_hashes"), "storage_keys": c("_keys"), "returned_filenames": c("_names"), "location": c("_location"),
        "filename": c("_name"), "file_ext": bare_extension("file_ext"), "filename_in_response": c("_echo"), "success_fields": c("_success"), "fail_fields": c("_failure"),
        "resource_score": c("_score"), "success_strength": c("_strength"), "evidence_grade": grade, "filename_context": c("_context"), "top_level_success_true": fact("root_true"),
        "strong_failure": strong, "weak_failure_conflict": (F.size("_success") > 0) & (F.size("_failure") > 0) & ~strong,
    }
    return x.withColumn("f", F.struct(*[v.alias(k) for k, v in f.items()])).select(*events.columns, "f")


def _evidence(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def positive_evidence() -> Column:
    f = lambda n: F.col(f"f.{n}")
    created = F.when((f("status_code") == 201) & (f("location") != ""), F.array(f("location"))).otherwise(_strings())
    echo = F.when(f("filename_in_response") & (f("filename") != ""), F.array(f("filename"))).otherwise(_strings())
    parts = (
        ("success_field", f("success_fields")), ("returned_path", f("paths")), ("returned_file_id", f("file_ids")), ("returned_filename", f("returned_filenames")),
        ("created_location", created), ("filename_echo", echo),
    )
    return F.array_distinct(F.concat(*[_evidence(k, v) for k, v in parts]))


def negative_evidence() -> Column:
    empty = F.when(F.col("f.body_empty"), F.array(F.lit("empty_response_body"))).otherwise(_strings())
    return F.array_distinct(F.concat(_evidence("failure_field", F.col("f.fail_fields")), _evidence("ambiguous_signal", empty)))


def with_rule(featured: DataFrame) -> DataFrame:
    """featured events with evidence and the rule (verdict, confidence, rule) that settles them, null if none does."""
    f = lambda n: F.col(f"f.{n}")
    body = F.lower(f("body"))
    login = f("is_html") & _has(body, pt.LOGIN_PAGE)
    denied = f("status_code").isin(401, 403) & reduce(lambda a, b: a | b, [F.contains(body, F.lit(w)) for w in pt.PERMISSION_WORDS])
    failed = (F.size(f("fail_fields")) > 0) & ~f("weak_failure_conflict")
    bare = _stripped(body).isin("ok", "success", "true")
    stored = (
        ~f("file_ext").isin(*SCRIPT_EXTENSIONS) & ~f("body_empty") & ~bare & (F.size(f("success_fields")) > 0)
        & (f("success_strength") == "explicit") & (f("evidence_grade") == "STRONG")
    )
    out = lambda verdict, name: F.struct(F.lit(verdict).alias("verdict"), F.lit(0.97).alias("confidence"), F.lit(name).alias("rule"))
    extra = F.filter(
        F.array(
            F.when(login, F.struct(F.lit("failure_field").alias("type"), F.lit("login_page").alias("value"))),
            F.when(denied, F.struct(F.lit("status_code").alias("type"), f("status_code").cast("string").alias("value"))),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        featured.withColumn("evidence", positive_evidence())
        .withColumn("negative_evidence", F.concat(negative_evidence(), extra))
        .withColumn("rule", F.when(failed | login | denied, out(FAILED, "strong_failure")).when(stored, out(CONFIRMED, "strong_success")))
    )


def judge(ruled: DataFrame, p: str = "p_success", thresholds: Thresholds | None = None) -> DataFrame:
    """ruled events with a verdict: the rule's where there is one, else by probability and evidence."""
    f = lambda n: F.col(f"f.{n}")
    inputs = {
        "has_success": F.size(f("success_fields")) > 0, "has_failure": F.size(f("fail_fields")) > 0, "strong_failure": f("strong_failure"),
        "nested_false": F.array_contains(f("fail_fields"), "nested_success=false"), "file_ext": f("file_ext"),
        "success_text": F.array_contains(f("success_fields"), "upload_success_text"), "filename_in_response": f("filename_in_response"),
        "evidence_grade": f("evidence_grade"), "filename_context": f("filename_context"), "processed_form": f("is_html") & _has(f("body"), pt.PROCESSED_FORM),
    }
    kept = [c for c in ruled.columns if c not in inputs and c != p]
    x = ruled.select(*kept, p, *[v.alias(k) for k, v in inputs.items()]).withColumn("_d", decide(F.col(p), thresholds))
    settled = F.col("rule").isNotNull()
    return x.select(
        *kept,
        F.when(~settled, F.bround(p, 6)).alias(p),
        F.coalesce("rule.verdict", "_d.verdict").alias("verdict"),
        F.bround(F.coalesce("rule.confidence", "_d.confidence"), 4).alias("confidence"),
        F.coalesce(F.concat(F.lit("rule:"), F.col("rule.rule")), F.concat(F.lit("model:"), F.col("_d.source"))).alias("decided_by"),
    )


def numeric_features() -> Column:
    """The 24 numbers of a model's numeric part, each from 0 to 1."""
    f = lambda n: F.col(f"f.{n}")
    share = lambda n, most: F.least(n / F.lit(float(most)), F.lit(1.0))
    flag = lambda b: b.cast("double")
    wins, fails = F.array_distinct(f("success_fields")), F.array_distinct(f("fail_fields"))
    won = lambda name: flag(F.array_contains(wins, name))
    return F.array(
        F.least(F.greatest(f("status_code"), F.lit(0)), F.lit(999)) / 999.0, flag(f("status_code").between(200, 299)), share(F.log1p(F.length(f("body"))), 12),
        flag(f("is_json")), flag(f("is_html")), flag(f("body_empty")), flag(F.size(f("paths")) > 0), share(F.size(f("paths")), 5),
        flag(F.size(f("file_ids")) > 0), share(F.size(f("file_ids")), 5), flag(f("filename_in_response")), share(F.length(f("filename")), 100),
        share(F.length(f("file_ext")), 10), flag(f("location") != ""), share(F.size(wins), 4), share(F.size(fails), 3),
        won("success=true"), won("code=0"), won("state=success"), won("ok=true"), won("upload_success_text"),
        flag(F.array_contains(fails, "success=false")), flag(F.size(fails) > 0), share(F.length(text_or_empty("uri")), 500),
    )


def model_text() -> Column:
    """An event as ten lines for a text model."""
    cut = lambda x, n: F.substring(x, 1, n)
    lines = {
        "REQ_METHOD": F.upper(text_or_empty("method")), "REQ_URI": cut(text_or_empty("uri"), 1000), "REQ_FILENAME": cut(text_or_empty("filename"), 300),
        "REQ_EXT": bare_extension("file_ext"), "REQ_FIELD": cut(text_or_empty("field_name"), 200), "REQ_BODY": cut(collapse_space("request_body"), 500),
        "RESP_STATUS": F.coalesce(F.col("status_code").cast("string"), F.lit("0")), "RESP_CT": cut(text_or_empty("content_type"), 300),
        "RESP_LOCATION": cut(F.coalesce(header("headers", "location"), F.lit("")), 1000), "RESP_BODY": cut(collapse_space("body"), 5000),
    }
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), v) for k, v in lines.items()])
