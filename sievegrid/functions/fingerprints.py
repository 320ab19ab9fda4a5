"""Identity keys: canonical JSON and its hash, exact and template fingerprints, cluster keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievegrid.functions.text import _c, collapse_space, normalize_uri, text_or_empty

# What a template replaces, in this order.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b[0-9a-fA-F]{16,}\b"
TIMESTAMP = r"\b(?:1[5-9]\d{8}|2\d{9}|\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}:\d{2})?)\b"
NUMBER = r"\b\d+\b"
TEMPLATE = ((UUID, "<uuid>"), (HEX, "<hex>"), (TIMESTAMP, "<timestamp>"), (NUMBER, "<num>"))
CLUSTER = (
    (r"\b[0-9a-f]{32,}\b", "<hash>"), (r"\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", "<uuid>"),
    (r"\b\d{4}-\d{1,2}-\d{1,2}(?:[t ]\d{1,2}:\d{2}:\d{2})?\b", "<time>"), (NUMBER, "<num>"),
)


def quoted(x) -> Column:
    """A string as a JSON string, non-ASCII characters kept."""
    whole = F.to_json(F.struct(text_or_empty(x).alias("x")))
    return F.substring(whole, 6, 2147483647).substr(F.lit(1), F.length(whole) - 6)


def stable_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def text_exact(text) -> Column:
    """Of a text sample without numeric features: the hash of its inputs as canonical JSON."""
    return stable_hash(F.concat(F.lit('{"features":[],"text":'), quoted(text), F.lit("}")))


def _inputs(texts: pd.Series, features: pd.Series) -> pd.Series:
    rows = ({"features": [float(x) for x in f] if f is not None else [], "text": t} for t, f in zip(texts, features, strict=True))
    return pd.Series([json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) for r in rows], dtype=object)


def inputs_exact(text, features) -> Column:
    """Like text_exact(), with numeric features: their canonical form is not the engine's, so it is made in Python."""
    return stable_hash(F.pandas_udf(_inputs, StringType())(_c(text), _c(features)))


def text_template(text) -> Column:
    """Of the text in lower case, white space collapsed and every number the same."""
    return stable_hash(quoted(F.regexp_replace(collapse_space(F.lower(text_or_empty(text))), r"\d+", "<N>")))


def _event(method, uri, status, content_type, body) -> Column:
    kind = F.trim(F.substring_index(F.lower(text_or_empty(content_type)), ";", 1))
    code = F.coalesce(_c(status).cast("string"), F.lit("0"))
    return F.sha2(F.concat_ws("|", F.upper(text_or_empty(method)), normalize_uri(uri), code, kind, body), 256)


def upload_exact(method, uri, status, content_type, body) -> Column:
    return _event(method, uri, status, content_type, text_or_empty(body))


def replaced(x: Column, rules) -> Column:
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return x


def upload_template(method, uri, status, content_type, body) -> Column:
    return _event(method, uri, status, content_type, replaced(text_or_empty(body), TEMPLATE))


def cluster_key(body) -> Column:
    """Short hash and beginning of a response body without what varies."""
    b = F.substring(collapse_space(replaced(F.lower(text_or_empty(body)), CLUSTER)), 1, 4000)
    return F.concat(F.substring(F.sha2(b, 256), 1, 12), F.lit(":"), F.substring(b, 1, 60))


def candidate_template(uri, body) -> Column:
    """Of a response for picking review candidates: its address and its body with every number the same."""
    return F.sha2(F.concat(text_or_empty(uri), F.lit("|"), F.regexp_replace(F.lower(text_or_empty(body)), NUMBER, "<num>")), 256)


def membership_key(kind, value) -> Column:
    """What lineage keeps of a key: the hash of its kind and value."""
    return stable_hash(F.concat(F.lit('{"kind":'), quoted(kind), F.lit(',"value":'), quoted(value), F.lit("}")))


def seeded_order(seed: int, key) -> Column:
    """An order that depends on the seed and the key only."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")), 256)
