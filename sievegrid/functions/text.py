"""Column functions over labels, addresses, headers and bodies of upload events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension lists, sensitive header names, label names.
SCRIPT_EXTENSIONS = (
    "php", "php3", "php4", "php5", "php7", "phtml", "phar", "jsp", "jspx", "jspf", "asp", "aspx", "ashx", "asa", "cer",
    "war", "jar", "exe", "dll", "sh", "bat", "cmd", "ps1", "cgi", "pl",
)
SAFE_EXTENSIONS = ("step", "stp", "stl", "obj", "dxf", "dwg", "igs", "iges", "glb", "gltf", "fbx", "skp", "sldprt", "sldasm")
SENSITIVE_HEADERS = (
    "authorization", "cookie", "set-cookie", "x-auth-token", "x-csrf-token", "csrf-token", "x-xsrf-token", "token", "proxy-authorization",
)
CONFIRMED, LIKELY, FAILED, UNKNOWN = "confirmed_upload_success", "likely_upload_success", "failed", "unknown"
VERDICTS = (CONFIRMED, LIKELY, FAILED, UNKNOWN)

_ABSOLUTE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def collapse_space(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def normalize_uri(x) -> Column:
    """Path and query of an absolute address, '/' for an empty path; anything else trimmed; null as ''.

    An address whose host has an unmatched bracket can't be parsed and stays as it is.
    """
    value = F.regexp_replace(text_or_empty(x), r"(?U)^\s+|\s+$", "")
    host, path, query = (F.regexp_extract(value, _ABSOLUTE, k) for k in (2, 3, 4))
    parsed = F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    broken = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    return F.when((host == "") | broken, value).otherwise(parsed)


def file_extension(x) -> Column:
    """What follows the last dot, lower-cased, at most 32 characters; '' without a dot."""
    name = text_or_empty(x)
    return F.when(F.contains(name, F.lit(".")), F.substring(F.lower(F.substring_index(name, ".", -1)), 1, 32)).otherwise("")


def bare_extension(x) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(x)), r"^\.+|\.+$", "")


def status_family(code) -> Column:
    c = F.coalesce(_c(code).cast("int"), F.lit(0))
    return F.when(c == 0, "unknown").otherwise(F.concat(F.floor(c / 100).cast("string"), F.lit("xx")))


def extension_group(x) -> Column:
    """script, safe_extension or other."""
    e = bare_extension(x)
    return F.when(e.isin(*SCRIPT_EXTENSIONS), "script").when(e.isin(*SAFE_EXTENSIONS), "safe_extension").otherwise("other")


def profile_extension_group(x) -> Column:
    """The three coarse groups of a dataset's profile."""
    e = bare_extension(x)
    return F.when(e.isin("php", "jsp", "aspx"), "php_jsp_aspx").when(e.isin("step", "stp", "stl"), "step_stl").otherwise("other")


def response_format(body, content_type) -> Column:
    """empty, json, html or text, from the content type or how the body begins."""
    b = F.regexp_replace(text_or_empty(body), r"(?U)^\s+|\s+$", "")
    kind = F.lower(text_or_empty(content_type))
    return (
        F.when(b == "", "empty")
        .when(F.contains(kind, F.lit("json")) | F.substring(b, 1, 1).isin("{", "["), "json")
        .when(F.contains(kind, F.lit("html")) | b.rlike(r"(?i)<(?:html|body|form)\b"), "html")
        .otherwise("text")
    )


def normalize_label(x) -> Column:
    """A source's label as a verdict."""
    v = _c(x)
    return F.when(v.isin("success", LIKELY, CONFIRMED), CONFIRMED).when(v.isin("failed", "failure"), FAILED).otherwise(v)


def normalize_gold(x) -> Column:
    """A gold label as success, failed or itself."""
    v = _c(x)
    return F.when(v.isin("success", LIKELY, CONFIRMED), "success").otherwise(v)


def redact_headers(headers) -> Column:
    """A header map with the values of sensitive names, and of names with token or secret, hidden."""
    return F.transform_values(
        _c(headers),
        lambda k, v: F.when(
            F.lower(k).isin(*SENSITIVE_HEADERS) | F.contains(F.lower(k), F.lit("token")) | F.contains(F.lower(k), F.lit("secret")), F.lit("<redacted>")
        ).otherwise(v.cast("string")),
    )


def parse_headers(text) -> Column:
    """Name: value lines as a map; the last of equal names counts."""
    lines = F.split(F.regexp_replace(text_or_empty(text), "\r\n?", "\n"), "\n")
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":")) & (F.trim(F.substring_index(x, ":", 1)) != "")),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"])
    )


def header(headers, name: str) -> Column:
    """The value of the first header with this name, whatever its case; '' if there is none."""
    hit = F.filter(F.map_entries(_c(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(""))
