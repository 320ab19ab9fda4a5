"""JSON and JSONL records: strict reading with places of errors, and exclusive writing."""

from __future__ import annotations

import json
import math
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _finite(value: str) -> float:
    x = float(value)
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    return x


def _reject(value: str):
    raise ValueError("numbers must be finite")


def parse_object(text: str) -> dict:
    """One JSON object with finite numbers only."""
    value = json.loads(text, parse_float=_finite, parse_constant=_reject)
    if not isinstance(value, dict):
        raise ValueError("a record must be an object")
    return value


_CHECKED = StructType([StructField("json", StringType()), StructField("problem", StringType())])


def _checked(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        try:
            out.append((json.dumps(parse_object(line), ensure_ascii=False, separators=(",", ":")), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["json", "problem"])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, json, problem) of each non-blank line of JSONL files.

    Lines end at LF, CRLF or CR, never at other Unicode separators; a byte order mark is
    dropped. `problem` says why a line is no record; require_valid() turns it into an error.
    Files are split among tasks: a line's number is its rank by offset, found by counting the
    lines of each block of a file first.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    counts = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    lines = raw.withColumn("local", local).join(offsets, ["path", "block"])
    text = F.when((F.col("before") + F.col("local")) == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return (
        lines.select("path", (F.col("before") + F.col("local")).alias("line"), text.alias("text"))
        .where("trim(text) != ''")
        .withColumn("x", F.pandas_udf(_checked, _CHECKED)("text"))
        .select("path", "line", "x.json", "x.problem")
    )


def require_valid(records: DataFrame) -> DataFrame:
    """records, whose evaluation fails at the first line that is no record."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    fail = F.raise_error(F.concat(place, F.lit(": "), F.col("problem")))
    return records.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(fail)).drop("problem")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, json, problem) of JSON files that hold one object, or an array of objects."""
    kind = "array<struct<line: int, json: string, problem: string>>"

    @F.pandas_udf(kind)
    def rows(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                value = json.loads(text.removeprefix("﻿"), parse_float=_finite, parse_constant=_reject)
                items = value if isinstance(value, list) else [value]
                if not all(isinstance(x, dict) for x in items):
                    raise ValueError("a record must be an object")
                out.append([{"line": i + 1, "json": json.dumps(x, ensure_ascii=False, separators=(",", ":")), "problem": None} for i, x in enumerate(items)])
            except ValueError as e:
                out.append([{"line": 1, "json": None, "problem": str(e)}])
        return pd.Series(out)

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(rows("value")).alias("x"))
    return whole.select("path", "x.line", "x.json", "x.problem")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, content) of whole files, hashed and kept from the same bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")


def write_jsonl(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One compact object per line, in the order of columns; an existing path is an error."""
    chosen = rows.select(columns or rows.columns)
    bad = [c for c, t in chosen.dtypes if t in ("double", "float")]
    for c in bad:
        finite = F.col(c).isNull() | (~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
        chosen = chosen.withColumn(c, F.when(finite, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite"))))
    chosen.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_json(value, path: str | Path, overwrite: bool = False) -> None:
    """A small document, written whole or not at all; without overwrite an existing file is an error."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=".writing-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
