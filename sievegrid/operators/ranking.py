"""Ranks and firsts within groups that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3
SALTS = 64


def hashed_rank(df: DataFrame, by: list[str], order: str, name: str, total: str = "") -> DataFrame:
    """df with the rank from 1 within `by` by `order`, a column of hexadecimal hashes.

    The hashes' leading digits cut a group into even parts in order: rows are ranked within
    their part, and the parts' counts give each its offset, and `total`, if it is named, the
    group's size. No group is in one task.
    """
    cut = df.withColumn("_part", F.substring(order, 1, DIGITS))
    sums = cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    offsets = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *size)
    local = Window.partitionBy(*by, "_part").orderBy(order)
    return (
        cut.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*by, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_part", "_local", "_before")
    )


def first_rows(df: DataFrame, by: list[str], order: list[Column], most: int = 1, salt: str = "_salt") -> DataFrame:
    """The first `most` rows of each group: of SALTS parts of it first, then of what these leave."""
    hashed = [F.col(c) for c, kind in df.dtypes if "map<" not in kind]  # maps have no hash
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy(*by, salt).orderBy(*order))
    left = salted.withColumn("_rank", part).where(F.col("_rank") <= most).drop("_rank", salt)
    whole = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return left.withColumn("_rank", whole).where(F.col("_rank") <= most).drop("_rank")
