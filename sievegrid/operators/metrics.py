"""Grouped evaluation: confusion counts once, everything else from them.

Every metric takes rows (group..., gold, predicted, n), already counted, so one partial
aggregation over the evaluated rows serves all metrics, whole or by slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import CONFIRMED, FAILED, LIKELY, UNKNOWN, VERDICTS, normalize_gold

PLACES = 6


def confusion(rows: DataFrame, by: list[str] | None = None, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    by = by or []
    return rows.groupBy(*by, F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def _rounded(x: Column) -> Column:
    return F.bround(x, PLACES)


def _scores(df: DataFrame) -> DataFrame:
    """support, predicted and hits -> precision, recall and f1."""
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return df.withColumn("precision", _rounded(p)).withColumn("recall", _rounded(r)).withColumn("f1", _rounded(ratio(2 * p * r, p + r)))


def _per_name(counted: DataFrame, by: list[str], names: tuple, expected) -> DataFrame:
    parts = [
        F.struct(
            F.lit(name).alias("name"),
            _sum(F.col("gold") == expected(name)).alias("support") if expected(name) else F.lit(0).cast("long").alias("support"),
            _sum(F.col("predicted") == name).alias("predicted"),
            (_sum((F.col("gold") == expected(name)) & (F.col("predicted") == name)) if expected(name) else F.lit(0).cast("long")).alias("hits"),
        )
        for name in names
    ]
    whole = counted.groupBy(*by).agg(F.array(*parts).alias("x"))
    return _scores(whole.select(*by, F.explode("x").alias("x")).select(*by, "x.*"))


def binary_gold(counted: DataFrame) -> DataFrame:
    return counted.withColumn("gold", normalize_gold("gold"))


def compatible_per_class(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of each verdict against binary gold: both success verdicts expect success."""
    expected = lambda name: "success" if name in (CONFIRMED, LIKELY) else FAILED if name == FAILED else None
    return _per_name(binary_gold(counted), by or [], VERDICTS, expected)


def compatible_summary(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates and gates against binary gold.

    The precision gates compare rounded values, the rate gates exact ones; an empty
    denominator is 0 in a rate and fails its gate.
    """
    success = F.col("predicted").isin(CONFIRMED, LIKELY)
    c = binary_gold(counted).groupBy(*(by or [])).agg(
        F.sum("n").cast("long").alias("total"),
        _sum(F.col("predicted") == CONFIRMED).alias("_c"),
        _sum((F.col("predicted") == CONFIRMED) & (F.col("gold") == "success")).alias("_ch"),
        _sum(F.col("predicted") == FAILED).alias("_f"),
        _sum((F.col("predicted") == FAILED) & (F.col("gold") == FAILED)).alias("_fh"),
        _sum(F.col("predicted") == UNKNOWN).alias("_u"),
        _sum(F.col("gold") == FAILED).alias("_gf"),
        _sum((F.col("gold") == FAILED) & success).alias("false_success_count"),
    )
    strict = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))
    return (
        c.withColumn("confirmed_precision", _rounded(ratio(F.col("_ch"), F.col("_c"))))
        .withColumn("failed_precision", _rounded(ratio(F.col("_fh"), F.col("_f"))))
        .withColumn("unknown_rate", _rounded(ratio(F.col("_u"), F.col("total"))))
        .withColumn("false_success_rate", _rounded(ratio(F.col("false_success_count"), F.col("_gf"))))
        .withColumn("gate_confirmed", F.col("confirmed_precision") >= 0.90)
        .withColumn("gate_failed", F.col("failed_precision") >= 0.95)
        .withColumn("gate_unknown", strict(F.col("_u"), F.col("total")) <= 0.30)
        .withColumn("gate_false_success", strict(F.col("false_success_count"), F.col("_gf")) <= 0.01)
        .drop("_c", "_ch", "_f", "_fh", "_u", "_gf")
    )


def _known(counted: DataFrame) -> DataFrame:
    legal = F.col("gold").isin(*VERDICTS) & F.col("predicted").isin(*VERDICTS)
    return counted.where(F.when(legal, F.lit(True)).otherwise(F.raise_error(F.lit("a label is none of the four verdicts"))))


def semantic_per_class(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of the four verdicts; any other label is an error."""
    return _per_name(_known(counted), by or [], VERDICTS, lambda name: name)


def semantic_summary(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = _known(counted).groupBy(*(by or [])).agg(
        F.sum("n").cast("long").alias("total"),
        _sum(F.col("gold") == F.col("predicted")).alias("_right"),
        _sum(F.col("predicted") == CONFIRMED).alias("_c"),
        _sum((F.col("predicted") == CONFIRMED) & (F.col("gold") == CONFIRMED)).alias("_ch"),
        _sum((F.col("gold") == FAILED) & F.col("predicted").isin(CONFIRMED, LIKELY)).alias("failed_to_success"),
    )
    accuracy, precision = ratio(F.col("_right"), F.col("total")), ratio(F.col("_ch"), F.col("_c"))
    return (
        c.withColumn("accuracy_4", _rounded(accuracy))
        .withColumn("confirmed_precision", _rounded(precision))
        .withColumn("gate_accuracy", accuracy >= 0.85)
        .withColumn("gate_confirmed", precision >= 0.90)
        .withColumn("gate_failed_to_success", F.col("failed_to_success") == 0)
        .drop("_right", "_c", "_ch")
    )


def all_gates(summary: DataFrame) -> DataFrame:
    """summary with `passed`, whether every gate is."""
    gates = [F.col(c) for c in summary.columns if c.startswith("gate_")]
    return summary.withColumn("passed", reduce(lambda a, b: a & b, gates))


def sliced(rows: DataFrame, slices: dict[str, Column], top: dict[str, int] | None = None) -> DataFrame:
    """(slice, key, gold, predicted, n): confusion counts for each slice's groups in one pass.

    For a slice in `top` only groups of two rows or more are kept, the largest so many, ties by key.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("key")) for k, v in slices.items()])
    counted = confusion(rows.select("gold", "predicted", F.explode(keys).alias("x")).select("gold", "predicted", "x.*"), ["slice", "key"])
    if not top:
        return counted
    sizes = counted.where(F.col("slice").isin(*top)).groupBy("slice", "key").agg(F.sum("n").alias("_n")).where("_n >= 2")
    kept = [sizes.where(F.col("slice") == s).orderBy(F.desc("_n"), "key").limit(n).select("slice", "key") for s, n in top.items()]
    chosen = counted.join(reduce(DataFrame.unionAll, kept), ["slice", "key"], "left_semi")
    return counted.where(~F.col("slice").isin(*top)).unionByName(chosen)


def classification_report(counted: DataFrame) -> DataFrame:
    """(name, precision, recall, f1, support) of each label seen, and macro, weighted and accuracy rows."""
    seen = counted.select(F.explode(F.array(F.struct(F.col("gold").alias("name"), F.col("n").alias("support"), F.lit(0).alias("predicted")), F.struct(F.col("predicted").alias("name"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("x")).select("x.*")
    sizes = seen.groupBy("name").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    hits = counted.where("gold = predicted").groupBy(F.col("gold").alias("name")).agg(F.sum("n").alias("hits"))
    x = sizes.join(hits, "name", "left").fillna(0, ["hits"])
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    x = x.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))
    names = ("precision", "recall", "f1")
    macro = x.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("name", F.lit("macro avg"))
    weighted = x.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).withColumn("name", F.lit("weighted avg"))
    right = x.agg(ratio(F.sum("hits"), F.sum("support")).alias("precision"), F.sum("support").alias("support"))
    accuracy = right.select(F.lit("accuracy").alias("name"), "precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"), "support")
    out = [d.select("name", *names, "support") for d in (x, macro, weighted, accuracy)]
    return reduce(DataFrame.unionAll, out).select("name", *[_rounded(F.col(c)).alias(c) for c in names], F.col("support").cast("long").alias("support"))


def transitions(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(transition, agreed, rows) of what a second judgement made of the first."""
    name = F.concat_ws("->", first, second)
    return rows.groupBy(name.alias("transition"), (F.col(first) == F.col(second)).alias("agreed")).agg(F.count(F.lit(1)).alias("rows"))


def cross_table(rows: DataFrame, row: str, column: str) -> DataFrame:
    """(row, one column a verdict) of counts."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in VERDICTS])


def top_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
