"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents hang in a tree (for the query: domain, language, source). A token budget is handed
down level by level: among the children of a node it is split by weight, each child taking no
more than all its descendants can supply (their tokens times the epochs allowed), and what a
child can't take goes to its siblings. So a shortage leaves a node only when all below it are
exhausted. Each leaf then takes whole epochs of its documents and, of the next epoch, the
prefix that its rest pays for, in an order seeded for that epoch.

The prefix of a leaf is found by the leading digits of the order key: sums per digit pair give
the pair in which the budget ends, twice; only documents that share these four hexadecimal
digits are put in order one by one. No leaf is sorted as a whole, however large.

All amounts are integers: a split rounds each share down, so a parent leaves less than one
token for each child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import materialize, table

PATH = ("domain", "lang", "source")
SEED = 20
EPOCHS = 2
#: Budget as a share of the table's tokens, in hundredths.
BUDGET_PERCENT = 60
#: Production weights; a child that is not named weighs 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 3, "fr": 2}
#: Per-leaf figures of more leaves than this are not broadcast but joined by shuffle.
BROADCAST_LEAVES = 20_000
WORD = r"[^ \t\n\r\f\x0B]+"


def weight_of(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, parent: list[str], child: str, budget: Column) -> DataFrame:
    """children (parent..., child, weight, supply) with `budget`, the child's share of its parent's.

    The children that their weighted share would exhaust are a prefix by supply per weight:
    one is exhausted if, at the rate left by those before it, its share reaches its supply.
    """
    order = [F.col("supply") / F.col("weight"), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    x = children.withColumn("_b", budget.cast("long")).withColumn("_used", F.coalesce(F.sum("supply").over(before), F.lit(0)))
    x = x.withColumn("_sat", F.col("supply") * F.sum("weight").over(onward) <= F.col("weight") * (F.col("_b") - F.col("_used")))
    rest = F.col("_b") - F.sum(F.when(F.col("_sat"), F.col("supply")).otherwise(0)).over(every)
    share = F.sum(F.when(F.col("_sat"), 0).otherwise(F.col("weight"))).over(every)
    x = x.withColumn("_rest", rest).withColumn("_share", share)
    return x.withColumn(
        "budget", F.when(F.col("_sat"), F.col("supply")).otherwise(F.expr("(weight * _rest) div _share"))
    ).drop("_b", "_used", "_sat", "_rest", "_share")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: dict[str, Column], total: int) -> DataFrame:
    """leaves (path..., tokens, supply) with the budget of each leaf."""
    above = None
    for depth in range(1, len(path) + 1):
        level = leaves.groupBy(*path[:depth]).agg(F.sum("supply").alias("supply")).withColumn("weight", weights[path[depth - 1]])
        parent = path[: depth - 1]
        if above is None:
            level = split_budget(level, [], path[0], F.lit(total))
        else:
            level = split_budget(level.join(above.withColumnRenamed("budget", "_above"), parent), parent, path[depth - 1], F.col("_above"))
        above = level.select(*path[:depth], "budget")
    return leaves.join(above, path)


def _keyed(docs: DataFrame, path: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def cuts(docs: DataFrame, path: list[str], weights: dict[str, Column], percent: int, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """For each leaf of docs (doc_id, path..., tokens) that gets a budget: its whole epochs
    (_whole) and the last order key taken of the next epoch (_cut; '' if none is).
    """
    leaves = docs.groupBy(*path).agg(F.sum("tokens").alias("tokens")).withColumn("supply", F.col("tokens") * epochs)
    leaves = materialize(leaves)
    n, total = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    small = F.broadcast if n <= BROADCAST_LEAVES else (lambda df: df)
    plan = materialize(
        leaf_budgets(leaves, path, weights, total * percent // 100)
        .where("tokens > 0 and budget > 0")
        .select(*path, F.expr("budget div tokens").alias("_whole"), F.expr("budget % tokens").alias("_rest"))
    )
    keyed = docs.join(small(plan.select(*path, "_whole")), path).withColumn("_key", _keyed(docs, path, seed))
    ends = plan.where("_rest > 0").select(*path, F.col("_rest").alias("_left"), F.lit("").alias("_prefix"))
    for digits in (2, 4):
        prefix = F.substring("_key", 1, digits - 2)
        sums = (
            keyed.join(small(ends), path)
            .where(prefix == F.col("_prefix"))
            .groupBy(*path, "_left", F.substring("_key", 1, digits).alias("_digits"))
            .agg(F.sum("tokens").alias("_n"))
        )
        through = Window.partitionBy(*path).orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_through", F.sum("_n").over(through)).where("_through > _left")
        ends = materialize(
            sums.groupBy(*path).agg(F.min(F.struct("_digits", F.expr("_left - (_through - _n)").alias("_l"))).alias("x"))
            .select(*path, F.col("x._l").alias("_left"), F.col("x._digits").alias("_prefix"))
        )
    through = Window.partitionBy(*path).orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        keyed.join(small(ends), path)
        .where(F.substring("_key", 1, 4) == F.col("_prefix"))
        .withColumn("_through", F.sum("tokens").over(through))
        .where("_through <= _left")
        .groupBy(*path)
        .agg(F.max("_key").alias("_last"))
    )
    found = ends.join(last, path, "left").select(*path, F.coalesce("_last", "_prefix").alias("_cut"))
    out = plan.select(*path, "_whole").join(found, path, "left").withColumn("_cut", F.coalesce("_cut", F.lit("")))
    return small(materialize(out))


def take(docs: DataFrame, ends: DataFrame, path: list[str], seed: int = SEED, column: str = "epoch") -> DataFrame:
    """docs (doc_id, path..., more) -> the rows that cuts() chose, with the epoch from 0, once per epoch."""
    partly = _keyed(docs, path, seed) <= F.col("_cut")
    taken = F.when(partly, F.col("_whole")).otherwise(F.col("_whole") - 1).cast("int")
    return (
        docs.join(ends, path)
        .withColumn("_last", taken)
        .where("_last >= 0")
        .withColumn(column, F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select(*docs.columns, column)
    )


def mix(docs: DataFrame, path: list[str], weights: dict[str, Column], percent: int, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, path..., tokens) -> the rows chosen, with `epoch` from 0, once per epoch.

    Path values must not be null. Rows of one leaf with equal ids are taken or left together;
    a null id counts as the empty text. A leaf without tokens, or with a budget of zero,
    gives no rows. An empty table gives no rows.
    """
    return take(docs, cuts(docs, path, weights, percent, epochs, seed), path, seed)


def _path() -> list[Column]:
    """The tree's columns, for PATH, of documents with lang and source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.substring(number, -1, 1).cast("int") % 4).cast("string")))
    return [domain, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))]


def tree(docs: DataFrame) -> DataFrame:
    """docs with the columns of PATH (null: '') and tokens, words between white space."""
    return docs.select(
        "doc_id",
        *[c.alias(p) for c, p in zip(_path(), PATH, strict=True)],
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    )


def mix_documents(docs: DataFrame, percent: int = BUDGET_PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, more) that mix() chooses, once per epoch, as they are.

    Texts are counted once and are in no shuffle: the second pass compares keys only.
    """
    slim = materialize(tree(docs))
    ends = cuts(slim, list(PATH), weights(), percent)
    names = [f"_tree_{p}" for p in PATH]
    placed = docs.select("*", *[c.alias(n) for c, n in zip(_path(), names, strict=True)])
    renamed = ends
    for p, n in zip(PATH, names, strict=True):
        renamed = renamed.withColumnRenamed(p, n)
    return take(placed, renamed, names, column="_tree_epoch").select(docs.columns)


def weights() -> dict[str, Column]:
    return {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(1).cast("long")}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(tree(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))
    return mix(docs, list(PATH), weights(), BUDGET_PERCENT)


def _level(name: str, parent: list[str], child: str, weight: str, source: str) -> str:
    by = f"partition by {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, child])
    return f"""
{name}_0 as ({source}),
{name}_1 as (
  select *, coalesce(sum(supply) over ({by} order by supply / weight, {child} rows between unbounded preceding and 1 preceding), 0)::bigint as used,
         sum(weight) over ({by} order by supply / weight, {child} rows between current row and unbounded following)::bigint as onward
  from (select *, ({weight})::bigint as weight from {name}_0)),
{name}_2 as (select *, supply * onward <= weight * (above - used) as sat from {name}_1),
{name}_3 as (
  select *, above - (sum(case when sat then supply else 0 end) over ({by}))::bigint as rest,
         (sum(case when sat then 0 else weight end) over ({by}))::bigint as share
  from {name}_2),
{name} as (select {keys}, case when sat then supply else (weight * rest) // share end as budget from {name}_3)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


ORACLE_SQL = f"""
with docs as (
  select doc_id, case when number = '' then 'other' else 'domain' || (right(number, 1)::int % 4) end as domain, lang, source, tokens
  from (select doc_id, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as number, coalesce(lang, '') as lang, coalesce(source, '') as source,
               coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::bigint as tokens from documents)),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * {EPOCHS})::bigint as supply from docs group by all),
total as (select coalesce(sum(tokens), 0)::bigint * {BUDGET_PERCENT} // 100 as above from leaves),
{_level("top", [], "domain", _case("domain", DOMAIN_WEIGHTS), "select domain, sum(supply)::bigint as supply, any_value(above) as above from leaves, total group by all")},
{_level("middle", ["domain"], "lang", _case("lang", LANG_WEIGHTS), "select domain, lang, sum(supply)::bigint as supply, any_value(budget) as above from leaves join top using (domain) group by all")},
{_level("low", ["domain", "lang"], "source", "1", "select domain, lang, source, supply, budget as above from leaves join middle using (domain, lang)")},
planned as (
  select domain, lang, source, budget // tokens as whole, budget % tokens as left_over
  from leaves join low using (domain, lang, source) where tokens > 0 and budget > 0),
keyed as (
  select d.*, whole, left_over, md5('{SEED}:' || whole || ':' || coalesce(doc_id::varchar, '')) as key
  from docs d join planned using (domain, lang, source)),
ordered as (select *, sum(tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as through from keyed)
select doc_id, domain, lang, source, tokens, epoch::int as epoch
from (select *, unnest(range(whole + 1)) as epoch from ordered)
where epoch < whole or (left_over > 0 and through <= left_over)
"""
