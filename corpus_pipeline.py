"""A corpus through toxicity, near-dedup, decontamination, mixing and sharding.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of docs, so that each can be written and read again as
the next one's docs. Each works on all rows that its predecessor kept.

Rows without text are neither toxic nor contaminated. Rows without words are near copies of each
other; of each group of near copies one row stays, that with the smallest id (null ids last),
and a row that is there several times stays once. A row without words has no tokens to be chosen
for in the mix unless its source is taken whole. Null languages and sources are a branch of their own.
Other columns are carried along, whatever their names. An empty table goes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievegrid.llm import decontamination, mixing, sharding, simhash, toxicity
from sievegrid.llm.common import materialize, table

#: Share of the tokens that reach the mixing stage, in hundredths, that it spends.
MIX_PERCENT = 90


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is learned from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights, a document once for each epoch that it is chosen in."""
    return mixing.mix_documents(docs, MIX_PERCENT)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: four of the stages are fitted or iterative. The stages' operators are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
