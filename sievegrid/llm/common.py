"""What several pipeline operators share: table access, held-out rows, samples and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.session import materialize

#: Edges of a partition between the rounds of connected_components().
EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def bounded_ids(df: DataFrame, id_col: str, bound: int, seed: int = 11) -> DataFrame:
    """At most `bound` ids of df, chosen by a seeded hash: the same ids at every partitioning."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    return df.where(F.col(id_col).isNotNull()).select(id_col, key.alias("_order")).orderBy("_order", id_col).limit(bound)


def _is_star(edges: DataFrame) -> bool:
    """edges (u, v), u > v: true when every u has one v and no v is itself a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(edges.select("v", F.lit(0)))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return seen.where("ups > 1 or (ups = 1 and n > 1)").isEmpty()


def _edges(df: DataFrame) -> DataFrame:
    """df computed once, in as many partitions as its rows need: few edges make few shuffle files a round."""
    out = materialize(df)
    return out.coalesce(max(1, -(-out.count() // EDGES)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (a, b), as (node, component = smallest node reachable).

    Alternating large-star and small-star rounds: every round is a partial minimum per node
    joined back, so a node with very many neighbours is never gathered into one task. Nodes
    without an edge to another node are absent. Self loops, repeated edges and null ends are
    ignored; an empty input gives an empty result.
    """
    e = _edges(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _is_star(e):
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = _edges(small.where("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
