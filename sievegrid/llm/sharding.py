"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with the same link key (for the query: equal texts) are neighbours; a shard is a
label. Linked documents start on hashed shards. In each round, joins give every linked
document the shard where most of its neighbours are (or one of the few it takes to hold them
all, if they outnumber a shard), the wanted moves between each two shards are counted, and
the moves that the shards' capacities allow are made; whole link groups move or stay where
they are small. Documents without a neighbour cut no edge: they fill what is left.

Ranks are taken in two steps, within hashed buckets and over the buckets' counts, so no
shard and no group is ever gathered into one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import materialize, table

SHARDS = 16
ROUNDS = 6
ROWS_PER_BUCKET = 5000
LEAST_BUCKETS, MOST_BUCKETS = 1024, 1 << 20


def _unit(*cols):
    """A hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _ranked(df: DataFrame, by: list[str], buckets: int, name: str) -> DataFrame:
    """df with a gapless rank from 0 within `by` (all rows, if empty), by hashed buckets."""
    key = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(3), "doc_id", "link"), F.lit(buckets)))
    sums = key.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*by, "_bucket").orderBy("doc_id", "link")
    return (
        key.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )


def allowed_moves(wanted: np.ndarray, held: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Moves from shard to shard, at most those wanted, after which no shard holds more than its capacity.

    Moves into a shard that would overflow are scaled down together; as that keeps documents
    where they are, it is repeated until nothing changes. Shards already over capacity take none.
    """
    moves = wanted.astype(float).copy()
    np.fill_diagonal(moves, 0)
    for _ in range(200):
        into = moves.sum(0)
        room = capacity - held + moves.sum(1)
        scale = np.where(into > np.maximum(room, 0), np.maximum(room, 0) / np.maximum(into, 1e-9), 1.0)
        if (scale > 1 - 1e-9).all():
            break
        moves *= scale
    return moves


def propagate(linked: DataFrame, shards: int, capacity: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """linked (doc_id, link, ...) with a column shard. The driver sees counts per pair of shards only."""
    state = materialize(linked.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id", "link"), F.lit(shards)).cast("int")))
    cap = max(1.0, float(capacity.min()))
    for r in range(rounds):
        counts = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        order = F.struct(-F.col("n"), F.xxhash64(F.lit(7), "link", "shard"), "shard")
        hubs = counts.groupBy("link").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(order)).alias("by"))
        # written, so that the join below has an exchange of its own, which can be split for a hot link
        hubs = hubs.select(
            "link", "total", F.transform(F.slice("by", 1, F.ceil(F.col("total") / cap).cast("int")), lambda x: x["shard"]).alias("best")
        )
        hubs = materialize(hubs)
        aim = F.when(F.array_contains("best", F.col("shard")), F.col("shard")).otherwise(
            F.element_at("best", (F.pmod(F.xxhash64(F.lit(9), "doc_id", "link"), F.size("best")) + 1).cast("int"))
        )
        aimed = state.join(hubs, "link").withColumn("aim", aim)
        seen = aimed.groupBy("shard", "aim").agg(F.count(F.lit(1)).alias("n")).collect()
        wanted, held = np.zeros((shards, shards)), np.zeros(shards)
        for x in seen:
            wanted[x["shard"], x["aim"]] += x["n"] * (x["shard"] != x["aim"])
            held[x["shard"]] += x["n"]
        if not wanted.any():
            break
        moves = allowed_moves(wanted, held, capacity)
        part = np.divide(moves, wanted, out=np.zeros_like(moves), where=wanted > 0)
        rate = F.element_at(F.array(*[F.lit(float(x)) for x in part.ravel()]), (F.col("shard") * shards + F.col("aim") + 1).cast("int"))
        small = F.col("total") < cap / 100
        draw = F.when(small, _unit(F.lit(100 + r), "link")).otherwise(_unit(F.lit(100 + r), "doc_id", "link"))
        moved = F.when((F.col("aim") != F.col("shard")) & (draw < rate), F.col("aim")).otherwise(F.col("shard"))
        state = materialize(aimed.withColumn("shard", moved).select(state.columns))
    return state


def shard_rows(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (doc_id, link, ...) with shard and slot: counts at most one apart, slots gapless from 0.

    A null link has no neighbours. Rows that are equal in all columns are interchangeable.
    Null ids are placed like any other. An empty table gives no rows.
    """
    nodes = materialize(nodes)
    total = nodes.count()
    quota = np.array([total // shards + (s < total % shards) for s in range(shards)])
    buckets = int(min(MOST_BUCKETS, max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)))
    groups = materialize(nodes.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("link"))
    linked = propagate(nodes.join(groups, "link", "left_semi"), shards, quota.astype(float), rounds)
    placed = _ranked(linked, ["shard"], buckets, "slot")
    full = F.element_at(F.array(*[F.lit(int(q)) for q in quota]), F.col("shard") + 1)
    placed = materialize(placed.withColumn("kept", F.col("slot") < full))
    held = {r["shard"]: r["n"] for r in placed.where("kept").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    loose = nodes.join(groups, "link", "left_anti").unionByName(placed.where(~F.col("kept")).select(nodes.columns))
    loose = _ranked(loose, [], buckets, "_index")
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        n, room = held.get(s, 0), int(quota[s]) - held.get(s, 0)
        here = (F.col("_index") >= start) & (F.col("_index") < start + room)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("_index") - start + n).otherwise(slot)
        start += room
    filled = loose.withColumn("shard", shard).withColumn("slot", slot.cast("long"))
    columns = [*nodes.columns, "shard", "slot"]
    return placed.where("kept").withColumn("slot", F.col("slot").cast("long")).select(columns).unionByName(filled.select(columns))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows of docs (doc_id, text) in `shards` shards under the law 'rows'; equal texts are linked.

    A null text has the size 1 and the CRC 0, and links with other null texts. Other columns
    are not read.
    """
    nodes = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.crc32("text"), F.lit(0)), "text", F.octet_length("text")).alias("link"),
    )
    return shard_rows(nodes, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
