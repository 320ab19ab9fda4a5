"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors of a label become one representative with a count. Labels with many
representatives are cut into clusters around centroids from a bounded sample; where a label
needs more clusters than the sample carries, a second set of centroids for what the first
ones leave over (residuals) splits each of them, so that clusters keep their size at any number
of vectors. Each representative is a member of its nearest clusters, so that clusters overlap.
Every cluster's members get a graph by robust pruning (an edge is dropped if a kept
neighbour is ALPHA times nearer to its end), and the adjacency lists that a representative
has in several clusters are united.

Of how many clusters it is a member is calibrated for each label: pairs at exactly the
threshold, in random directions around sampled vectors, must meet in a common cluster ROUTED of
the time. Every member searches its clusters: a greedy beam search goes from the medoid to the
query's surroundings, and the range is expanded along edges until no new vector within the
slack is found; every found pair is verified by its cosine in double precision. Some queries of
each cluster are audited against all its members, and a cluster whose audit falls short is
searched exhaustively in blocks instead. At the end a seeded sample of AUDITED representatives
is compared with all vectors of their labels: that is the recall reported, and memberships are
doubled until it holds. A neighbour counts in the first cluster that both share; links leave
a cluster as local components, so no pairs are ever written out.

Clusters beyond MEMBERS are split by hash, and so are their queries beyond QUERIES: every
task is of bounded size, however many near copies one vector has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sievegrid.llm.common import connected_components, materialize, table

THRESHOLD = 0.93
SLACK = 0.05
#: Members of a cluster that are aimed at.
TARGET = 1000
#: Bounds of the fitted index: vectors sampled, centroids of each of the two sets of a label, first centroids of a vector whose splits are compared.
SAMPLE = 20_000
CENTROIDS = 4096
COARSE = 16
#: Share of pairs at the threshold that must meet in a cluster; memberships at least and at most.
ROUTED = 0.99
LEAST_HOMES, MOST_HOMES = 3, 16
MEMBERS, QUERIES = 4000, 4000
DEGREE, CANDIDATES, ALPHA, BEAM, AT_ONCE = 20, 40, 1.2, 32, 4
AUDIT, AUDIT_RECALL = 24, 0.99
AUDITED, LEAST_RECALL = 256, 0.99
_BLOCK = 512
#: Pairs of a query and a neighbour looked at together while ranges grow.
_PAIRS = 1 << 20


def centroids(x: np.ndarray, k: int, seed: int = 7, rounds: int = 4, spherical: bool = True) -> np.ndarray:
    """k-means from random members; dense places keep several centroids. Spherical ones are unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T - (c**2).sum(1) / 2).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True) if spherical else np.bincount(own, minlength=len(c))[:, None]
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 3) -> np.ndarray:
    """Neighbours of each row of unit vectors x, -1 where there are fewer: pruned from its
    nearest rows and some random ones, which keep far parts of the graph in reach."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(CANDIDATES, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if near < 1:
        return out
    x32 = x.astype(np.float32)
    for at in range(0, n, _BLOCK):
        rows = np.arange(at, min(at + _BLOCK, n))
        cos = x32[rows] @ x32.T
        cos[np.arange(len(rows)), rows] = -2
        pool = np.hstack([np.argpartition(-cos, near - 1, axis=1)[:, :near], rng.integers(0, n, (len(rows), 16))])
        d = 1 - np.take_along_axis(cos, pool, 1)
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
        alive = pool != rows[:, None]
        vectors = x32[pool]
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[np.arange(len(rows)), first]
            if not some.any():
                break
            picked = pool[np.arange(len(rows)), first]
            out[rows[some], k] = picked[some]
            between = 1 - np.einsum("rcd,rd->rc", vectors, x32[picked])
            alive &= (alpha * between > d) & (pool != picked[:, None]) & some[:, None]
    return out


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    ids = frame["rid"].to_numpy()
    graph = robust_prune(_unit(frame["embedding"]))
    return pd.DataFrame({"rid": ids, "near": [ids[g[g >= 0]] for g in graph]})


def _adjacency(ids: np.ndarray, near: list) -> np.ndarray:
    """Positions of the united neighbours that are members here, both ways, -1 beyond."""
    order = np.argsort(ids, kind="stable")
    size = [len(a) for a in near]
    flat = np.concatenate(near).astype(np.int64) if sum(size) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
    to = order[at]
    source = np.repeat(np.arange(len(ids)), size)
    hit = (ids[to] == flat) & (to != source)
    both = np.unique(np.concatenate([source[hit] * len(ids) + to[hit], to[hit] * len(ids) + source[hit]]))
    source, to = both // len(ids), both % len(ids)
    count = np.bincount(source, minlength=len(ids))
    out = np.full((len(ids), max(1, int(count.max(initial=1)))), -1, np.int64)
    out[source, np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)] = to
    return out


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, radius: float, beam: int = BEAM) -> np.ndarray:
    """Boolean (query, member): found with cosine >= radius, by a beam from the medoid, then along edges."""
    n, m = len(x), len(queries)
    medoid = int((x @ x.mean(0)).argmax())
    seen = np.zeros((m, n), bool)
    cos = np.full((m, n), -2.0)
    rows = np.arange(m)
    pool = np.full((m, beam), -1, np.int64)
    value = np.full((m, beam), -3.0)
    done = np.ones((m, beam), bool)
    pool[:, 0], value[:, 0], done[:, 0] = medoid, queries @ x[medoid], False
    seen[:, medoid] = True
    cos[:, medoid] = value[:, 0]
    for _ in range(beam):
        open_ = np.where(done, -3.0, value)
        best = np.argpartition(-open_, AT_ONCE - 1, axis=1)[:, :AT_ONCE]
        fine = np.take_along_axis(open_, best, 1) > -3.0
        active = fine.any(1)
        if not active.any():
            break
        q, best, fine = rows[active], best[active], fine[active]
        done[q[:, None], best] = True
        near = np.where(fine[:, :, None], graph[pool[q[:, None], best]], -1).reshape(len(q), -1)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[q[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        a, b = np.nonzero(fresh)
        qa, nb = q[a], near[a, b]
        seen[qa, nb] = True
        c = np.einsum("pd,pd->p", queries[qa], x[nb])
        cos[qa, nb] = c
        new = np.full(near.shape, -3.0)
        new[a, b] = c
        all_value = np.hstack([value[q], new])
        all_pool = np.hstack([pool[q], near])
        all_done = np.hstack([done[q], new <= -3.0])
        top = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
        value[q], pool[q], done[q] = (np.take_along_axis(v, top, 1) for v in (all_value, all_pool, all_done))
    wide = radius - SLACK
    step = max(1, _PAIRS // graph.shape[1])
    grown = np.flatnonzero(cos.ravel() >= wide)
    while len(grown):
        more = []
        for at in range(0, len(grown), step):
            part = grown[at : at + step]
            near = graph[part % n]
            key = np.unique(((part // n)[:, None] * n + near)[near >= 0])
            key = key[~seen.ravel()[key]]
            seen.ravel()[key] = True
            c = np.empty(len(key))
            for low in range(0, len(key), _PAIRS // 16):
                of = key[low : low + _PAIRS // 16]
                c[low : low + _PAIRS // 16] = np.einsum("pd,pd->p", queries[of // n], x[of % n])
            cos.ravel()[key] = c
            more.append(key[c >= wide])
        grown = np.concatenate(more)
    return cos >= radius


def _search(frame: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """For each query here: the neighbours found that it meets in no nearer cluster, its local component's least id, and whether the graph found them."""
    asked = frame[frame["asks"].to_numpy()]
    out_ids = asked["rid"].to_numpy()
    mine = frame[frame["mine"].to_numpy()]
    if not len(mine) or not len(asked):
        return pd.DataFrame({"rid": out_ids, "found": np.zeros(len(out_ids), np.int64), "root": out_ids, "by_graph": True})
    near = dict(zip(lists["member"], lists["near"], strict=True))
    ids, x, q = mine["rid"].to_numpy(), _unit(mine["embedding"]), _unit(asked["embedding"])
    here = int(frame["cluster"].iloc[0])
    weight, radius = mine["n"].to_numpy(), THRESHOLD
    homes = np.stack(mine["homes"].to_numpy())
    graph = _adjacency(ids, [near[r] for r in ids.tolist()])
    step = max(1, min(_BLOCK, 4_000_000 // len(ids)))
    pick = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
    truth = q[pick] @ x.T >= radius
    caught = range_search(q[pick], x, graph, radius)
    by_graph = bool((caught & truth).sum() >= AUDIT_RECALL * truth.sum())
    found = np.zeros(len(q), np.int64)
    # local components: labels are positions among members, then queries not among them
    position = {r: k for k, r in enumerate(ids.tolist())}
    place = np.array([position.setdefault(r, len(position)) for r in out_ids.tolist()])
    names = np.empty(len(position), np.int64)
    names[list(position.values())] = list(position)
    root = np.arange(len(names))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(q), step):
        block = q[at : at + step]
        hit = range_search(block, x, graph, radius) if by_graph else block @ x.T >= radius
        self = place[at : at + step]
        hit[np.flatnonzero(self < len(ids)), self[self < len(ids)]] = True
        for k, own in enumerate(asked["homes"].iloc[at : at + step]):
            linked = np.flatnonzero(hit[k])
            if len(linked):
                nearer = own[: int(np.flatnonzero(own == here)[0])]
                met = (homes[linked][:, :, None] == nearer).any((1, 2)) if len(nearer) else False
                found[at + k] = (weight[linked] * ~np.asarray(met)).sum()
                heads = np.unique(root[linked])
                least = find(place[at + k])
                for h in heads:
                    a, b = find(h), least
                    least = min(a, b)
                    root[max(a, b)] = least
                root[linked] = least
    top = np.array([find(k) for k in place])
    return pd.DataFrame({"rid": out_ids, "found": found, "root": names[top], "by_graph": by_graph})


def nearest_cells(x: np.ndarray, cells: dict, count: int) -> np.ndarray:
    """The `count` nearest cells of each row of unit vectors x, nearest first: around a centroid, or a centroid and a residual."""
    first, rest = cells["first"], cells["rest"]
    if rest is None:
        return np.argsort(((first**2).sum(1) - 2 * (x @ first.T)), axis=1, kind="stable")[:, : min(count, len(first))]
    out = []
    wide = min(COARSE, len(first))
    for at in range(0, len(x), 64):
        v = x[at : at + 64]
        d = (first**2).sum(1) - 2 * (v @ first.T)
        coarse = np.argsort(d, axis=1, kind="stable")[:, :wide]
        fine = cells["cross"][coarse] - 2 * (v @ rest.T)[:, None, :] + np.take_along_axis(d, coarse, 1)[:, :, None]
        code = (coarse[:, :, None] * len(rest) + np.arange(len(rest))).reshape(len(v), -1)
        order = np.argsort(fine.reshape(len(v), -1), axis=1, kind="stable")[:, :count]
        out.append(np.take_along_axis(code, order, 1))
    return np.concatenate(out)


def cut(sample: np.ndarray, n: int, target: int, most: int, seed: int = 7) -> dict:
    """Cells for n vectors like the unit vectors of the sample.

    Memberships are raised until pairs at the threshold around sampled vectors meet, and cells
    with them, as each membership fills them. Those vectors have no part in the centroids.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    apart = min(len(sample) // 5, 1000)
    base, sample = sample[order[:apart]] if apart else sample, sample[order[apart:]]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    other = THRESHOLD * base + np.sqrt(1 - THRESHOLD**2) * away
    homes = LEAST_HOMES
    while True:
        k = int(np.ceil(n * homes / target))
        coarse = max(1, min(k, most, len(sample) // 4))
        first = centroids(sample, coarse, seed)
        rest, cross = None, None
        if coarse < k:
            left = sample - first[(sample @ first.T).argmax(1)]
            rest = centroids(left, min(-(-k // coarse), most), seed, spherical=False)
            cross = (rest**2).sum(1) + 2 * (first @ rest.T)
        cells = {"first": first, "rest": rest, "cross": cross, "homes": homes}
        a, b = (nearest_cells(v, cells, homes) for v in (base, other))
        if (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= ROUTED or homes >= MOST_HOMES:
            return cells
        homes += 1


def _routes(shared, factor: int):
    @F.pandas_udf(ArrayType(IntegerType()))
    def routes(label: pd.Series, dim: pd.Series, embedding: pd.Series) -> pd.Series:
        out = [[0]] * len(label)
        for key, at in pd.DataFrame({"l": label.to_numpy(), "d": dim.to_numpy()}).groupby(["l", "d"]).indices.items():
            cells = shared.value.get((int(key[0]), int(key[1])))
            for low in range(0, len(at) if cells else 0, _BLOCK):
                part = at[low : low + _BLOCK]
                for i, row in zip(part, nearest_cells(_unit(embedding.iloc[part]), cells, cells["homes"] * factor).tolist(), strict=True):
                    out[i] = row
        return pd.Series(out)

    return routes


def _links(shared):
    """For each audited representative, the rows of its label within the threshold (its own among them)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, part in f.groupby(["label", "dim"]):
                asked = shared.value.get((int(key[0]), int(key[1])))
                if asked is not None:
                    hit = asked[1] @ _unit(part["embedding"]).T >= THRESHOLD
                    out.append(pd.DataFrame({"rid": asked[0], "truth": hit @ part["n"].to_numpy()}))
            yield pd.concat(out) if out else pd.DataFrame({"rid": [], "truth": []}).astype("int64")

    return run


def _by_kind(frame: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    for (label, dim), part in frame.groupby(["label", "dim"]):
        yield (int(label), int(dim)), part


def _searched(reps: DataFrame, model: dict, factor: int) -> DataFrame:
    """(rid, found, root, by_graph) for each representative and each of its clusters' parts."""
    place = ["label", "dim", "cluster"]
    routes = _routes(reps.sparkSession.sparkContext.broadcast(model), factor)
    homed = reps.withColumn("homes", routes("label", "dim", "embedding"))
    routed = materialize(homed.withColumn("cluster", F.explode("homes")))
    sizes = routed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"), F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("sides"))
    routed = routed.join(sizes, place).withColumn("own_part", F.pmod("rid", "parts").cast("int")).withColumn("own_side", F.pmod(F.shiftright("rid", 20), "sides").cast("int"))
    cell = [*place, "part"]
    lists = routed.withColumn("part", F.col("own_part")).select(*cell, "rid", "embedding").groupBy(*cell).applyInPandas(_build, "rid long, near array<long>")
    united = lists.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # a member is in its own part for all sides, a query in its own side for all parts; where there is one of each, one row is both
    every = routed.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = every.withColumn("mine", F.col("part") == F.col("own_part")).withColumn("asks", F.col("side") == F.col("own_side")).where("mine or asks")
    other = [f"_{c}" for c in (*cell, "side")]
    near = every.where("mine").select(*[F.col(c).alias(f"_{c}") for c in (*cell, "side")], "rid").join(united, "rid").select(*other, F.col("rid").alias("member"), "near")
    rows = every.select(*cell, "side", "rid", "n", "embedding", "homes", "mine", "asks")
    return materialize(rows.groupBy(*cell, "side").cogroup(near.groupBy(*other)).applyInPandas(_search, "rid long, found long, root long, by_graph boolean"))


def link_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): n_links, component_id, kept, and
    audit_recall, the share of the audited representatives' links that were found (1 if they have none).

    Null labels, and vectors that are null, empty, zero or hold a null or non-finite component,
    have no links and are their own component; vectors of different lengths never link. Rows
    with equal vectors and labels link with each other whatever their ids are. A null id
    names no component unless all its members' ids are null. Empty table: no rows.
    """
    usable = F.expr(
        "label is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
        " and exists(embedding, v -> v != 0)"
    )
    plain = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.expr("transform(embedding, v -> v + cast(0 as float))").alias("embedding"))
    rows = plain.withColumn("rid", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    reps = materialize(
        rows.where("rid is not null").groupBy("rid", "label", "embedding").agg(F.min("vec_id").alias("vid"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding"))
    )
    order = (F.xxhash64(F.lit(5), "rid"), "rid")
    large = materialize(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TARGET))
    sample = reps.join(large, ["label", "dim"]).orderBy(*order).limit(SAMPLE).select("label", "dim", "size", "embedding").toPandas()
    audited = reps.orderBy(*order).limit(AUDITED).select("rid", "label", "dim", "embedding").toPandas()
    model = {kind: cut(_unit(part["embedding"]), int(part["size"].iloc[0]), TARGET, CENTROIDS) for kind, part in _by_kind(sample)}
    asked = {kind: (part["rid"].to_numpy(), _unit(part["embedding"])) for kind, part in _by_kind(audited)}
    links = _links(vectors.sparkSession.sparkContext.broadcast(asked))
    truth = reps.select("label", "dim", "n", "embedding").mapInPandas(links, "rid long, truth long").groupBy("rid").agg(F.sum("truth").alias("truth"))
    truth = materialize(truth)
    factor = 1
    while True:
        searched = _searched(reps.select("rid", "label", "dim", "n", "embedding"), model, factor)
        found = searched.groupBy("rid").agg(F.sum("found").alias("found"))
        least = F.least("found", "truth") - 1
        caught, every = found.join(truth, "rid").agg(F.coalesce(F.sum(least), F.lit(0)), F.coalesce(F.sum(F.col("truth") - 1), F.lit(0))).first()
        recall = caught / every if every else 1.0
        if recall >= LEAST_RECALL or not model or factor >= 4:
            break
        factor *= 2
    joined = connected_components(searched.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    rooted = reps.select("rid", "vid", "n").join(joined.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("root", F.coalesce("component", "rid"))
    least = rooted.groupBy("root").agg(F.min("vid").alias("component_id"))
    result = rooted.join(least, "root").join(found, "rid").select("rid", F.greatest(F.col("found") - 1, F.col("n") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "rid").join(result, "rid", "left")
    component = F.when(F.col("rid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
